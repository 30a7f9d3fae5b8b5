"""Scores of followers per context: Kneser-Ney, Katz and weighted-difference pruning, and two simpler ones.

Models are long tables (ctx, w, raw, support) until `top_followers` makes (ctx, rank, w, score, support) of them. Top
lists go by (raw desc, w), which is total; scores are divided by the best one and rounded half up to four places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkglyph.sources.store import kept

from .counts import continuation, of_order, unigram_mle, with_totals

DISCOUNT, FOLLOWERS, LEAST, KATZ_K, DELTA = 0.75, 10, 3, 5, 1e-6
#: Below this, what is left of a context's mass is floating-point noise and counts as none.
NOISE = 1e-12


def hashed(rows: DataFrame) -> DataFrame:
    """The rows as the side of a join that is hashed a part at a time: the other, larger side isn't sorted, and no table is
    broadcast by the size of its files, which is far below its size in memory."""
    return rows.hint("shuffle_hash")


def top_rows(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("raw"), "w"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def top_followers(rows: DataFrame, k: int = FOLLOWERS) -> DataFrame:
    best = F.max("raw").over(Window.partitionBy("ctx"))
    return top_rows(rows, k).select("ctx", "rank", "w", F.round(F.col("raw") / best, 4).alias("score"), "support")


def _kn(rows: DataFrame, lower: Column, d: float) -> DataFrame:
    own = F.greatest(F.col("count") - F.lit(d), F.lit(0.0)) / F.col("total")
    return rows.withColumn("raw", own + (F.lit(d) * F.col("distinct_n") / F.col("total")) * lower)


def kn_bigrams(counts: DataFrame, d: float = DISCOUNT, least: int = 1, only: DataFrame | None = None) -> DataFrame:
    """(ctx, w, raw, support) of observed followers of contexts with `least` occurrences; of the contexts in `only`, if given."""
    rows = with_totals(counts, 2, least, only).join(hashed(continuation(of_order(counts, 2))), "w")
    return _kn(rows, F.col("p"), d).select("ctx", "w", "raw", F.col("total").alias("support"))


def _candidates(seen: DataFrame, lower: DataFrame) -> DataFrame:
    """Observed followers and those of the context's shorter form, (ctx, w, count, low, total, distinct_n), low null where it
    isn't listed."""
    per = seen.groupBy("ctx").agg(F.first("total").alias("total"), F.first("distinct_n").alias("distinct_n")).withColumn("short", F.regexp_replace("ctx", "^[^ ]* ", ""))
    low = lower.select(F.col("ctx").alias("short"), "w", F.col("raw").alias("low"))
    more = per.join(low, "short").select("ctx", "w", F.lit(0).cast("long").alias("count"), "low", "total", "distinct_n")
    own = seen.withColumn("low", F.lit(None).cast("double"))
    return own.unionByName(more).groupBy("ctx", "w").agg(*[F.max(x).alias(x) for x in ("count", "low", "total", "distinct_n")])


def _reachable(seen: DataFrame, lower: DataFrame, listed: int) -> DataFrame:
    """_candidates of the whole `lower`, without those that can't be among the `listed` best of their context: unseen
    followers go by `low` there, and at most distinct_n of the best ones are seen."""
    short = seen.groupBy("ctx").agg(F.first("total").alias("total"), F.first("distinct_n").alias("distinct_n")).withColumn("short", F.regexp_replace("ctx", "^[^ ]* ", ""))
    low = lower.select(F.col("ctx").alias("short"), "w", F.col("raw").alias("low"))
    own = seen.withColumn("short", F.regexp_replace("ctx", "^[^ ]* ", "")).join(low, ["short", "w"], "left").drop("short")
    place = F.row_number().over(Window.partitionBy("short").orderBy(F.desc("low"), "w"))
    # a row for each place that is asked for, so the join grows with the trigrams and not with the followers of their short contexts
    asked = short.withColumn("place", F.explode(F.sequence(F.lit(1), (F.col("distinct_n") + listed).cast("int"))))
    more = asked.join(low.withColumn("place", place), ["short", "place"])
    rows = own.unionByName(more.select("ctx", "w", F.lit(0).cast("long").alias("count"), "low", "total", "distinct_n"))
    return rows.groupBy("ctx", "w").agg(*[F.max(x).alias(x) for x in ("count", "low", "total", "distinct_n")])


def kn_trigrams(counts: DataFrame, d: float = DISCOUNT, least: int = LEAST, k: int | None = FOLLOWERS, listed: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Observed followers and those of the bigram backoff, which keeps its best `k` only (None: all of them); a follower
    that isn't listed there is backed off to its continuation probability. listed: only so many of a context's
    best followers are asked for. only: contexts (ctx, distinct) that are asked for."""
    seen = with_totals(counts, 3, least, only)
    lower = kn_bigrams(counts, d, only=None if only is None else only.select(F.regexp_replace("ctx", "^[^ ]* ", "").alias("ctx")).distinct())
    lower = lower if k is None else top_rows(lower, k)
    found = _candidates(seen, lower) if listed is None else _reachable(seen, lower, listed)
    rows = found.join(continuation(of_order(counts, 2)), "w", "left")
    return _kn(rows, F.coalesce("low", "p", F.lit(0.0)), d).select("ctx", "w", "raw", F.col("total").alias("support"))


def contexts(counts: DataFrame, n: int = 3, least: int = LEAST) -> DataFrame:
    """(ctx): contexts of the models of order n, those with `least` occurrences; each has a follower there."""
    return with_totals(counts, n, least).select("ctx").distinct()


def kn_order(counts: DataFrame, n: int, d: float = DISCOUNT) -> DataFrame:
    """Observed followers at any order, each backed off to the whole model of the next lower order."""
    if n == 2:
        return kn_bigrams(counts, d)
    grams = with_totals(counts, n).withColumn("short", F.regexp_replace("ctx", "^[^ ]* ", ""))
    lower = kn_order(counts, n - 1, d).select(F.col("ctx").alias("short"), "w", F.col("raw").alias("low"))
    rows = grams.join(lower, ["short", "w"], "left")
    return _kn(rows, F.coalesce("low", F.lit(0.0)), d).select("ctx", "w", "raw", F.col("total").alias("support"))


def katz_discounts(counts: DataFrame, k: int = KATZ_K, textbook: bool = False) -> DataFrame:
    """(n, r, d) for r from 1 to k: min((r + 1) / r * N[r + 1] / N[r] / ratio, 1) with ratio = (k + 1) * N[k + 1] / N[1], and 1
    where a bin is empty. textbook: (x - ratio) / (1 - ratio) in place of x / ratio."""
    bins = counts.groupBy("n").agg(F.array(*[F.count_if(F.col("count") == r).cast("double") for r in range(1, k + 2)]).alias("bins"))
    ratio = (k + 1) * F.element_at("bins", k + 1) / F.element_at("bins", 1)
    at = lambda r: F.element_at("bins", r)
    x = (F.col("r") + 1) / F.col("r") * (at(F.col("r") + 1) / at(F.col("r")))
    d = F.least((x - ratio) / (1 - ratio) if textbook else x / ratio, F.lit(1.0))
    whole = (at(1) > 0) & (at(k + 1) > 0)
    rows = bins.select("n", "bins", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("r"))
    return rows.select("n", F.col("r").cast("long").alias("r"), F.when(whole & (at(F.col("r")) > 0) & (at(F.col("r") + 1) > 0), d).otherwise(1.0).alias("d"))


def _discounted(counts: DataFrame, n: int, least: int = 1, textbook: bool = False) -> DataFrame:
    """(ctx, w, count, dc, total, raw): dc = discount * count; the table of discounts has k rows an order."""
    d = katz_discounts(counts.where(F.col("n") == n), textbook=textbook).select(F.col("r").alias("count"), "d")
    rows = with_totals(counts, n, least).join(F.broadcast(d), "count", "left")
    dc = F.coalesce("d", F.lit(1.0)) * F.col("count")
    return rows.select("ctx", "w", "count", dc.alias("dc"), "total", (dc / F.col("total")).alias("raw"))


def katz_bigrams(counts: DataFrame, least: int = 1, textbook: bool = False) -> DataFrame:
    return _discounted(counts, 2, least, textbook).select("ctx", "w", "raw", F.col("total").alias("support"))


def _share(total: Column, used: Column, low: Column) -> Column:
    """The mass that is left for unseen followers over theirs in the backoff, from sums of dc and of what seen ones have there."""
    left = (total - used) / total
    return F.when(F.abs(left) < NOISE, 0.0).otherwise(left / F.greatest(1 - low, F.lit(1e-12)))


def _beta(seen_low: DataFrame, listed: Column, *more: str) -> DataFrame:
    """(ctx, beta, had, more) of (ctx, w, dc, total, low): _share, and the followers that are `listed` in the backoff (few), so
    that unseen ones need no join with all seen."""
    beta = _share(F.first("total"), F.sum("dc"), F.sum(F.coalesce("low", F.lit(0.0)))).alias("beta")
    return seen_low.groupBy("ctx").agg(beta, F.collect_list(F.when(listed, F.col("w"))).alias("had"), *[F.first(x).alias(x) for x in more])


def katz_backoff(counts: DataFrame, k: int = FOLLOWERS, textbook: bool = False) -> DataFrame:
    """(ctx, w, raw): bigram followers and, with the mass left, the k most frequent words unseen there; the best k."""
    seen = _discounted(counts, 2, textbook=textbook)
    uni = unigram_mle(of_order(counts, 1))
    often = kept(uni.orderBy(F.desc("count"), "w").limit(k), "often")
    low = uni.select("w", F.col("p").alias("low")).join(F.broadcast(often.select("w", F.lit(True).alias("often"))), "w", "left")
    beta = _beta(seen.join(hashed(low), "w", "left"), F.col("often")).where("beta > 0")
    unseen = beta.join(F.broadcast(often)).where(~F.array_contains("had", F.col("w"))).select("ctx", "w", (F.col("beta") * F.col("p")).alias("raw"))
    return top_rows(seen.select("ctx", "w", "raw").unionByName(unseen), k).drop("rank")


def _with_backoff(counts: DataFrame, low: DataFrame, least: int, textbook: bool) -> DataFrame:
    """Discounted trigrams with `low` of the backoff (short, w, low), null where it doesn't list them."""
    seen = _discounted(counts, 3, least, textbook).withColumn("short", F.regexp_replace("ctx", "^[^ ]* ", ""))
    return seen.join(hashed(low), ["short", "w"], "left")


def _short_backoff(counts: DataFrame, k: int, textbook: bool) -> DataFrame:
    return katz_backoff(counts, k, textbook).select(F.col("ctx").alias("short"), "w", F.col("raw").alias("low"))


def _katz_parts(counts: DataFrame, least: int, k: int, textbook: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    low = kept(_short_backoff(counts, k, textbook), "backoff")  # these three are used several times each
    both = kept(_with_backoff(counts, low, least, textbook), "seen")
    return both, low, kept(_beta(both, F.col("low").isNotNull(), "short", "total"), "beta")


def katz_trigrams(counts: DataFrame, least: int = LEAST, k: int = FOLLOWERS, textbook: bool = False) -> DataFrame:
    """Discounted observed followers, and unseen ones of the backoff with a positive share of the mass that is left."""
    both, low, beta = _katz_parts(counts, least, k, textbook)
    unseen = beta.where("beta > 0").join(low, "short").where(~F.array_contains("had", F.col("w"))).select("ctx", "w", (F.col("beta") * F.col("low")).alias("raw"), "total")
    return both.select("ctx", "w", "raw", "total").unionByName(unseen).withColumnRenamed("total", "support")


def pruned_trigrams(counts: DataFrame, least: int = LEAST, k: int = FOLLOWERS, delta: float = DELTA, textbook: bool = False) -> DataFrame:
    """Observed followers that tell more than the backoff does: p(w1 w2 w) * |ln p - ln(beta * backoff)| > delta. Without a
    backoff estimate a follower stays, if its joint probability is positive."""
    p1 = unigram_mle(of_order(counts, 1)).select(F.col("w").alias("ctx"), F.col("p").alias("p1"))
    pairs = _discounted(counts, 2, textbook=textbook).where(F.col("count") >= least)  # a context is as rare as its two words at least
    joint = pairs.join(hashed(p1), "ctx").select(F.concat_ws(" ", "ctx", "w").alias("ctx"), (F.col("raw") * F.col("p1")).alias("joint"))
    both = _with_backoff(counts, _short_backoff(counts, k, textbook), least, textbook).join(hashed(joint), "ctx")
    # in the order of top lists, so a context is dealt and sorted once for its sums and its ranks
    of = Window.partitionBy("ctx")
    beta = _share(F.col("total"), F.sum("dc").over(of), F.sum(F.coalesce("low", F.lit(0.0))).over(of))
    rows = both.sortWithinPartitions("ctx", F.desc("raw"), "w").withColumn("beta", beta).withColumn("bo", F.col("beta") * F.coalesce("low", F.lit(0.0)))
    told = F.when(F.col("bo") <= 0, F.lit(float("inf"))).otherwise(F.abs(F.log("raw") - F.log(F.greatest("bo", F.lit(1e-300)))))
    keep = (F.col("joint") > 0) & (F.col("joint") * F.col("raw") * told > delta)
    return rows.where(keep).select("ctx", "w", "raw", F.col("total").alias("support"))


def log_ratio(counts: DataFrame, pairs: int) -> DataFrame:
    """The `pairs` most frequent bigrams, scored ln(count + 1) / ln(total + 1) by the totals of those."""
    kept = of_order(counts, 2).orderBy(F.desc("count"), "ctx", "w").limit(pairs)
    total = F.sum("count").over(Window.partitionBy("ctx"))
    return kept.select("ctx", "w", (F.log(F.col("count") + 1) / F.log(total + 1)).alias("raw"), total.alias("support"))


def discounted_unigram(counts: DataFrame, stop: DataFrame, d: float = DISCOUNT, penalty: float = 0.5, least: int = 1) -> DataFrame:
    """(ctx, w, raw, support): absolute discounting with unigram backoff, stop words (w) at `penalty` of their score."""
    uni = unigram_mle(of_order(counts, 1)).select("w", "p")
    rows = with_totals(counts, 2, least).join(uni, "w", "left").join(stop.withColumn("stop", F.lit(True)), "w", "left")
    scored = _kn(rows, F.coalesce("p", F.lit(0.0)), d)
    return scored.select("ctx", "w", F.when(F.col("stop"), F.col("raw") * penalty).otherwise(F.col("raw")).alias("raw"), F.col("total").alias("support"))
