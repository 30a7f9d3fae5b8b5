"""N-gram counts and what follows from them, as (n, ctx, w, count) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkglyph.functions.text import tokens
from sparkglyph.sources.store import kept


def _windows(most: int) -> Column:
    """Array of w1 to w`most` from each place of a line's tokens `t` on, null beyond the line's end."""
    return F.arrays_zip(*[(F.slice("t", k, F.size("t")) if k > 1 else F.col("t")).alias(f"w{k}") for k in range(1, most + 1)])


#: Contexts that count as few enough to broadcast.
FEW = 100_000


def few(rows: DataFrame) -> DataFrame | None:
    """The rows, to be broadcast, if there are up to FEW of them."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else None


def ngrams(lines: DataFrame, orders: tuple[int, ...] = (1, 2, 3), asked: dict[int, DataFrame] | None = None) -> DataFrame:
    """(n, ctx, w), a row for each place of rows (line). asked: by order, the contexts (ctx, distinct) whose n-grams are
    enough; others go, as long as these are few."""
    words = lines.select(tokens(F.col("line")).alias("t"))  # a filter on t would be pushed below, and cut each line twice
    places = words.select(F.inline(_windows(max(orders))))
    gram = lambda n: F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *[f"w{k}" for k in range(1, n)]).alias("ctx"), F.col(f"w{n}").alias("w"))
    grams = places.select(F.inline(F.array(*map(gram, orders)))) if len(orders) > 1 else places.select(gram(orders[0]).alias("g")).select("g.*")
    grams = grams.where("w is not null")
    for n, only in (asked or {}).items():
        if (only := few(only)) is not None:
            grams = grams.join(only.withColumn("asked", F.lit(True)), "ctx", "left").where((F.col("n") != n) | F.col("asked")).drop("asked")
    return grams


def ngram_counts(lines: DataFrame, orders: tuple[int, ...] = (1, 2, 3), asked: dict[int, DataFrame] | None = None) -> DataFrame:
    """(n, ctx, w, count) over rows (line). One pass and one shuffle, counted on the map side first, so frequent n-grams
    cost one row a task."""
    return ngrams(lines, orders, asked).groupBy("n", "ctx", "w").agg(F.count("*").alias("count"))


def totalled_counts(lines: DataFrame, orders: tuple[int, ...] = (1, 2, 3), asked: dict[int, DataFrame] | None = None) -> DataFrame:
    """ngram_counts with the `total` and `distinct_n` of each context, null for order 1. Of several orders, rows go to the place
    of their context at once, so counts and totals come of one shuffle. Of one order, they are counted on the map side and only
    kinds go to their context, so a frequent context isn't one task's work. Single words, which share a context, are counted
    by themselves."""
    more = tuple(n for n in orders if n > 1)
    parts = []
    if more:
        grams = ngrams(lines, more, asked)
        grams = grams if len(more) == 1 else grams.repartition("n", "ctx")  # n of one order is a literal, which isn't dealt by
        counts = grams.groupBy("n", "ctx", "w").agg(F.count("*").alias("count"))
        of = Window.partitionBy("n", "ctx")
        parts.append(counts.withColumns({"total": F.sum("count").over(of), "distinct_n": F.count("*").over(of)}))
    if 1 in orders:
        none = F.lit(None).cast("long")
        parts.append(ngram_counts(lines, (1,)).withColumns({"total": none, "distinct_n": none}))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def placed(lines: DataFrame) -> DataFrame:
    """(ctx, w, count, total, distinct_n, pairs, head) over rows (line), of one shuffle: a trigram's context and last word, with
    the totals of the context and how often its two words stand together. Where a line ends, w is null, and ctx is a word
    if none follows. head: one row of each ctx."""
    words = lines.select(tokens(F.col("line")).alias("t"))
    rows = words.select(F.inline(_windows(3))).select(F.concat_ws(" ", "w1", "w2").alias("ctx"), F.col("w3").alias("w"))
    counts = rows.repartition("ctx").groupBy("ctx", "w").agg(F.count("*").alias("count"))
    of = Window.partitionBy("ctx")
    sums = {"total": F.sum(F.when(F.col("w").isNotNull(), F.col("count"))).over(of), "distinct_n": F.count("w").over(of), "pairs": F.sum("count").over(of)}
    return counts.withColumns(sums | {"head": F.col("w").eqNullSafe(F.max("w").over(of))})


def three_orders(lines: DataFrame) -> DataFrame:
    """totalled_counts of orders 1 to 3, stored. Each place of a line is dealt once, as its trigram; words and bigrams are counted
    from the kinds of contexts that come of that."""
    rows = kept(placed(lines), "places")
    second = F.when(F.col("ctx").contains(" "), F.substring_index("ctx", " ", -1))
    heads = rows.where("head").select(F.substring_index("ctx", " ", 1).alias("ctx"), second.alias("w"), F.col("pairs").alias("count"))
    of = Window.partitionBy("ctx")
    twos = heads.where("w is not null").withColumns({"total": F.sum("count").over(of), "distinct_n": F.count("*").over(of)})
    ones = heads.groupBy("ctx").agg(F.sum("count").alias("count"))
    none = F.lit(None).cast("long")
    parts = (
        kept(ones, "words").select(F.lit(1).alias("n"), F.lit("").alias("ctx"), F.col("ctx").alias("w"), "count", none.alias("total"), none.alias("distinct_n")),
        kept(twos, "bigrams").select(F.lit(2).alias("n"), "ctx", "w", "count", "total", "distinct_n"),
        rows.where("w is not null").select(F.lit(3).alias("n"), "ctx", "w", "count", "total", "distinct_n"),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def of_order(counts: DataFrame, n: int) -> DataFrame:
    return counts.where(F.col("n") == n).select("ctx", "w", "count")


def context_totals(grams: DataFrame) -> DataFrame:
    """(ctx, total, distinct_n) of (ctx, w, count)."""
    return grams.groupBy("ctx").agg(F.sum("count").alias("total"), F.count("*").alias("distinct_n"))


def with_totals(counts: DataFrame, n: int, least: int = 1, only: DataFrame | None = None) -> DataFrame:
    """(ctx, w, count, total, distinct_n) of contexts with `least` occurrences, of those in `only` (ctx, distinct), if given."""
    rows = counts.where(F.col("n") == n)
    rows = rows if only is None else rows.join(only, "ctx", "left_semi")
    if "total" not in counts.columns:
        rows = rows.select("ctx", "w", "count").join(context_totals(rows), "ctx")
    return rows.where(F.col("total") >= least).select("ctx", "w", "count", "total", "distinct_n")


def continuation(bigrams: DataFrame) -> DataFrame:
    """(w, p): the share of bigram types that end in w. The total is one row."""
    types = bigrams.agg(F.count("*").alias("types"))
    return bigrams.groupBy("w").agg(F.count("*").alias("k")).join(F.broadcast(types)).select("w", (F.col("k") / F.col("types")).alias("p"))


def unigram_mle(unigrams: DataFrame) -> DataFrame:
    all_of = unigrams.agg(F.sum("count").alias("all"))
    return unigrams.join(F.broadcast(all_of)).select("w", "count", (F.col("count") / F.col("all")).alias("p"))


def count_of_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n", F.col("count").alias("r")).agg(F.count("*").alias("types"))
