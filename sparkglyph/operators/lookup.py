"""Batches of suggestion requests, answered as joins with models and word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PACK_SHARE, USER_SHARE, LEAST_DEE = 0.7, 0.3, 3.0
#: Letters of the longest word; a longer query by more than two has no match.
LONGEST = 30


def _first(rows: DataFrame, key: str, n: int, *order) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def next_words(requests: DataFrame, model: DataFrame, n: int = 5) -> DataFrame:
    """(request_id, place, w, support): followers of `ctx` that begin with `prefix` (case aside), filtered before the cut."""
    rows = requests.select("request_id", "ctx", "prefix").join(model, "ctx").where(F.col("w").startswith(F.lower("prefix")))
    return _first(rows, "request_id", n, "rank").select("request_id", "place", "w", "support")


def support(requests: DataFrame, model: DataFrame) -> DataFrame:
    known = model.groupBy("ctx").agg(F.max("support").alias("support"))
    return requests.select("request_id", "ctx").join(known, "ctx", "left").select("request_id", F.coalesce("support", F.lit(0)).alias("support"))


def cascade(requests: DataFrame, trigrams: DataFrame, bigrams: DataFrame, n: int = 5) -> DataFrame:
    """(request_id, place, w) by both tiers. requests: request_id, w1, w2, prefix. One tier with answers stands as it is; two
    vote, weighted by support and place, and words of the context are out."""
    tiers = [
        next_words(requests.select("request_id", F.concat_ws(" ", "w1", "w2").alias("ctx"), "prefix"), trigrams, n).withColumn("tier", F.lit(0)),
        next_words(requests.select("request_id", F.col("w2").alias("ctx"), "prefix"), bigrams, n).withColumn("tier", F.lit(1)),
    ]
    answers = tiers[0].unionByName(tiers[1])
    per = answers.groupBy("request_id", "tier").agg(F.count("*").alias("many"), F.max("support").alias("of"))
    both = per.groupBy("request_id").agg(F.count("*").alias("tiers"), F.greatest(F.sum("of"), F.lit(1)).alias("all_of"))
    votes = answers.join(per, ["request_id", "tier"]).join(both, "request_id").withColumn("vote", F.col("support") * (F.col("many") - F.col("place") + 1))
    # votes are whole numbers until the one division, so their order is the same in any order of adding
    total = votes.groupBy("request_id", "w").agg(F.sum("vote").alias("votes"), F.max("tiers").alias("tiers"), F.min(F.struct("tier", "place")).alias("at"))
    rows = total.join(requests.select("request_id", "w1", "w2"), "request_id").where((F.col("tiers") == 1) | ((F.col("w") != F.col("w1")) & (F.col("w") != F.col("w2"))))
    by = F.when(F.col("tiers") == 1, F.lit(0)).otherwise(-F.col("votes"))
    return _first(rows, "request_id", n, by, "at.tier", "at.place").select("request_id", "place", "w")


def completions(prefixes: DataFrame, words: DataFrame, n: int = 5) -> DataFrame:
    """(prefix, place, w): the best words (w, count) with each prefix. Words meet prefixes by the prefix itself, an equi-join."""
    long = prefixes.select(F.lower("prefix").alias("prefix")).where("prefix <> ''").distinct()
    sizes = F.sequence(F.lit(1), F.length("w"))
    parts = words.select("w", "count", F.explode(F.transform(sizes, lambda k: F.substring("w", F.lit(1), k))).alias("prefix"))
    return _first(parts.join(long, "prefix"), "prefix", n, F.desc("count"), "w").select("prefix", "place", "w")


def edit_budget(word: Column) -> Column:
    size = F.length(word)
    return F.when(size <= 3, 0).when(size == 4, 1).otherwise(2)


def _deletions(word: Column, most: Column) -> Column:
    """All strings that `word` becomes by deleting up to `most` (0 to 2) letters."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    one = F.when((most >= 1) & (F.length(word) > 0), once(word)).otherwise(F.array().cast("array<string>"))
    two = F.when(most >= 2, F.flatten(F.transform(F.filter(one, lambda x: F.length(x) > 0), once))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


def close_words(queries: DataFrame, words: DataFrame) -> DataFrame:
    """(query, w, count, distance, common): words within the budget of edits. Two strings within k edits share a string that each
    becomes by at most k deletions, so candidates come by an equi-join on deletions and Levenshtein's distance decides."""
    asked = queries.select(F.lower("query").alias("query")).where(F.length("query") <= LONGEST + 2).distinct().withColumn("budget", edit_budget(F.col("query")))
    left = asked.select("query", "budget", F.explode(_deletions(F.col("query"), F.col("budget"))).alias("key"))
    right = words.select("w", "count", F.explode(_deletions(F.col("w"), F.lit(2))).alias("key"))
    pairs = left.join(right, "key").select("query", "budget", "w", "count").distinct().withColumn("distance", F.levenshtein("query", "w")).where("distance <= budget")
    common = F.size(F.filter(F.sequence(F.lit(1), F.length("query")), lambda k: F.substring("query", F.lit(1), k) == F.substring("w", F.lit(1), k)))
    return pairs.withColumn("common", common)


def fuzzy(queries: DataFrame, words: DataFrame, n: int = 5) -> DataFrame:
    """(query, place, w, distance): the best of close_words."""
    return _first(close_words(queries, words), "query", n, "distance", F.desc("common"), F.desc("count"), "w").select("query", "place", "w", "distance")


def filled(first: DataFrame, then: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(key, place, w): `first` in its order, filled up from `then` with words that aren't there yet."""
    rows = first.select(key, "w", F.lit(0).alias("source"), "place").unionByName(then.select(key, "w", F.lit(1).alias("source"), "place"))
    best = rows.groupBy(key, "w").agg(F.min(F.struct("source", "place")).alias("at"))
    return _first(best, key, n, "at.source", "at.place").select(key, "place", "w")


def merged(queries: DataFrame, user: DataFrame, base: DataFrame, n: int = 5) -> DataFrame:
    """(query, place, w): completions of `query` by the user's words, then the base's; if fewer than n, the best fuzzy matches
    of both (the user's count holds) for the places left, without those that are there already. Word lists are (w, count)."""
    asked = queries.select(F.lower("query").alias("prefix")).distinct()
    exact = filled(completions(asked, user, n), completions(asked, base, n), "prefix", n).withColumnRenamed("prefix", "query")
    both = user.withColumn("own", F.lit(0)).unionByName(base.withColumn("own", F.lit(1)))
    words = both.groupBy("w").agg(F.min(F.struct("own", "count")).alias("best")).select("w", "best.count")
    close = fuzzy(asked.select(F.col("prefix").alias("query")).where(edit_budget(F.col("prefix")) > 0), words, n)
    had = exact.groupBy("query").agg(F.count("*").alias("had"))
    more = close.join(had, "query", "left").where(F.col("place") <= n - F.coalesce("had", F.lit(0))).join(exact.select("query", "w"), ["query", "w"], "left_anti")
    rows = exact.select("query", "w", F.lit(0).alias("source"), "place").unionByName(more.select("query", "w", F.lit(1).alias("source"), "place"))
    return _first(rows, "query", n, "source", "place").select("query", "place", "w")


def bigram_aware(requests: DataFrame, model: DataFrame, words: DataFrame, n: int = 5) -> DataFrame:
    """(request_id, place, w): followers of `ctx` with the prefix first, then the best n + 5 completions."""
    base = completions(requests.select("prefix"), words, n + 5).select(F.col("prefix").alias("lower"), "place", "w")
    base = requests.select("request_id", F.lower("prefix").alias("lower")).join(base, "lower")
    return filled(next_words(requests, model, n), base, "request_id", n)


def blended(pack: DataFrame, user: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(key, place, w, score): 0.7 of the pack's score and 0.3 of the user's, of the best 2n of each; tables (key, w, score),
    the user's with `dee`, which has to be 3 at least."""
    rows = _first(pack, key, 2 * n, F.desc("score"), "w").select(key, "w", (F.col("score") * PACK_SHARE).alias("part"))
    own = _first(user.where(F.col("dee") >= LEAST_DEE), key, 2 * n, F.desc("score"), "w").select(key, "w", (F.col("score") * USER_SHARE).alias("part"))
    both = rows.unionByName(own).groupBy(key, "w").agg(F.sum("part").alias("score"))
    return _first(both, key, n, F.desc("score"), "w").select(key, "place", "w", "score")


def first_completions(prefixes: DataFrame, words: DataFrame, n: int = 3) -> DataFrame:
    """(prefix, place, w): the alphabetically first longer words with each prefix."""
    long = prefixes.select(F.lower("prefix").alias("prefix")).where("prefix <> ''").distinct()
    parts = words.select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("k")).where("k < length(w) and k > 0")
    return _first(parts.select("w", F.left("w", F.col("k")).alias("prefix")).join(long, "prefix"), "prefix", n, "w").select("prefix", "place", "w")


def snippets(prefixes: DataFrame, store: DataFrame, n: int = 3) -> DataFrame:
    """(prefix, place, code, expansion): the first n of the store's (code, expansion) with an expansion and that prefix, by
    code; the empty prefix takes all."""
    rows = store.where("code rlike '^[a-z0-9_]+$' and expansion <> ''")
    parts = rows.select("code", "expansion", F.explode(F.sequence(F.lit(0), F.length("code"))).alias("k")).select("code", "expansion", F.left("code", F.col("k")).alias("prefix"))
    return _first(parts.join(prefixes.select("prefix").distinct(), "prefix"), "prefix", n, "code").select("prefix", "place", "code", "expansion")


def display_slots(typed: Column, words: Column, n: int = 3) -> Column:
    """The typed word first, then other suggestions; nothing typed: suggestions alone."""
    return F.slice(F.when(F.coalesce(typed, F.lit("")) == "", words).otherwise(F.concat(F.array(typed), F.array_remove(words, typed))), 1, n)
