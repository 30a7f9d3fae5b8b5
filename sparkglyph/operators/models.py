"""Comparing, capping and quantizing models, and the tables of a language pack. A model is (ctx, rank, w, score, support); what
compares best followers alone takes rows that aren't ranked, (ctx, w, raw, support), too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkglyph.sources.store import kept

THRESHOLDS = (3, 5, 10, 25, 50)
#: Scores that rounding brought to 0 count as this when their logarithm is taken.
FLOOR = 0.0001


def by_context(model: DataFrame) -> DataFrame:
    """(ctx, followers, support): followers in rank order; a context has at most as many as the model was cut to."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "w", "score")))
    return model.groupBy("ctx").agg(F.transform(listed, lambda x: x["w"]).alias("ws"), F.transform(listed, lambda x: x["score"]).alias("scores"), F.max("support").alias("support"))


def tops(model: DataFrame, name: str, k: int = 10) -> DataFrame:
    """(ctx, top word, followers, support), without collecting lists. Of rows without ranks (ctx, w, raw, support), what their
    top lists of `k` would give: the best is found on the map side, so nothing is ranked and few rows move."""
    if "rank" not in model.columns:
        best = F.min(F.struct((-F.col("raw")).alias("below"), "w"))["w"]
        return model.groupBy("ctx").agg(best.alias(f"top_{name}"), F.least(F.count("*"), F.lit(k)).alias(f"n_{name}"), F.max("support").alias(f"support_{name}"))
    return model.groupBy("ctx").agg(F.max(F.when(F.col("rank") == 1, F.col("w"))).alias(f"top_{name}"), F.count("*").alias(f"n_{name}"), F.max("support").alias(f"support_{name}"))


def compare_sweep(a: DataFrame, b: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, contexts, agree): contexts of both models with that support in a, and those with the same best follower."""
    both = tops(a, "a").join(tops(b, "b"), "ctx")
    rows = both.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), "top_a", "top_b", "support_a").where("support_a >= threshold")
    return rows.groupBy("threshold").agg(F.count("*").alias("contexts"), F.count_if(F.col("top_a") == F.col("top_b")).alias("agree"))


def identical_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: contexts in both, those whose followers are the same in the same order, and those with the same best one."""
    both = by_context(a).select("ctx", F.col("ws").alias("wa")).join(by_context(b).select("ctx", F.col("ws").alias("wb")), "ctx")
    return both.agg(F.count("*").alias("contexts"), F.count_if(F.col("wa") == F.col("wb")).alias("identical"), F.count_if(F.element_at("wa", 1) == F.element_at("wb", 1)).alias("agree"))


def three_way(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """(in_a, in_b, in_c, contexts, followers of each) over all contexts of any."""
    rows = tops(a, "a").join(tops(b, "b"), "ctx", "full_outer").join(tops(c, "c"), "ctx", "full_outer")
    has = [F.col(f"n_{x}").isNotNull().alias(f"in_{x}") for x in "abc"]
    return rows.groupBy(*has).agg(F.count("*").alias("contexts"), *[F.coalesce(F.sum(f"n_{x}"), F.lit(0)).alias(f"followers_{x}") for x in "abc"])


def dropped_contexts(a: DataFrame, b: DataFrame) -> DataFrame:
    return tops(a, "a").join(b.select("ctx").distinct(), "ctx", "left_anti").select("ctx", F.col("top_a").alias("top"), F.col("support_a").alias("support"))


def top_disagreements(a: DataFrame, b: DataFrame, k: int = 20) -> DataFrame:
    """The k contexts of most support (a top-k report) whose best followers differ."""
    both = tops(a, "a").join(tops(b, "b"), "ctx").where("top_a <> top_b")
    return both.orderBy(F.desc("support_a"), "ctx").limit(k).select("ctx", "top_a", "top_b", F.col("support_a").alias("support"))


def follower_stats(model: DataFrame, k: int = 10) -> DataFrame:
    n = tops(model, "a")
    return n.agg(F.count("*").alias("contexts"), F.sum("n_a").alias("followers"), F.min("n_a").alias("fewest"), F.max("n_a").alias("most"), F.round(F.avg("n_a"), 6).alias("mean"), F.count_if(F.col("n_a") == k).alias("full"))


def top_words(unigrams: DataFrame, k: int) -> DataFrame:
    return unigrams.orderBy(F.desc("count"), "w").limit(k).select("w")


def vocab_cap(model: DataFrame, words: DataFrame) -> DataFrame:
    """One row of what is left when followers have to be in `words`. words: (w), as many as the cap says."""
    held = model.join(words.withColumn("held", F.lit(True)), "w", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    per = held.groupBy("ctx").agg(F.count("*").alias("n"), F.count_if("held").alias("kept"), F.max(F.when(F.col("rank") == 1, F.col("held"))).alias("top"))
    out = held.groupBy("w").agg(F.max("held").alias("held")).agg(F.count("*").alias("distinct_words"), F.count_if(~F.col("held")).alias("distinct_outside"))
    sums = per.agg(F.count("*").alias("contexts"), F.count_if(F.col("kept") == 0).alias("emptied"), F.sum("n").alias("followers"), F.sum(F.col("n") - F.col("kept")).alias("dropped"), F.count_if("top").alias("agree"))
    return sums.join(F.broadcast(out))


def capped(model: DataFrame, words: DataFrame) -> DataFrame:
    """The model with followers in `words` only, ranks counted anew; emptied contexts are gone."""
    rank = F.row_number().over(Window.partitionBy("ctx").orderBy("rank"))
    return model.join(words, "w", "left_semi").withColumn("rank", rank).select("ctx", "rank", "w", "score", "support")


def score_range(model: DataFrame, log: bool = True) -> DataFrame:
    x = F.log10(F.greatest("score", F.lit(FLOOR))) if log else F.col("score")
    return model.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))


def as_byte(x: Column, lo: Column, hi: Column) -> Column:
    scaled = F.bround((x - lo) / F.when(hi > lo, hi - lo).otherwise(1.0) * 255, 0)
    return F.when(hi == lo, 255).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled))).cast("int")


def quantized(model: DataFrame, log: bool = True) -> DataFrame:
    """The model with `byte` in place of nothing else; the range is one row."""
    x = F.log10(F.greatest("score", F.lit(FLOOR))) if log else F.col("score")
    return model.join(F.broadcast(score_range(model, log))).withColumn("byte", as_byte(x, F.col("lo"), F.col("hi"))).drop("lo", "hi")


def dequantized(byte: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi == lo, 1.0).otherwise(F.pow(F.lit(10.0), lo + byte / 255.0 * (hi - lo)))


def quantization_flips(model: DataFrame, log: bool = True) -> DataFrame:
    """One row: neighbours in rank whose order their bytes turn round, and those whose bytes tie though their scores don't."""
    w = Window.partitionBy("ctx").orderBy("rank")
    rows = quantized(model, log).withColumn("next_byte", F.lead("byte").over(w)).withColumn("next_score", F.lead("score").over(w)).where("next_byte is not null")
    return rows.agg(F.count("*").alias("neighbours"), F.count_if(F.col("next_byte") > F.col("byte")).alias("flips"), F.count_if((F.col("next_byte") == F.col("byte")) & (F.col("next_score") < F.col("score"))).alias("ties"))


def vocabulary(unigrams: DataFrame, size: int = 65_535) -> DataFrame:
    """(word_id, w, freq_byte) of the `size` most frequent words; ids by word order. Ranks over the vocabulary table alone."""
    kept = unigrams.orderBy(F.desc("count"), "w").limit(size)
    most = unigrams.agg(F.max("count").alias("most"))
    byte = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.bround(F.col("count") / F.col("most") * 255, 0))).cast("int")
    return kept.join(F.broadcast(most)).select((F.row_number().over(Window.orderBy("w")) - 1).alias("word_id"), "w", byte.alias("freq_byte"))


def pack_followers(model: DataFrame, vocab: DataFrame) -> DataFrame:
    """(ctx_id, pos, word_id, byte) of a bigram model; contexts and followers out of the vocabulary are gone."""
    ids = vocab.select("word_id", "w")
    rows = quantized(model).join(ids, "w").join(ids.select(F.col("word_id").alias("ctx_id"), F.col("w").alias("ctx")), "ctx")
    return rows.select("ctx_id", (F.row_number().over(Window.partitionBy("ctx_id").orderBy("rank")) - 1).alias("pos"), "word_id", "byte")


def word_scores(unigrams: DataFrame) -> DataFrame:
    most = unigrams.agg(F.max("count").alias("most"))
    return unigrams.join(F.broadcast(most)).select("w", F.greatest(F.lit(1.0), F.round(F.col("count") / F.col("most") * 1_000_000, 0)).cast("long").alias("score"))


def rescored(model: DataFrame, stop: DataFrame, penalty: float = 0.5) -> DataFrame:
    """Stop words at `penalty` of their score; a stable order, so ties keep their old rank. stop: (w)."""
    marked = model.join(stop.withColumn("stop", F.lit(True)), "w", "left")
    rows = marked.withColumn("score", F.when(F.col("stop"), F.col("score") * penalty).otherwise(F.col("score")))
    rank = F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("score"), "rank"))
    return rows.withColumn("rank", rank).select("ctx", "rank", "w", "score", "support")


def cap_agreement(model: DataFrame, caps: tuple[int, ...] = (1, 3, 5, 10), log: bool = True) -> DataFrame:
    """(cap, contexts, flips, ties): contexts whose `cap` best followers come in another order by their bytes (equal bytes
    keep the old order), and contexts with equal bytes."""
    again = F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("byte"), "rank"))
    rows = quantized(model, log).withColumn("again", again)
    per = rows.groupBy("ctx").agg(F.min(F.when(F.col("again") != F.col("rank"), F.least("again", "rank"))).alias("first"), (F.count("*") > F.count_distinct("byte")).alias("tie"))
    each = per.select(F.explode(F.array(*map(F.lit, caps))).alias("cap"), "first", "tie")
    return each.groupBy("cap").agg(F.count("*").alias("contexts"), F.count_if(F.col("first") <= F.col("cap")).alias("flips"), F.count_if("tie").alias("ties"))


def serialized_size(model: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, contexts, bytes) of the model as one compact JSON object of contexts with that support: "ctx":{"followers":
    [["w",score],...],"support":n}. Scores have four places at most, without zeros at the end but one."""
    score = F.regexp_replace(F.regexp_replace(F.col("score").cast("decimal(6,4)").cast("string"), "0+$", ""), r"\.$", ".0")
    per = model.groupBy("ctx").agg(F.sum(F.octet_length("w") + F.length(score) + 6).alias("inner"), F.max("support").alias("support"))
    size = F.octet_length("ctx") + F.col("inner") - 1 + F.length(F.col("support").cast("string")) + len('"":{"followers":[],"support":}')
    each = per.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), "support", size.alias("size")).where("support >= threshold")
    return each.groupBy("threshold").agg(F.count("*").alias("contexts"), (F.sum("size") + F.count("*") + 1).alias("bytes"))


def root_followers(unigrams: DataFrame, k: int = 255) -> DataFrame:
    """(rank, w, score, support) of the k most frequent words; support: occurrences of these k."""
    top = unigrams.orderBy(F.desc("count"), "w").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("count"), "w"))  # over the k rows alone
    sums = top.agg(F.max("count").alias("most"), F.sum("count").alias("support"))
    return top.withColumn("rank", place).join(F.broadcast(sums)).select("rank", "w", (F.col("count") / F.col("most")).alias("score"), "support")


def all_words(unigrams: DataFrame, *models: DataFrame) -> DataFrame:
    """(w, count): words of contexts, followers and unigrams, with their count or 0."""
    found = unigrams.select("w", "count")
    for m in models:
        for words in (m.select(F.explode(F.split("ctx", " ")).alias("w")), m.select("w")):
            found = found.unionByName(words.distinct().withColumn("count", F.lit(0).cast("long")))
    return found.groupBy("w").agg(F.max("count").alias("count"))


def pack_trigrams(model: DataFrame, vocab: DataFrame) -> DataFrame:
    """(ctx_id1, ctx_id2, pos, word_id, byte) of a trigram model; contexts with a word out of the vocabulary are gone, and
    such followers."""
    ids = vocab.select("word_id", "w")
    first, second = (ids.select(F.col("word_id").alias(f"ctx_id{k}"), F.col("w").alias(f"c{k}")) for k in (1, 2))
    rows = quantized(model).withColumn("c1", F.substring_index("ctx", " ", 1)).withColumn("c2", F.substring_index("ctx", " ", -1))
    rows = rows.join(ids, "w").join(first, "c1").join(second, "c2")
    return rows.select("ctx_id1", "ctx_id2", (F.row_number().over(Window.partitionBy("ctx_id1", "ctx_id2").orderBy("rank")) - 1).alias("pos"), "word_id", "byte")


def word_ranks(unigrams: DataFrame) -> DataFrame:
    """(w, rank) by count and word, without bringing the vocabulary into one task: ranks within sorted ranges of it, plus the
    sizes of the ranges before (one row each)."""
    ordered = unigrams.repartitionByRange(F.desc("count"), F.asc("w")).sortWithinPartitions(F.desc("count"), "w")
    part = F.spark_partition_id()
    placed = ordered.select("w", part.alias("part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("at"))
    placed = kept(placed, "ranks")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").select("w", (F.col("before") + F.col("at") + 1).alias("rank"))
