"""Phrase mining and evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkglyph.functions.text import raw_words, without_pos

#: Phrases that count as few enough to broadcast.
FEW = 100_000


def candidates(rows: DataFrame, few: int = 3, many: int = 5) -> DataFrame:
    """(phrase, at): distinct lower-cased phrases of `few` to `many` words of letters and apostrophes, by first id."""
    words = raw_words(F.col("text"))
    kept = rows.select("item_id", words.alias("t")).where(F.size("t").between(few, many)).where(F.forall("t", lambda w: w.rlike("^[a-zA-Z']+$")))
    return kept.groupBy(F.lower(F.array_join("t", " ")).alias("phrase")).agg(F.min("item_id").alias("at"))


def runs(t: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Every run of these sizes of the words t, joined by blanks."""

    def of(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, made).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, sizes))


def windows(lines: DataFrame, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """(phrase): every run of words of these sizes, lower-cased, punctuation kept."""
    return lines.select(F.transform(raw_words(F.col("line")), F.lower).alias("t")).select(F.explode(runs(F.col("t"), sizes)).alias("phrase"))


def phrase_counts(lines: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, count) of phrases that occur; windows meet them by hash before anything is counted, where up to FEW phrases
    are broadcast."""
    phrases = phrases.select("phrase")
    few = phrases.limit(FEW + 1).count() <= FEW
    return windows(lines).join(F.broadcast(phrases) if few else phrases, "phrase", "left_semi").groupBy("phrase").agg(F.count("*").alias("count"))


def all_common(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with every word in `words` (w)."""
    each = phrases.select("phrase", F.explode(F.split("phrase", " ")).alias("w"))
    return phrases.join(each.join(words, "w", "left_anti").select("phrase").distinct(), "phrase", "left_anti")


def eval_cases(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, no, w1, w2, prefix, target): each word from the third on, with the two before it; a hash of place and key says
    whether nothing or the first letter was typed."""
    t = F.col("t")
    each = rows.select(key, F.transform(raw_words(F.col("text")), F.lower).alias("t")).where(F.size("t") >= 3)
    each = each.select(key, "t", F.explode(F.sequence(F.lit(3), F.size("t"))).alias("no"))
    out = each.select(key, "no", F.element_at(t, F.col("no") - 2).alias("w1"), F.element_at(t, F.col("no") - 1).alias("w2"), F.element_at(t, F.col("no")).alias("target"))
    typed = F.when((F.col(key) + F.col("no")) % 2 == 0, F.substring("target", 1, 1)).otherwise("")
    return out.where(F.col("target").rlike("^[a-z']+$")).withColumn("prefix", typed)


def pass_rate(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(typed, cases, passed) and their total (typed null): grouping sets over whether a letter was typed."""
    hit = answers.select("request_id", F.col("w").alias("target")).withColumn("hit", F.lit(1))
    rows = cases.select("request_id", "target", (F.col("prefix") != "").alias("typed")).join(hit, ["request_id", "target"], "left")
    return rows.rollup("typed").agg(F.count("*").alias("cases"), F.count("hit").alias("passed"))


def by_genre(rows: DataFrame, genre: str, key: str, n: int) -> DataFrame:
    """n rows of each genre, chosen by a hash of the key (a sampling operator)."""
    place = F.row_number().over(Window.partitionBy(genre).orderBy(F.md5(F.col(key).cast("string")), key))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def collapse_years(rows: DataFrame, first_year: int = 0) -> DataFrame:
    """(ngram, count) of (ngram, year, match_count): part-of-speech marks go, n-grams with anything but words too."""
    clean = rows.where(F.col("year") >= first_year).select(F.transform(F.split("ngram", " "), without_pos).alias("t"), "match_count")
    kept = clean.where(F.forall("t", lambda w: w.rlike("^[a-zA-Z']+$")))
    return kept.groupBy(F.array_join("t", " ").alias("ngram")).agg(F.sum("match_count").alias("count"))


def best_spelling(words: DataFrame) -> DataFrame:
    """(w, count): of spellings that differ in case only the highest count."""
    return words.groupBy(F.lower("w").alias("w")).agg(F.max("count").alias("count"))


def attached(phrases: DataFrame, words: DataFrame, contexts: DataFrame) -> DataFrame:
    """(phrase, status): attached where the phrase is a context of the model, oov where a word isn't in `words` (w), no_path
    else."""
    each = phrases.select("phrase", F.explode(F.split("phrase", " ")).alias("w"))
    out = each.join(words, "w", "left_anti").select("phrase").distinct().withColumn("oov", F.lit(True))
    there = contexts.select(F.col("ctx").alias("phrase")).distinct().withColumn("there", F.lit(True))
    status = F.when(F.col("oov"), "oov").when(F.col("there"), "attached").otherwise("no_path")
    return phrases.select("phrase").join(out, "phrase", "left").join(there, "phrase", "left").select("phrase", status.alias("status"))


def extensions(contexts: DataFrame, phrases: DataFrame, most: int = 3) -> DataFrame:
    """(ctx, phrase, count): phrases (phrase, count) that are a context or go on from it by `most` words at most."""
    t = F.split("phrase", " ")
    parts = phrases.select("phrase", "count", t.alias("t"), F.explode(F.sequence(F.greatest(F.lit(1), F.size(t) - most), F.size(t))).alias("k"))
    return parts.select(F.array_join(F.slice("t", 1, F.col("k")), " ").alias("ctx"), "phrase", "count").join(contexts.select("ctx").distinct(), "ctx")


def learned(commits: DataFrame, known: DataFrame) -> DataFrame:
    """(w, frequency) of (w, how): words of two letters or more that don't begin with ; are learned when tapped, and when
    flushed if they are known (w)."""
    rows = commits.where((F.length("w") > 1) & ~F.col("w").startswith(";")).join(known.select("w").distinct().withColumn("known", F.lit(True)), "w", "left")
    return rows.where((F.col("how") == "tap") | F.col("known")).groupBy("w").agg(F.count("*").alias("frequency"))
