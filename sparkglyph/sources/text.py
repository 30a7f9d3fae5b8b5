"""Text sources, with what happens to rows that don't fit said for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkglyph.functions.text import base_emoji, plain_typography, raw_words, sentences, without_mentions

#: Classes of chat posts that aren't talk, and what stands between the fields of a dialogue line.
NO_TALK, BETWEEN = ("System", "Emotion", "Accept", "Reject"), " +++$+++ "


def lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(line) of text files, plain or gzipped, split at line ends; the first `most` of them, if given (an early stop)."""
    rows = spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")
    return rows if most is None else rows.limit(most)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; lines that aren't are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def dictionary_entries(spark: SparkSession, path: str) -> DataFrame:
    """(word, pos, gloss) of JSON lines; gloss: the first of the first sense, or empty."""
    rows = json_lines(spark, path, "word string, pos string, senses array<struct<glosses:array<string>>>")
    gloss = F.get(F.get("senses", F.lit(0))["glosses"], F.lit(0))
    return rows.select(F.coalesce("word", F.lit("")).alias("word"), F.coalesce("pos", F.lit("")).alias("pos"), F.coalesce(gloss, F.lit("")).alias("gloss"))


def tsv(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """Lines cut at tabs; those with more or fewer fields are dropped."""
    rows = lines(spark, path).select(F.split("line", "\t", -1).alias("f")).where(F.size("f") == len(names))
    return rows.select(*[F.col("f")[k].alias(name) for k, name in enumerate(names)])


def counts_strict(spark: SparkSession, path: str) -> DataFrame:
    """(w, count) of lines word, tab, count; blank lines and those that begin with # are passed over, any other line that
    isn't a word and a positive count is an error."""
    rows = lines(spark, path).select(F.trim("line").alias("line")).where("line <> '' and not startswith(line, '#')").select("line", F.split("line", "\t", -1).alias("f"))
    count = F.expr("try_cast(f[1] as long)")
    bad = F.raise_error(F.concat(F.lit("expected a word, a tab and a count above 0: "), "line")).cast("long")
    return rows.select(F.col("f")[0].alias("w"), F.when((F.size("f") == 2) & F.coalesce(count > 0, F.lit(False)), count).otherwise(bad).alias("count"))


def pair_counts(spark: SparkSession, path: str) -> DataFrame:
    """(ctx, w, count) of lines "w1 w2", tab, count, added up; lines without two clean words and a count are dropped."""
    rows = lines(spark, path).select(F.trim("line").alias("line"))
    rows = rows.select(F.lower(F.regexp_extract("line", r"^(.*)\t([^\t]*)$", 1)).alias("pair"), F.expr(r"try_cast(regexp_extract(line, '^(.*)\t([^\t]*)$', 2) as long)").alias("count"))
    rows = rows.select(raw_words(F.col("pair")).alias("t"), "count").where("count is not null and size(t) = 2").where(F.forall("t", lambda w: w.rlike("^[a-z']{1,30}$")))
    return rows.groupBy(F.col("t")[0].alias("ctx"), F.col("t")[1].alias("w")).agg(F.sum("count").alias("count"))


def frequency_list(spark: SparkSession, path: str, least: int = 1, most: int = 100_000) -> DataFrame:
    """(w, count) of lines word, blanks, count: words of 2 to 20 letters with `least` uses, the `most` most frequent."""
    rows = lines(spark, path).select(raw_words(F.col("line")).alias("f")).where("size(f) >= 2")
    rows = rows.select(F.lower(F.col("f")[0]).alias("w"), F.expr("try_cast(f[1] as long)").alias("count")).where(r"w rlike '^\\p{L}{2,20}$'")
    return rows.where(F.col("count") >= least).orderBy(F.desc("count"), "w").limit(most)


def emoji_test(spark: SparkSession, path: str) -> DataFrame:
    """(category, category_no, place, base, variants) of a Unicode emoji test file: fully qualified emoji by the group header
    before them, in the file's order, variants of skin tone under their base. The file is a small list, read whole."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.split("value", "\r?\n")).alias("no", "line"))
    order = Window.orderBy("no")
    header = F.when(F.col("line").startswith("# group:"), F.trim(F.expr("substr(line, 9)")))
    rows = rows.withColumn("category", F.last(header, ignorenulls=True).over(order)).withColumn("category_no", F.count(header).over(order))
    pattern = r"^([0-9A-F ]+)\s*;\s*(\S+)\s*#\s*(\S+)"
    rows = rows.where(~F.col("line").startswith("#") & (F.regexp_extract("line", pattern, 2) == "fully-qualified") & F.col("category").isNotNull())
    rows = rows.select("category", "category_no", "no", F.regexp_extract("line", pattern, 3).alias("emoji")).withColumn("base", base_emoji(F.col("emoji")))
    group = ["category", "category_no", "base"]
    plain = F.min(F.when(F.col("emoji") == F.col("base"), F.col("no")))
    made = rows.groupBy(*group).agg(plain.alias("place"), F.array_sort(F.collect_list(F.when(F.col("emoji") != F.col("base"), F.struct("no", "emoji")))).alias("v"))
    made = made.where("place is not null").withColumn("v", F.filter("v", lambda x: x["no"] > F.col("place")))
    return made.select("category", "category_no", "place", "base", F.transform("v", lambda x: x["emoji"]).alias("variants"))


def chat_posts(spark: SparkSession, path: str, least_words: int = 4) -> DataFrame:
    """(sentence) of XML chat posts: talk alone, mentions and typography cleaned."""
    posts = spark.read.format("xml").option("rowTag", "Post").schema("_class string, _VALUE string").load(path)
    talk = posts.where(~F.coalesce(F.col("_class"), F.lit("")).isin(*NO_TALK))
    said = talk.select(plain_typography(without_mentions(F.coalesce("_VALUE", F.lit("")))).alias("sentence"))
    return said.where(F.size(raw_words(F.col("sentence"))) >= least_words)


def dialogue_sentences(spark: SparkSession, path: str, least_words: int = 6) -> DataFrame:
    """(sentence) of dialogue lines with five fields, ISO-8859-1; other lines are dropped."""
    rows = spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").schema("line string").csv(path)
    said = rows.select(F.split("line", rf"\Q{BETWEEN}\E", -1).alias("f")).where("size(f) = 5").select(F.explode(sentences(plain_typography(F.col("f")[4]))).alias("sentence"))
    return long_sentences(said, F.col("sentence"), least_words)


def long_sentences(rows: DataFrame, sentence: Column, least_words: int = 6) -> DataFrame:
    return rows.where(F.size(raw_words(sentence)) >= least_words)
