"""Counts, models, packs and user tables kept as Parquet, written once and read by whatever needs them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = "WORDPACK", 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is named and Spark runs locally."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="store-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """The same rows from a table in the shared folder, so what they are made of is made once."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_counts(counts: DataFrame, folder: str) -> None:
    """(n, ctx, w, count), one folder an order; the writer sorts nothing it needn't."""
    counts.write.partitionBy("n").parquet(folder)


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A filter on n reads that order's files alone."""
    return spark.read.schema("ctx string, w string, count long, n int").parquet(folder).select("n", "ctx", "w", "count")


def counted(counts: DataFrame) -> DataFrame:
    """The counts from a store of their own: the corpus is read once however often they are used."""
    spark = counts.sparkSession
    folder = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    write_counts(counts, folder)
    return spark.read.schema(counts.schema).parquet(folder).select(counts.columns)


def write_model_json(model: DataFrame, folder: str) -> None:
    """One JSON object a line: {"ctx": .., "followers": [{"w": .., "score": ..}, ..], "support": n}, followers in rank order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "w", "score")))
    rows = model.groupBy("ctx").agg(F.transform(listed, lambda x: F.struct(x["w"].alias("w"), x["score"].alias("score"))).alias("followers"), F.max("support").alias("support"))
    rows.select(F.to_json(F.struct("ctx", "followers", "support")).alias("value")).write.text(folder)


def read_model_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema("ctx string, followers array<struct<w:string,score:double>>, support long").json(folder)
    return rows.select("ctx", "support", F.posexplode("followers").alias("at", "f")).select("ctx", (F.col("at") + 1).alias("rank"), "f.w", "f.score", "support")


def import_model_json(spark: SparkSession, path: str) -> DataFrame:
    """A model from files that hold one JSON object each: {"ctx": {"followers": [["w", score], ..], "support": n}, ..} or
    {"ctx": [["w", score], ..], ..} (support is then null)."""
    text = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", "map<string,struct<followers:array<array<string>>,support:long>>")
    flat = F.from_json("value", "map<string,array<array<string>>>")
    is_nested = F.col("value").rlike(r'(?s)^\s*\{\s*"[^"]*"\s*:\s*\{')
    rows = text.where(is_nested).select(F.explode(nested).alias("ctx", "m")).select("ctx", "m.followers", "m.support")
    rows = rows.unionByName(text.where(~is_nested).select(F.explode(flat).alias("ctx", "followers")).withColumn("support", F.lit(None).cast("long")))
    rows = rows.select("ctx", "support", F.posexplode("followers").alias("at", "f"))
    return rows.select("ctx", (F.col("at") + 1).alias("rank"), F.col("f")[0].alias("w"), F.col("f")[1].cast("double").alias("score"), "support")


def write_pack(folder: str, vocabulary: DataFrame, **tables: DataFrame) -> None:
    """A language pack: its vocabulary, its tables, and a header."""
    spark = vocabulary.sparkSession
    vocabulary.write.parquet(f"{folder}/vocabulary")
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    words = spark.read.parquet(f"{folder}/vocabulary").count()
    spark.createDataFrame([(MAGIC, VERSION, words)], "magic string, version int, words long").coalesce(1).write.parquet(f"{folder}/header")


def open_pack(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """(vocabulary, header); ValueError if this isn't a pack of this version, or if its word ids don't fit 16 bits."""
    header = spark.read.parquet(f"{folder}/header").first().asDict()
    if header["magic"] != MAGIC or header["version"] != VERSION or not 0 <= header["words"] <= 65_535:
        raise ValueError(f"{folder} isn't a pack of version {VERSION}: {header}")
    return spark.read.parquet(f"{folder}/vocabulary"), header
