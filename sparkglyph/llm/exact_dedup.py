"""Exact deduplication with streaming state.

Digests of the texts, with id, size and content locator (a hash of the file's path, and the row in it), are a table that
Structured Streaming reads. The stream's state, kept in RocksDB and checkpointed to the shared folder, holds per digest the
row that stays and how many rows came; it never expires. A digest that came more than once is a hit: the bytes of its rows
are then compared in full with those of the row that stays, fetched by its locator. Digests found to stand for different
bytes are noted, and their rows are grouped by their bytes instead.

With a `state` folder that lasts, a later run over other tables goes on from there: sizes and kept rows are those after all
runs so far, and rows of earlier runs are read again by locator where bytes have to be compared, so their Parquet files have
to be where they were. The folder holds `log` (the stream's checkpoint and state), `digests` (all runs' rows), `files` (paths
by their hash) and `mixed` (digests that stand for different bytes).

Everything is DataFrame operations; no Python runs on executors.

Defined cases: null and empty texts are equal to each other and to texts of white space only; of repeated rows exactly one
stays; a row with a null doc_id stays only if all rows of its group have none of that size; any long is a doc_id. Extra
columns are ignored, or kept as they are by drop_duplicates. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import documents, few_bytes, few_rows, located, locator, matching, without, work_path, written

_SPACES = " \t\n\x0b\x0c\r"
_STORE = "spark.sql.streaming.stateStore."
#: State in RocksDB: one bounded cache for all partitions of an executor, no megabytes reserved ahead for the logs of small
#: ones, and partitions of a stream that has ended are closed soon.
_SETTINGS = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}rocksdb.allowFAllocate": "false",
    f"{_STORE}rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}rocksdb.maxMemoryUsageMB": "128",
    f"{_STORE}rocksdb.writeBufferSizeMB": "4",
    f"{_STORE}maintenanceInterval": "5s",
}
_DIGESTS = "run string, doc_id long, file long, row long, digest binary, sha binary, size int, rank long"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _SPACES, "")


def retain(spark: SparkSession, state: str) -> DataFrame:
    """Feeds what is new in the digests of the state folder to the stream; returns (digest, best (size, rank, file, row), n)."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(_DIGESTS).parquet(f"{state}/digests")
        best = F.max(F.struct("size", "rank", "file", "row"))
        kept = stream.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))
        kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start().awaitTermination()
        held = spark.read.format("statestore").load(f"{state}/log")
        held = held.select(F.col("key.digest").alias("digest"), F.col("value.max").alias("best"), F.col("value.count").alias("n"))
        return written(held, "held")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _texts(spark: SparkSession, state: str, rows: DataFrame) -> DataFrame:
    """rows (file, row, and more) with `norm`, read from their files; as many paths come to the driver as there are files."""
    files = spark.read.parquet(f"{state}/files").join(rows.select("file").distinct(), "file", "left_semi")
    paths = sorted({r.path for r in files.select("path").distinct().collect()})
    if not paths:
        return rows.withColumn("norm", F.lit(""))
    read = spark.read.schema("text string").parquet(*paths)
    return read.select(*locator(), normalised(F.col("text")).alias("norm")).join(few_rows(rows), ["file", "row"])


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def exact_duplicates(docs: DataFrame, digest=lambda text: F.unhex(F.sha2(text, 256)), state: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, file, row, text_sha256) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = located(docs)
    state, run = state or work_path(spark, "state"), uuid.uuid4().hex
    earlier = _there(spark, f"{state}/digests") is not None
    text = normalised(F.col("text"))
    size = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rank = F.bitwise_not(F.col("doc_id").cast("long"))  # the smaller the id, the higher
    made = docs.select(F.lit(run).alias("run"), F.col("doc_id").cast("long").alias("doc_id"), *locator(), digest(text).alias("digest"), F.unhex(F.sha2(text, 256)).alias("sha"), size.alias("size"), rank.alias("rank"))
    made.write.mode("append").parquet(f"{state}/digests")
    docs.select(locator()[0], F.col("_metadata.file_path").alias("path")).distinct().write.mode("append").parquet(f"{state}/files")
    digests = spark.read.schema(_DIGESTS).parquet(f"{state}/digests").where(F.col("run") == run).drop("run")
    held = retain(spark, state)

    # full bytes of the hits against those of the row that stays
    hit = held.where("n > 1").select("digest", F.col("best.file").alias("file"), F.col("best.row").alias("row"))
    own = docs.select(*locator(), text.alias("norm")).withColumn("digest", digest(F.col("norm")))
    hits = written(matching(own, hit.select("digest"), "digest"), "hits")
    stays = hits.join(hit, ["digest", "file", "row"]).select("digest", F.col("norm").alias("kept_norm"))
    if earlier:
        outside = written(hit.join(hits.select("digest").distinct(), "digest", "left_semi").join(hits.select("file", "row"), ["file", "row"], "left_anti"), "outside")
        stays = stays.union(_texts(spark, state, outside).select("digest", "norm"))
    stays = few_bytes(written(stays, "stays"), F.octet_length("kept_norm") + 32)
    unlike = hits.join(stays, "digest").where("norm <> kept_norm").select("digest").distinct()
    unlike.write.mode("append").parquet(f"{state}/mixed")
    mixed = written(spark.read.schema("digest binary").parquet(f"{state}/mixed").distinct(), "mixed")

    out = digests.join(held, "digest")
    if mixed.limit(1).count():
        all_rows = spark.read.schema(_DIGESTS).parquet(f"{state}/digests").join(mixed, "digest", "left_semi").drop("run")
        members = written(_texts(spark, state, written(all_rows, "members")), "members")
        groups = members.groupBy("digest", "norm").agg(F.max(F.struct("size", "rank", "file", "row")).alias("best"), F.count("*").alias("n"))
        now = members.join(digests.select("file", "row"), ["file", "row"], "left_semi").join(groups, ["digest", "norm"]).drop("norm")
        out = out.join(mixed, "digest", "left_anti").unionByName(now)
    return out.select(
        "doc_id", F.bitwise_not(F.col("best.rank")).alias("keep_id"), F.col("n").alias("group_size"), ((F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row"))).alias("kept"), "file", "row", F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, state: str | None = None) -> DataFrame:
    """The rows of docs that stay, all columns as they were."""
    docs = located(docs)
    return without(docs, written(exact_duplicates(docs, state=state).where("not kept").select("file", "row"), "gone"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {
    "op10_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
"""
}
