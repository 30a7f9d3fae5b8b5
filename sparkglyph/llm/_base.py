"""Plumbing that the operators of this package share: where tables go, and how texts come in."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of numbers counts as small enough to broadcast (some 16 bytes a row).
BROADCAST_ROWS = 500_000
#: Bytes up to which a table with texts, lists or spans in it counts as small enough to broadcast.
BROADCAST_BYTES = 8 << 20
#: Bytes of text that one step of a vectorised operator looks at, and of a batch that Spark hands to a worker.
TEXT_STEP, BATCH = 4 << 20, 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: malloc_trim of the C library, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; memory that the work on each has freed goes back to the system before the next one. Workers outlive
    their tasks, and what they hold on to counts against the executor's limit."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def tidied_group(f: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """The same for a function of groups, after those of over a megabyte."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        out = f(key, rows)
        if rows.nbytes > 1 << 20:
            give_back()
        return out

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (as in tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table that no returned DataFrame reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """The same rows from a table in the shared folder: lineage ends there, and a lost executor costs nothing that is in it."""
    spark = df.sparkSession
    small_batches(spark)
    path = path or work_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows go to workers BATCH bytes at a time at most, where the session's own setting doesn't say less."""
    now = spark.conf.get(_BATCH).rstrip("b")
    if not now.isdigit() or int(now) > BATCH:
        spark.conf.set(_BATCH, str(BATCH))


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns the operators look at; whatever else the table holds can't clash with theirs."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def located(docs: DataFrame) -> DataFrame:
    """docs, from files if they weren't: each row then has a file and a place in it."""
    small_batches(docs.sparkSession)
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return written(docs, "located")


def locator(file: str = "file", row: str = "row") -> tuple[Column, Column]:
    """Where a row of a `located` table is: a 64-bit hash of its file's path, and its place there."""
    return F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)


def few_rows(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows (numbers only), marked for broadcast up to `limit` of them."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def few_bytes(rows: DataFrame, size: Column) -> DataFrame:
    """rows (a written table), marked for broadcast up to BROADCAST_BYTES; size: bytes of a row."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(rows) if total <= BROADCAST_BYTES else rows


def matching(rows: DataFrame, ids: DataFrame, key: str | list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows whose key is in ids (numbers or digests, distinct): broadcast up to `limit` of them, a shuffled join beyond."""
    return rows.join(few_rows(ids, limit), key, "left_semi")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs (located) without the rows of gone (file, row), all columns as they are."""
    gone = few_rows(gone.toDF("gone_file", "gone_row"))
    here = docs.select("*", *locator("__file", "__row"))
    return here.join(gone, (F.col("__file") == F.col("gone_file")) & (F.col("__row") == F.col("gone_row")), "left_anti").drop("__file", "__row")


def table(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if not isinstance(rows[f.name], pa.Array) else rows[f.name].cast(f.type) for f in schema], schema=schema)


def text_steps(col: pa.Array, limit: int = TEXT_STEP) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text (at least one row each)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield first, last
        first = last


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null is empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def texts(col: pa.Array) -> list[str]:
    return pc.fill_null(col, "").to_pylist()
