"""Secret scans over a content-addressed ledger.

Every text is a blob, named by its SHA-256. The ledger is a folder of two tables: `scans` (blob, rules, spans), the blobs
scanned so far by version of the rules, and `paths` (blob, doc_id, version), all the places that held a blob in any version
of the corpus. Only pairs of blob and rule version that `scans` doesn't have are scanned, each once however many rows hold
that text, and findings are joined back to all rows. With a `ledger` folder that lasts, a later run over the next version of
the corpus scans only blobs that no earlier version held; with new rules it scans everything once more. One run at a time
may write to a ledger.

Defined cases: null text is the empty blob; repeated rows each get their findings; a null doc_id stays null; an empty table
gives no rows. Extra columns are ignored, or kept as they are by mask_secrets.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import documents, few_bytes, located, locator, table, text_steps, texts, tidied, without, work_path, written

#: The three kinds in order, their patterns, the group whose length counts, and the least length.
RULES = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
MASK = "[SECRET]"
_SPAN = "array<struct<kind:string,start:int,end:int>>"


def rules_version(rules: tuple = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scanner(rules: tuple = RULES):
    """text -> [(kind, start, end)] by start and then by the order of the rules; code points, end exclusive."""
    made = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        quick = pattern == r"[0-9a-f]+"  # runs are maximal either way; asking for the length at once skips short ones sooner
        made.append((order, kind, re.compile(rf"[0-9a-f]{{{least},}}" if quick else pattern).finditer, group, least))

    def scan(text: str) -> list[tuple[str, int, int]]:
        found = [(m.start(), order, kind, m.end()) for order, kind, find, group, least in made for m in find(text) if m.end(group) - m.start(group) >= least]
        return [(kind, a, b) for a, _, kind, b in sorted(found)]

    return scan


def _blob() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def scan_unseen(docs: DataFrame, ledger: str, rules: tuple = RULES, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scans the blobs of docs that the ledger doesn't have under these rules, and notes where docs holds its blobs; returns
    (doc_id, blob) of docs and the ledger's (blob, spans) for these rules."""
    spark, of = docs.sparkSession, rules_version(rules)
    docs = located(docs)
    ddl = f"blob binary, rules string, spans {_SPAN}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/scans")
    known = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    seen = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _blob().alias("blob"), *locator()), "blobs")
    seen.select("blob", "doc_id", F.lit(version or uuid.uuid4().hex).alias("version")).write.mode("append").parquet(f"{ledger}/paths")
    # one row of each new blob is scanned; the others are few where texts differ, so they are what is looked up
    first = seen.groupBy("blob").agg(F.first("file").alias("first_file"), F.first("row").alias("first_row"))
    if known:
        first = first.join(spark.read.schema(ddl).parquet(f"{ledger}/scans").where(F.col("rules") == of).select("blob"), "blob", "left_anti")
    first = written(first, "firsts")
    other = F.col("first_file").isNull() | (F.col("first_file") != F.col("file")) | (F.col("first_row") != F.col("row"))
    skip = written(seen.join(first, "blob", "left").where(other).select("file", "row"), "skip")
    unseen = without(docs, skip).select(_blob().alias("blob"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("blob", pa.binary()), ("rules", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules)
        for batch in tidied(batches):
            for a, b in text_steps(batch.column("text")):
                spans = [[{"kind": k, "start": x, "end": y} for k, x, y in find(t)] for t in texts(batch.column("text")[a:b])]
                yield table({"blob": batch.column("blob")[a:b], "rules": [of] * (b - a), "spans": spans}, schema)

    unseen.mapInArrow(scan, ddl).write.mode("append").parquet(f"{ledger}/scans")
    return seen.select("doc_id", "blob"), spark.read.schema(ddl).parquet(f"{ledger}/scans").where(F.col("rules") == of).select("blob", "spans")


def _found(scans: DataFrame) -> DataFrame:
    """The scans that found something; broadcast where their spans are few."""
    return few_bytes(scans.where(F.size("spans") > 0), 48 + 32 * F.size("spans"))


def all_findings(spark: SparkSession, ledger: str, rules: tuple = RULES) -> DataFrame:
    """(version, doc_id, blob, spans): what these rules found, at every place of every version."""
    scans = spark.read.parquet(f"{ledger}/scans").where(F.col("rules") == rules_version(rules)).select("blob", "spans")
    return spark.read.parquet(f"{ledger}/paths").join(_found(scans), "blob").select("version", "doc_id", "blob", "spans")


def find_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple = RULES, version: str | None = None) -> DataFrame:
    """(doc_id, blob, spans) for each row of docs (doc_id, text)."""
    seen, scans = scan_unseen(docs, ledger or work_path(docs.sparkSession, "ledger"), rules, version)
    return seen.join(_found(scans), "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def mask_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple = RULES) -> DataFrame:
    """docs with each secret replaced by MASK (overlapping spans as one) and n_chars counted anew; all other columns as they were."""
    _, scans = scan_unseen(docs, ledger or work_path(docs.sparkSession, "ledger"), rules)
    found = _found(scans).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    here = docs.withColumn("__of", _blob()).join(found, F.col("__of") == F.col("__blob"), "left")
    # spans come by start: text up to each, the mask, and on from the furthest end so far
    masked = F.expr(
        f"aggregate(__spans, struct('' as made, 0 as at), (s, x) -> if(x.start >= s.at, struct(concat(s.made, substring(text, s.at + 1, x.start - s.at), '{MASK}') as made, x.end as at), "
        "struct(s.made as made, greatest(s.at, x.end) as at)), s -> concat(s.made, substring(text, s.at + 1)))"
    )
    found = F.col("__spans").isNotNull()
    out = here.withColumn("text", F.when(found, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(found, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("__of", "__blob", "__spans")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(documents(spark, sf_dir))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("spans", lambda s: s["kind"])
    of = [(F.size("spans") - F.size(F.array_remove(kinds, x))).cast("long").alias(f"n_{x}") for x, *_ in RULES]
    return rows.select("doc_id", *of, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLES: dict[str, str] = {}
