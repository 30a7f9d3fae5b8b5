"""Approximate nearest neighbours by inverted lists with an adaptive scan of dimensions.

Vectors are brought to length 1 and rotated by one random orthogonal matrix, so that any leading dimensions are a random
sample of all. k-means on at most about SAMPLE vectors gives the lists (the square root of the number of vectors, LISTS at
most); every vector stands in the list of its nearest centre. A query scans as many lists with the nearest centres as this
table needs: for at most ASKED of the queries all rows are looked at, and so many lists are scanned that AIM of these
queries' true neighbours stand in them, up to all lists. A list is held in column blocks of STEP dimensions, and after each
block a candidate goes whose partial squared distance d of n dimensions passes the test d * D / n > t * (1 + EPS / sqrt(n))^2.
t is the K-th best whole distance known so far: after each block the candidates with the least partial distances are
measured in full, which can only lower it. Candidates that survive all blocks are scored exactly, as cosine in double
precision of the original vectors; ties go to the smaller vec_id.

Lists longer than PART rows, and lists that more than PART queries probe, are dealt out by a hash of the row's place. Rows
are told apart by file and place, so rows that share a vec_id are rows of their own: each is a candidate for the other and,
if asked for, a query of its own. Vectors of different lengths are searched among their own kind, one length after the other.

Defined cases: vectors that are null, zero, empty or that hold a null or non-finite component take no part, nor do rows with
a null vec_id; with K candidates or fewer all are returned; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import located, locator, small_batches, table, written

K, STEP, EPS = 5, 8, 2.1
SAMPLE, LISTS, PART, SEED = 20_000, 4096, 4096, 20240617
#: Queries that the number of lists is measured on, and the share of their neighbours that it has to reach.
ASKED, AIM = 256, 0.95


#: Numbers that a matrix of closenesses holds at most.
CELLS = 1 << 21


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, file, row, v array of double) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = located(rows).select(F.col("vec_id").cast("long").alias("vec_id"), *locator(), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where(~odd).where(F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, lists: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, rotated centres) from unit vectors."""
    draw = np.random.default_rng(SEED)
    rotation = np.linalg.qr(draw.normal(size=(sample.shape[1],) * 2))[0]
    x = sample @ rotation
    centres = x[draw.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest_list(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return rotation, centres


def closeness(u: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each row the closeness to each centre, highest for the nearest."""
    return u @ centres.T - 0.5 * (centres * centres).sum(axis=1)


def nearest_list(u: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, CELLS // len(centres))
    return np.concatenate([closeness(u[k : k + step], centres).argmax(axis=1) for k in range(0, len(u), step)])


def probes_of(fits: DataFrame, queries, shared: Broadcast) -> int:
    """Lists that a query has to scan, from the true neighbours of at most ASKED queries."""
    asked = fits.where(queries).orderBy(F.xxhash64("file", "row"), "file", "row").limit(ASKED).collect()
    if not asked:
        return 1
    q_file, q_row, q = np.array([r.file for r in asked]), np.array([r.row for r in asked]), unit(np.array([r.v for r in asked]))
    rotation, centres = shared.value
    order = np.argsort(-closeness(q @ rotation, centres), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    schema = pa.schema([("q", pa.int32()), ("score", pa.float64()), ("vec_id", pa.int64()), ("list", pa.int32())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, centres = shared.value
        top, who, where = np.full((len(q), K), -np.inf), np.zeros((len(q), K), np.int64), np.zeros((len(q), K), np.int32)
        for batch in batches:
            for first in range(0, batch.num_rows, CELLS // ASKED):
                part = batch.slice(first, CELLS // ASKED)
                ids, file, row = (part.column(c).to_numpy() for c in ("vec_id", "file", "row"))
                u = unit(part.column("v").flatten().to_numpy().reshape(part.num_rows, -1))
                own = nearest_list(u @ rotation, centres).astype(np.int32)
                s = q @ u.T
                s[(q_file[:, None] == file) & (q_row[:, None] == row)] = -np.inf
                s = np.hstack([top, s])
                at = np.argpartition(-s, K - 1, axis=1)[:, :K]
                top = np.take_along_axis(s, at, axis=1)
                who, where = (np.take_along_axis(np.hstack([old, np.broadcast_to(new, (len(q), len(new)))]), at, axis=1) for old, new in ((who, ids), (where, own)))
        k, j = np.nonzero(np.isfinite(top))
        yield table({"q": k, "score": top[k, j], "vec_id": who[k, j], "list": where[k, j]}, schema)

    found = fits.mapInArrow(best, "q int, score double, vec_id long, list int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    true = found.withColumn("rank", rank).where(F.col("rank") <= K).select("q", "list").collect()
    needed = sorted(int(place[r.q, r.list]) for r in true)
    return needed[math.ceil(AIM * len(needed)) - 1] + 1 if needed else 1


def _column(batch: pa.RecordBatch | pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, -1)


def scan(base: list[np.ndarray], query: np.ndarray, k: int) -> np.ndarray:
    """Places of base (rotated, one array a column block) that may be among the k nearest to query."""
    dims, ends = sum(b.shape[1] for b in base), np.cumsum([b.shape[1] for b in base])
    alive, partial, limit = np.arange(len(base[0])), np.zeros(len(base[0])), np.inf
    for step, (b, n) in enumerate(zip(base, ends.tolist(), strict=True)):
        d = b[alive] - query[n - b.shape[1] : n]
        partial = partial + (d * d).sum(axis=1)
        if len(alive) > k + 1 and n < dims:
            best = np.argpartition(partial, k)[: k + 1]  # one more: the query itself may be among them
            whole = partial[best]
            for more, end in zip(base[step + 1 :], ends[step + 1 :].tolist(), strict=True):
                d = more[alive[best]] - query[end - more.shape[1] : end]
                whole = whole + (d * d).sum(axis=1)
            limit = min(limit, float(whole.max()) + 1e-6)
            keep = partial * (dims / n) <= limit * (1 + EPS / math.sqrt(n)) ** 2 + 1e-6
            alive, partial = alive[keep], partial[keep]
    return alive[partial <= limit + 1e-5]


def _scan_list(rows: pa.Table) -> pa.Table:
    """The k best of one part of a list for each query that probes it."""
    out: dict[str, list] = {c: [] for c in ("query_id", "query_file", "query_row", "vec_id", "file", "row", "score")}
    is_query = rows.column("is_query").to_numpy(zero_copy_only=False)
    base, queries = rows.filter(pa.array(~is_query)), rows.filter(pa.array(is_query))
    if base.num_rows and queries.num_rows:
        ids, file, row = (base.column(c).to_numpy() for c in ("vec_id", "file", "row"))
        original, turned = _column(base, "v", "f8"), _column(base, "u", "f4")
        norms = np.sqrt((original * original).sum(axis=1))
        blocks = [np.ascontiguousarray(turned[:, a : a + STEP]) for a in range(0, turned.shape[1], STEP)]
        names = [queries.column(c).to_pylist() for c in ("vec_id", "file", "row")]
        for q_id, q_file, q_row, v, u in zip(*names, _column(queries, "v", "f8"), _column(queries, "u", "f4"), strict=True):
            at = scan(blocks, u, K)
            at = at[(file[at] != q_file) | (row[at] != q_row)]
            with np.errstate(over="ignore", invalid="ignore"):
                s = original[at] @ v / (norms[at] * np.sqrt((v * v).sum()))
            if not np.isfinite(s).all():  # squares out of range: the same measure of the scaled vectors
                s = unit(original[at]) @ unit(v[None])[0]
            best = np.lexsort((row[at], file[at], ids[at], -s))[:K]
            at, s = at[best], s[best]
            for name, values in zip(out, ([q_id] * len(at), [q_file] * len(at), [q_row] * len(at), ids[at].tolist(), file[at].tolist(), row[at].tolist(), s.tolist()), strict=True):
                out[name] += values
    return pa.table({c: pa.array(x, pa.float64() if c == "score" else pa.int64()) for c, x in out.items()})


def search(rows: DataFrame, queries, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all other rows for each row that `queries` (a condition on vec_id)
    holds for."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = usable(rows)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()  # a row for each length there is
    for dims, there in sorted(map(tuple, sizes)):
        out = out.unionByName(_search(rows.where(F.size("v") == dims), queries, k, there))
    return out


def _search(fits: DataFrame, queries, k: int, there: int) -> DataFrame:
    """search among `there` vectors of one length."""
    spark = fits.sparkSession
    taken = fits if there <= SAMPLE else fits.where(F.pmod(F.xxhash64("file", "row"), F.lit(1 << 40)) < math.ceil(SAMPLE / there * (1 << 40)))
    sample = [r.v for r in taken.orderBy("vec_id", "file", "row").select("v").collect()] or [r.v for r in fits.limit(1).collect()]
    rotation, centres = fit(unit(np.array(sample)), max(1, min(LISTS, math.isqrt(there))))
    shared = spark.sparkContext.broadcast((rotation, centres))  # LISTS vectors at most
    probes = probes_of(fits, queries, shared)
    schema = pa.schema([("vec_id", pa.int64()), ("file", pa.int64()), ("row", pa.int64()), ("is_query", pa.bool_()), ("v", pa.binary()), ("u", pa.binary()), ("lists", pa.list_(pa.int32()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, centres = shared.value
        step = max(1, CELLS // len(centres))
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                u = unit(v) @ rotation
                near = closeness(u, centres)
                asks = batch.column("is_query").to_numpy(zero_copy_only=False)
                lists = [[x] for x in near.argmax(axis=1).tolist()]
                for x, o in zip(np.flatnonzero(asks).tolist(), np.argsort(-near[asks], axis=1, kind="stable")[:, :probes], strict=True):
                    lists[x] = o.tolist()
                yield table({**{c: batch.column(c) for c in ("vec_id", "file", "row", "is_query")}, "v": [x.tobytes() for x in v], "u": [x.tobytes() for x in u.astype(np.float32)], "lists": lists}, schema)

    both = fits.withColumn("is_query", F.lit(False)).unionByName(fits.where(queries).withColumn("is_query", F.lit(True))).select("vec_id", "file", "row", "is_query", "v")
    placed = written(both.mapInArrow(place, "vec_id long, file long, row long, is_query boolean, v binary, u binary, lists array<int>"), "placed")
    spread = placed.select("vec_id", "file", "row", "is_query", "v", "u", F.explode("lists").alias("list"))
    sizes = spread.groupBy("list").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(c) / PART)).cast("int").alias(name) for name, c in (("parts", ~F.col("is_query")), ("asks", F.col("is_query")))])
    dealt = spread.join(F.broadcast(sizes), "list")  # at most LISTS rows
    # a base row goes to its part for every share of the queries, a query to its share for every part
    own = F.pmod(F.xxhash64("file", "row"), F.when(F.col("is_query"), F.col("asks")).otherwise(F.col("parts"))).cast("int")
    all_of = F.sequence(F.lit(0), F.when(F.col("is_query"), F.col("parts")).otherwise(F.col("asks")) - 1)
    dealt = dealt.withColumn("own", own).withColumn("each", F.explode(all_of))
    part, ask = (F.when(F.col("is_query") == flag, F.col("own")).otherwise(F.col("each")) for flag in (False, True))
    groups = dealt.select("list", part.alias("part"), ask.alias("ask"), "vec_id", "file", "row", "is_query", "v", "u").groupBy("list", "part", "ask")
    found = groups.applyInArrow(_scan_list, "query_id long, query_file long, query_row long, vec_id long, file long, row long, score double")
    rank = F.row_number().over(Window.partitionBy("query_file", "query_row").orderBy(F.desc("score"), "vec_id", "file", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {"op9_nearest": op9_nearest}
ORACLES: dict[str, str] = {}
