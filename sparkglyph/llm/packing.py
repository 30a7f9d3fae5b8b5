"""Best-fit packing of token sequences by exact-complement hashing.

What has to be packed is fully described by how many pieces of each length there are: at most `capacity` counts, whatever
the size of the corpus. The plan is made on those counts. For each length, longest first, combinations of one, two and
three further lengths that fill its gap exactly are looked up by their sum and consumed as often as all of them are
available; what remains is packed best fit. A plan is a list of patterns with how often each is used, so its size depends
on the capacity alone. Pieces get their rank among pieces of their length (counted per length and slice of the table, so no
length has to meet in one task), and rank and plan give sequence and offset.

Defined cases: null text is empty and packs as its end id; repeated rows are packed each; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import documents, id_text, table, text_steps, tidied, written
from ._tokens import STEP, default_tokenizer, ended_ids

CAPACITY = 1024
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Sums:
    """Combinations of the lengths that occur, by their sum: pairs in one array sorted by sum, the longer length descending;
    a triple's sum is a length and the sum of a pair of lengths no longer than it."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths = np.sort(lengths)[::-1]
        i, j = np.triu_indices(len(self.lengths))
        first, second = self.lengths[i], self.lengths[j]
        fits = first + second < capacity
        first, second = first[fits], second[fits]
        order = np.lexsort((-first, first + second))
        self.first, self.second = first[order], second[order]
        self.at = np.searchsorted((first + second)[order], np.arange(capacity + 1))

    def pairs(self, total: int, left: np.ndarray, most: int = 1 << 60) -> list[tuple[int, int]]:
        """Pairs of that sum, of lengths up to `most`, that are available."""
        if total < 2:
            return []
        a, b = self.first[self.at[total] : self.at[total + 1]], self.second[self.at[total] : self.at[total + 1]]
        k = int(np.searchsorted(-a, -most))
        there = (left[a[k:]] > 0) & (left[b[k:]] > 0)
        return list(zip(a[k:][there].tolist(), b[k:][there].tolist(), strict=True))

    def triples(self, total: int, left: np.ndarray) -> Iterator[tuple[int, int, int]]:
        for x in self.lengths[(self.lengths < total - 1) & (3 * self.lengths >= total) & (left[self.lengths] > 0)].tolist():
            for y, z in self.pairs(total - x, left, x):
                yield x, y, z


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) patterns that use up counts[length], for lengths 1 to len(counts) - 1, the capacity."""
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    sums = Sums(np.flatnonzero(left), capacity)
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        times = int(min(left[x] // k for x, k in need.items()))
        if times:
            for x, k in need.items():
                left[x] -= times * k
            out.append((pattern, times))

    take((capacity,))
    for long in range(capacity - 1, 0, -1):  # combinations that fill the gap exactly, as often as all of them are there
        gap = capacity - long
        if left[long]:
            take((long, gap))
        for combinations in (sums.pairs, sums.triples) if left[long] else ():
            for combination in combinations(gap, left):
                if not left[long]:
                    break
                take((long, *combination))
    for long in range(capacity - 1, 0, -1):  # best fit of what is left, a whole pattern at a time
        while left[long]:
            pattern, gap, used = [long], capacity - long, Counter([long])
            while gap:
                fits = [x for x in (np.flatnonzero(left[1 : gap + 1]) + 1).tolist() if left[x] > used[x]]
                if not fits:
                    break
                pattern.append(fits[-1])
                used[fits[-1]] += 1
                gap -= fits[-1]
            take(tuple(pattern))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its runs, the first sequence of each run, and the offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    rank = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            runs.setdefault(x, []).append((int(rank[x]), sequence, offset))
            rank[x] += times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Ids of each text with the end id, cut into pieces of `capacity`; the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for a, b in text_steps(batch.column("text"), STEP):
                ids, at = ended_ids(tokenizer, batch.column("text")[a:b])
                n = np.diff(at)
                many, head = -(-n // capacity), (n - 1) % capacity + 1
                of = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                start = np.where(piece == 0, 0, head[of] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[of], capacity)
                view, first = memoryview(ids.astype("<u4").view(np.uint8)), 4 * (at[of] + start)
                crc = [zlib.crc32(view[x:y]) for x, y in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                yield table({"doc_id": batch.column("doc_id")[a:b].take(pa.array(of)), "piece": piece, "start": start, "length": length, "ids_crc32": crc}, _PIECES)

    return id_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (with a `length` from 1 to capacity) plus sequence_id and offset."""
    spark = rows.sparkSession
    rows = written(rows.withColumn("slice", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "pieces")
    per_slice = written(rows.groupBy("length", "slice").count(), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in per_slice.groupBy("length").agg(F.sum("count")).collect():  # at most `capacity` rows
        counts[length] = n
    runs = slots(plan(counts), capacity)
    before = per_slice.select("length", "slice", (F.sum("count").over(Window.partitionBy("length").orderBy("slice")) - F.col("count")).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "slice").orderBy("pos")) - 1).join(before, ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "slice", "pos")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    first, base, at = runs[int(length[part[0]])]
                    k = np.searchsorted(first, rank[part], "right") - 1
                    sequence[part], offset[part] = base[k] + rank[part] - first[k], at[k]
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType

    schema = ranked.drop("rank").schema.add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    out = pack(pieces(docs, tokenizer or default_tokenizer(), capacity), capacity)
    return out.select(*[f.name for f in _PIECES], "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLES: dict[str, str] = {}
