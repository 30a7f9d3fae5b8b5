"""Token ids in files of binary shards, each shard compressed by Re-Pair.

Re-Pair replaces frequent pairs of neighbouring ids by nonterminals until no pair stands LEAST times without overlap. A
round here replaces many pairs at once: a place is taken if its pair is more frequent than those of the places before and
after it (of a run of one symbol every second place counts), and a pair becomes a rule if LEAST such places are left.
While much changes, pairs are counted in hash slots, the last one of a slot standing for it, with another hash each round;
then exactly, and only where a neighbour has changed or a frequent pair is left. Rules hold two symbols each; a shard also
has the expansion length of every rule and the id offset of every STRIDE-th symbol, so that any document is decoded without
what stands before it.

A file is Parquet with one row a shard (part, shard, documents, ids, start, data), written by Spark, so on any file system
Spark knows, and whole or absent if executors are lost. `data` is little endian:
  header   8s magic, then u32: first nonterminal, documents, rules, symbols, bytes a symbol; u64: ids, id offset in the part
  i64[documents] doc_id; u8[documents] whether it is there; u64[documents + 1] offset of each document in the shard
  u32[rules, 2] rules (symbol first + k stands for rule k); u32[rules] their expansion lengths
  u64[symbols / STRIDE, rounded up] id offsets; the symbols
Parts are ranges of ascending doc_id (a null doc_id comes first), and of the text's hash where doc_ids are equal.

Defined cases: null text is empty and holds its end id only; repeated rows are held each; a null doc_id comes back as null;
an empty table gives no shard. Extra columns are ignored. A text of any length is one document of one shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import documents, id_text, table, text_steps, work_path
from ._tokens import END, STEP, default_tokenizer, encoder, ended_ids, spread

MAGIC = b"REPAIR02"
SHARD_IDS = 1 << 18
LEAST, STRIDE = 12, 1024
#: Bytes of shards that the Parquet writer gathers before it writes them, as a row group that is read as one.
GROUP = 8 << 20
_HEAD = struct.Struct("<8sIIIIIQQ")
_SLOT_BITS = 17
_DDL = "part int, shard int, documents long, ids long, start long, data binary"


def _seconds(places: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Of places, every second one of each run; joined says which ones go on from the one before."""
    begin = np.flatnonzero(~joined)
    return places[(np.arange(len(places)) - np.repeat(begin, np.diff(begin, append=len(places)))) & 1 == 1]


def _rules(made: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([made >> made.dtype.type(bits), made & made.dtype.type((1 << bits) - 1)], axis=1).astype(np.uint32)


def _slotted_round(seq: np.ndarray, size: int, least: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places to replace, their new symbols, pairs as symbol << 16 | symbol, which places can't hold a frequent pair)."""
    key = seq[:-1] << np.uint32(16)
    key |= seq[1:]
    slot = key * np.uint32(salt)
    slot >>= np.uint32(32 - _SLOT_BITS)
    slot = slot.astype(np.intp)
    stands = np.empty(1 << _SLOT_BITS, np.uint32)
    stands[slot] = key
    n = np.bincount(slot, minlength=1 << _SLOT_BITS)
    often = np.flatnonzero(n >= least)
    often = often[np.argsort(-n[often], kind="stable")]
    none = len(often)
    by_slot = np.full(1 << _SLOT_BITS, none, np.int32)
    by_slot[often] = np.arange(none, dtype=np.int32)
    rank = np.empty(len(seq) + 1, np.int32)
    rank[0] = rank[-1] = none
    rank[1:-1] = by_slot.take(slot)
    twin = np.flatnonzero(seq[:-1] == seq[1:])
    if len(twin):
        rank[_seconds(twin, np.diff(twin, prepend=-2) == 1) + 1] = none
    best = rank[1:-1] < rank[:-2]
    best &= rank[1:-1] < rank[2:]
    at = np.flatnonzero(best)
    of = rank[1:-1].take(at)
    own = key.take(at) == stands.take(often).take(of)  # and not another pair of the slot
    at, of = at[own], of[own]
    good = np.bincount(of, minlength=none) >= least
    own = good.take(of)
    at, of = at[own], of[own]
    symbols = (np.cumsum(good) - 1 + size).astype(np.uint32).take(of)
    mine = stands.take(slot) == key
    mine &= (np.bincount(slot[mine], minlength=1 << _SLOT_BITS) < least).take(slot)
    return at, symbols, stands[often[good]], mine


def _linked_rounds(seq: np.ndarray, size: int, least: int, open_: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(symbols, rules) after rounds over linked symbols; only the places in open_ (ascending) may hold a frequent pair."""
    n, rules = len(seq), []
    seq = np.append(seq, np.uint32(0))
    after, before, there = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32), np.ones(n + 1, bool)
    none = np.iinfo(np.int32).max
    rank = np.full(n + 2, none, np.int32)
    while len(open_):
        then = after.take(open_)
        if then[-1] >= n:
            open_, then = open_[:-1], then[:-1]
        x, y = seq.take(open_), seq.take(then)
        same = np.flatnonzero(x == y)
        twin, at = open_[same], open_
        if len(same):
            use = np.ones(len(open_), bool)
            use[_seconds(same, np.concatenate([[False], then[same[:-1]] == twin[1:]]))] = False
            at, x, y = at[use], x[use], y[use]
        key = x.astype(np.uint64) << np.uint64(32)
        key |= y
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
        count = np.diff(begin, append=len(key))
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")]
        at = at[spread(order, begin[often], count[often])]
        ranks = np.repeat(np.arange(len(often), dtype=np.int32), count[often])
        rank[at] = ranks
        best = (ranks < rank[before[at]]) & (ranks < rank[after[at]])
        rank[at] = none
        left, of = at[best], ranks[best]
        good = np.bincount(of, minlength=len(often)) >= least
        own = good[of]
        left, of = left[own], of[own]
        rules.append(_rules(key[begin[often[good]]], 32))
        seq[left] = (np.cumsum(good) - 1 + size)[of]
        size += int(good.sum())
        right = after[left]
        there[right] = False
        after[left] = end = after[right]
        before[end] = left
        open_ = np.unique(np.concatenate([left, before[left], at, twin]))
        open_ = open_[there[open_] & (open_ >= 0)]
    return seq[:n][there[:n]], rules


def repair(ids: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): nonterminals count from `first`, and no pair is left that stands `least` times without overlap."""
    there = np.zeros(first, bool)
    there[ids] = True
    own = np.flatnonzero(there).astype(np.uint32)
    number = np.zeros(first, np.uint32)
    number[own] = np.arange(len(own), dtype=np.uint32)
    seq, size, rules, salt = number.take(ids), len(own), [], 0x9E3779B1
    open_ = None
    while open_ is None and len(seq) > 1 and size + len(seq) // least < 1 << 16:
        at, symbols, made, dead = _slotted_round(seq, size, least, salt)
        rules.append(_rules(made, 16))
        size, salt = size + len(made), salt + 2
        seq[at] = symbols
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        if 24 * len(at) < len(seq):
            live = np.ones(len(seq), bool)
            np.logical_not(dead, out=live[:-1])
            live[at] = True
            live[np.maximum(at - 1, 0)] = True
            open_ = np.flatnonzero(live.take(keep))
        seq = seq.take(keep)
    seq, more = _linked_rounds(seq, size, least, np.arange(len(seq)) if open_ is None else open_)
    made = np.concatenate([np.zeros((0, 2), np.uint32), *rules, *more])
    symbol = np.concatenate([own, first + np.arange(len(made), dtype=np.uint32)]).astype(np.uint32)
    return symbol.take(seq), symbol.take(made)


def rule_ids(rules: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The ids of every rule, one rule after the other. A rule uses earlier rules only."""
    size = lengths.astype(np.int64)
    seq, at = rules.ravel().astype(np.uint32), np.cumsum(size) - size
    while (inner := np.flatnonzero(seq >= first)).size:
        grown = np.ones(len(seq), np.int64)
        grown[inner] = 2
        begin = np.cumsum(grown) - grown
        out = np.empty(int(grown.sum()), np.uint32)
        out[begin] = seq
        pair = rules[seq[inner] - first]
        out[begin[inner]], out[begin[inner] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    assert len(seq) == int(at[-1] + size[-1] if len(size) else 0)
    return seq


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule stands for; a rule uses earlier rules only."""
    out: list[int] = []
    for x, y in rules.tolist():
        out.append((out[x - first] if x >= first else 1) + (out[y - first] if y >= first else 1))
    return np.array(out, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    held = rule_ids(rules, lengths, first)
    store = np.concatenate([np.arange(first, dtype=np.uint32), held])
    size = np.concatenate([np.ones(first, np.int64), lengths.astype(np.int64)])
    at = np.concatenate([np.arange(first), first + np.cumsum(lengths, dtype=np.int64) - lengths])
    return spread(store, at.take(symbols), size.take(symbols))


def shard_bytes(doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray, start: int, first: int) -> bytes:
    symbols, rules = repair(ids, first)
    lengths = rule_lengths(rules, first)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    inner = symbols >= first
    long = np.ones(len(symbols), np.int64)
    long[inner] = lengths[symbols[inner] - first]
    marks = (np.cumsum(long) - long)[::STRIDE]
    parts = [
        _HEAD.pack(MAGIC, first, len(sizes), len(rules), len(symbols), width, len(ids), start),
        np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is not None for x in doc_ids], "u1"), np.concatenate([[0], np.cumsum(sizes)]).astype("<u8"),
        rules.astype("<u4"), lengths.astype("<u4"), marks.astype("<u8"), symbols.astype(f"<u{width}"),
    ]
    return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)


class Shard:
    """A shard from its bytes; document(k) decodes one document alone, all_ids() everything."""

    def __init__(self, data: bytes):
        magic, self.first, self.documents, n_rules, n_symbols, width, self.n_ids, self.start = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("this isn't a shard of token ids")
        at = _HEAD.size

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, there = read("<i8", self.documents), read("u1", self.documents)
        self.doc_ids = [int(x) if ok else None for x, ok in zip(ids, there, strict=True)]
        self.offsets = read("<u8", self.documents + 1).astype(np.int64)
        self.rules = read("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = read("<u4", n_rules)
        self.marks = read("<u8", -(-n_symbols // STRIDE)).astype(np.int64)
        self.symbols = read(f"<u{width}", n_symbols)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids from offset a to b of the shard, by the marks before and after them."""
        if a >= b:
            return np.zeros(0, np.uint32)
        k = int(np.searchsorted(self.marks, a, "right")) - 1
        m = int(np.searchsorted(self.marks, b, "left"))
        base = int(self.marks[k])
        return expand(self.symbols[k * STRIDE : m * STRIDE], self.rules, self.lengths, self.first)[a - base : b - base]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.offsets[k]), int(self.offsets[k + 1]))

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.lengths, self.first)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    """Writes docs (doc_id, text) as token files into `folder`."""
    tokenizer = tokenizer or default_tokenizer()
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("start", pa.int64()), ("data", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        first = max(encoder(tokenizer).library.get_vocab().values(), default=0)
        first = max(first, END) + 1
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal number, start, doc_ids, ids, sizes, held
            data = shard_bytes(doc_ids, np.concatenate(ids), np.concatenate(sizes), start, first)
            row = table({"part": [part], "shard": [number], "documents": [len(doc_ids)], "ids": [held], "start": [start], "data": [data]}, schema)
            number, start, doc_ids, ids, sizes, held = number + 1, start + held, [], [], [], 0
            return row

        for batch in batches:
            for a, b in text_steps(batch.column("text"), STEP // 4):
                more, at = ended_ids(tokenizer, batch.column("text")[a:b])
                own = batch.column("doc_id")[a:b].to_pylist()
                low = 0
                while low < len(own):  # as many documents as the shard takes, one at least
                    high = max(low + 1, int(np.searchsorted(at, at[low] + SHARD_IDS - held, "right")) - 1) if held + at[-1] - at[low] > SHARD_IDS else len(own)
                    doc_ids += own[low:high]
                    ids.append(more[at[low] : at[high]])
                    sizes.append(np.diff(at[low : high + 1]))
                    held += int(at[high] - at[low])
                    low = high
                    if low < len(own) or held >= SHARD_IDS:
                        yield shard()
        if doc_ids:
            yield shard()

    tie = F.xxhash64("text")
    ordered = id_text(docs).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    # a row group is looked at after every row, so it and what a reader takes at a time stay near GROUP bytes
    rows = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(GROUP), "compression": "none"}
    ordered.mapInArrow(write, _DDL).write.options(**rows).parquet(folder)


def read_shards(spark: SparkSession, folder: str, look: Callable[[Shard], dict], schema: pa.Schema, ddl: str) -> DataFrame:
    """What `look` makes of each shard, with its part; shards are decoded in workers, one at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                shard = Shard(data.as_py())
                yield table({"part": [part] * shard.documents, **look(shard)}, schema)

    return spark.read.schema(_DDL).parquet(folder).select("part", "data").mapInArrow(read, ddl)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, part, in_part, ids): each document's ids (little-endian unsigned 32-bit) as the files hold them."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("in_part", pa.int64()), ("ids", pa.binary())])

    def look(shard: Shard) -> dict:
        ids, at = shard.all_ids().astype("<u4").tobytes(), (4 * shard.offsets).tolist()
        return {"doc_id": shard.doc_ids, "in_part": shard.start + shard.offsets[:-1], "ids": [ids[x:y] for x, y in zip(at, at[1:], strict=False)]}

    return read_shards(spark, folder, look, schema, "part int, doc_id long, in_part long, ids binary")


def part_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, before): ids of all earlier parts, from the shards' headers alone. The window is over one row a part."""
    totals = spark.read.schema(_DDL).parquet(folder).groupBy("part").agg(F.sum("ids").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "ids")
    write_token_files(documents(spark, sf_dir), folder)
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digests(shard: Shard) -> dict:
        ids, at = memoryview(shard.all_ids().astype("<u4").view(np.uint8)), (4 * shard.offsets).tolist()
        return {"doc_id": shard.doc_ids, "in_part": shard.start + shard.offsets[:-1], "n_tokens": np.diff(shard.offsets), "ids_crc32": [zlib.crc32(ids[x:y]) for x, y in zip(at, at[1:], strict=False)]}

    rows = read_shards(spark, folder, digests, schema, "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long")
    return rows.join(part_starts(spark, folder), "part").select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict[str, str] = {}
