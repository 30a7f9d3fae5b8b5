"""MinHash near-duplicate detection with tensored banding.

Two small collections A and B of `TABLES` band values each are computed per text, every value from `BAND` minhashes. The
table keys are all pairs (A_i, B_j): TABLES^2 tables from 2 * TABLES * BAND minhashes, about a square root of what
independent tables need. Two sets of similarity s meet in a table with probability (1 - (1 - s^BAND)^TABLES)^2: 0.9999 at
0.75, over 0.999999 at 0.85.

Steps, all on tables in the shared folder:
 1. texts -> set of hashed shingles -> size, 128-bit digest, minhashes. Equal sets become one class, with a number of its
    own; doc_ids only name components at the end, so rows that share a doc_id have nothing to do with each other.
 2. a band value that only one class has can't make a shared key, so keys are formed only from values that recur.
 3. in each key's bucket every class is paired with the smallest one (a star, no pairs of all with all); pairs pass a
    loose test on minhashes, and then the full sets decide. Components of the confirmed links.
 4. buckets that still hold several components, in blocks of bounded size: first the minhashes tell which classes have
    a possible partner of another component, then these classes' full sets meet in the block and decide. A block gives
    the links that join its components, so never more than it has classes. Members of a bucket's largest component don't
    meet each other. After this step each pair of classes that shares a key is confirmed, refuted or already connected.

Defined cases: null and empty texts have an empty set and are linked with nothing; repeated rows each get a row; a null
doc_id is kept as a row but never names a component, and kept is false for it (a component of null doc_ids only has a null
component_id); where several rows have the component's doc_id, kept is true for each, and drop_near_duplicates keeps the
first of them by file and place. Extra columns are ignored, or kept as they are by drop_near_duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import BROADCAST_ROWS, buffers, documents, few_rows, located, locator, table, text_steps, tidied, tidied_group, without, written
from ._graph import components
from ._words import mix, shingle_sets

SHINGLE, SIMILAR = 5, 75
BAND, TABLES = 2, 12
#: Classes of a bucket, and shingles of them, in one block of step 4, and minhashes of HASHES that must agree there and in
#: step 3 (a pair at 0.75 has 36 on average; fewer than 20 has a probability below 1e-6).
BLOCK, BLOCK_SHINGLES, AGREE = 2048, 1_000_000, 20
#: Bytes of text, and pairs of a block, that a worker looks at in one step.
STEP, PAIRS = 1 << 20, 50_000
HASHES = 2 * BAND * TABLES

_SIGNED = pa.schema([("doc_id", pa.int64()), ("file", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("hashes", pa.binary()), ("bands", pa.list_(pa.int64()))])
_draw = np.random.default_rng(20240611)
_ADD = _draw.integers(0, 1 << 64, HASHES, dtype=np.uint64)
_TIMES = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(s: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minima of a set of 64-bit hashes."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 8192):
        x = (s[k : k + 8192, None] ^ _ADD) * _TIMES
        best = np.minimum(best, (x ^ (x >> np.uint64(29))).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def band_values(h: np.ndarray) -> np.ndarray:
    """2 * TABLES numbers of 63 bits, the collection's place mixed in: first A, then B."""
    parts = h.reshape(-1, BAND).astype(np.uint64)
    x = np.arange(len(parts), dtype=np.uint64) << np.uint64(32)
    for k in range(BAND):
        x = mix(x + parts[:, k] * np.uint64(2 * k + 3) + np.uint64(k))
    return (x >> np.uint64(1)).astype(np.int64)


def _digest(members: bytes) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tidied(batches):
        for a, b in text_steps(batch.column("text"), STEP):
            part = batch.slice(a, b - a)
            n, digests, hashes, bands, ends = [], [], [], [], [0]
            for s in shingle_sets(*buffers(part.column("text")), SHINGLE):
                n.append(len(s))
                if len(s):
                    digests.append(_digest(s.tobytes()))
                    hashes.append((h := minhashes(s)).tobytes())
                    bands.append(band_values(h))
                else:
                    digests.append(None)
                    hashes.append(None)
                ends.append(ends[-1] + (2 * TABLES if len(s) else 0))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield table({**{c: part.column(c) for c in ("doc_id", "file", "row")}, "n_shingles": n, "digest": digests, "hashes": hashes, "bands": lists}, _SIGNED)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rep", pa.int64()), ("members", pa.binary())])
    for batch in tidied(batches):
        for a, b in text_steps(batch.column("text"), STEP):
            part = batch.slice(a, b - a)
            yield table({"rep": part.column("rep"), "members": [s.tobytes() for s in shingle_sets(*buffers(part.column("text")), SHINGLE)]}, schema)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose minhashes agree in AGREE places at least."""
    for batch in tidied(batches):
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("ha", "hb"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for batch in tidied(batches):
        ok = []
        for p, q in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def full_sets(ids: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, members) of the classes in ids (rep, distinct), from one row of each."""
    rows = written(reps.select("rep", "file", "row").join(ids, "rep", "left_semi"), "rows")
    texts = docs.select("file", "row", "text").join(few_rows(rows), ["file", "row"]).select("rep", "text")
    return written(texts.mapInArrow(_sets, "rep long, members binary"), "sets")


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of (a, b) pairs of classes those that the full sets confirm."""
    ids = written(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "ids")
    sets = full_sets(ids, docs, reps)
    first = pairs.join(sets.select(F.col("rep").alias("b"), F.col("members").alias("sb")), "b")
    both = first.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("sa")), "a")
    return both.mapInArrow(_confirmed, "a long, b long")


def _candidates(key: tuple, rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs of different components in one block that agree in AGREE minhashes, each in its first common
    table only; ascending by the first number."""
    _, table_no, p, q = (k.as_py() for k in key)
    rep, comp, n, at = (rows.column(c).to_numpy() for c in ("rep", "label", "n_shingles", "block"))
    h = np.frombuffer(b"".join(rows.column("hashes").to_pylist()), np.uint32).reshape(-1, HASHES)
    left, right = np.flatnonzero(at == p), np.flatnonzero(at == q)
    step = max(1, 5 * PAIRS // max(1, len(right)))
    for k in range(0, len(left), step):
        i = left[k : k + step]
        near = (comp[i][:, None] != comp[right][None, :]) & (100 * np.minimum(n[i][:, None], n[right][None, :]) >= SIMILAR * np.maximum(n[i][:, None], n[right][None, :]))
        if p == q:
            near &= rep[i][:, None] < rep[right][None, :]
        u, v = np.nonzero(near)
        for z in range(0, len(u), PAIRS):
            x, y = i[u[z : z + PAIRS]], right[v[z : z + PAIRS]]
            same = h[x] == h[y]
            bands = same.reshape(len(x), 2, TABLES, BAND).all(axis=3)
            first = bands[:, 0].argmax(axis=1) * TABLES + bands[:, 1].argmax(axis=1)
            ok = (same.sum(axis=1) >= AGREE) & (first == table_no)
            yield x[ok], y[ok]


@tidied_group
def _partnered(key: tuple, rows: pa.Table) -> pa.Table:
    """The rows of a block that have a candidate in it."""
    some = np.zeros(rows.num_rows, bool)
    for x, y in _candidates(key, rows):
        some[x] = some[y] = True
    return rows.filter(pa.array(some))


@tidied_group
def _joined(key: tuple, rows: pa.Table) -> pa.Table:
    """Links (a, b), confirmed on full sets, that connect the same components of a block as all its links do."""
    sets = [np.frombuffer(m.as_py(), np.uint64) for chunk in rows.column("members").chunks for m in chunk]
    size = np.array([len(s) for s in sets], np.int64)
    begin = np.cumsum(size) - size
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(int(place.max()) + 1, bool)
    rep = rows.column("rep").to_numpy()
    _, comp = np.unique(rows.column("label").to_numpy(), return_inverse=True)
    found_a, found_b = [], []
    for x, y in _candidates(key, rows):
        edges = np.flatnonzero(np.diff(x, prepend=-1))
        for i, others in zip(x[edges].tolist(), np.split(y, edges[1:]), strict=False):
            others = others[comp[others] != comp[i]]
            if not len(others):
                continue
            mine = place[begin[i] : begin[i] + size[i]]
            own[mine] = True
            both = np.array([np.count_nonzero(own[place[begin[j] : begin[j] + size[j]]]) for j in others.tolist()], np.int64)
            own[mine] = False
            linked = others[100 * both >= SIMILAR * (size[i] + size[others] - both)]
            for j in linked.tolist():
                if comp[j] != comp[i]:
                    comp[comp == comp[j]] = comp[i]
                    found_a.append(min(rep[i], rep[j]))
                    found_b.append(max(rep[i], rep[j]))
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def near_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, file, row, stays) for each row of docs (doc_id, text); docs is located.
    stays: one row of each component, of the smallest doc_id, and rows with an empty set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *locator())
    signed = written(docs.mapInArrow(_sign, "doc_id long, file long, row long, n_shingles long, digest binary, hashes binary, bands array<long>"), "signed")
    # a class: its first row, and what only depends on its set
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("first")
    classes = signed.where("digest is not null").groupBy("digest").agg(first, F.first(F.struct("n_shingles", "hashes", "bands")).alias("own"))
    reps = written(classes.select(F.monotonically_increasing_id().alias("rep"), "digest", "first", "first.file", "first.row", "own.*"), "classes")

    # 2: band values that recur, and the keys of all tables formed from them
    spread = reps.select("rep", F.posexplode("bands").alias("place", "value"))
    shared = spread.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    kept = spread.join(shared, "value").groupBy("rep").agg(
        F.collect_list(F.when(F.col("place") < TABLES, F.struct("place", "value"))).alias("x"), F.collect_list(F.when(F.col("place") >= TABLES, F.struct("place", "value"))).alias("y")
    )
    keys = kept.select("rep", F.explode("x").alias("x"), "y").select("rep", "x", F.explode("y").alias("y"))
    keys = written(keys.select("rep", (F.col("x.place") * TABLES + F.col("y.place") - TABLES).alias("table_no"), F.xxhash64("x.value", "y.value").alias("key")), "keys")
    stars = keys.groupBy("key", "table_no").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")

    # 3: stars
    pairs = keys.join(stars, ["key", "table_no"]).where("rep > a").select("a", F.col("rep").alias("b")).distinct()
    light = reps.select("rep", "hashes", "n_shingles")
    left, right = (light.select(F.col("rep").alias(c), F.col("hashes").alias(f"h{c}"), F.col("n_shingles").alias(f"n{c}")) for c in "ab")
    near = pairs.join(right, "b").join(left, "a").where(f"100 * least(na, nb) >= {SIMILAR} * greatest(na, nb)").select("a", "b", "ha", "hb")
    pairs = written(near.mapInArrow(_agreeing, "a long, b long"), "pairs")
    labels = components(written(confirm(pairs, docs, reps), "links"))

    # 4: what is left in buckets of several components
    labelled = light.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = written(labelled, "labelled")
    own = keys.join(labelled, "rep")
    parts = own.groupBy("key", "table_no", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    whole = parts.groupBy("key", "table_no").agg(F.max(F.struct("n", "s", "label")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    mixed = whole.where("parts > 1").select("key", "table_no", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.s")).alias("inner"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("outer"))
    rest = own.join(mixed, ["key", "table_no"])
    inside, place, most = F.col("label") == F.col("main"), F.xxhash64("rep"), F.col("inner") + F.col("outer") - 1
    rest = rest.withColumn("block", F.when(inside, F.pmod(place, "inner")).otherwise(F.col("inner") + F.pmod(place, "outer")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.when(inside, F.col("inner")).otherwise(F.lit(0)), most)))
    rest = rest.select("rep", "key", "table_no", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "label", "n_shingles", "hashes")
    block = ["key", "table_no", "p", "q"]
    some = written(rest.groupBy(*block).applyInArrow(_partnered, rest.schema), "some")
    sets = full_sets(written(some.select("rep").distinct(), "ids"), docs, reps)
    found = written(some.join(sets, "rep").groupBy(*block).applyInArrow(_joined, "a long, b long").distinct(), "links")
    at = labelled.select("rep", "label")
    joined = found.join(at.withColumnsRenamed({"rep": "a", "label": "la"}), "a").join(at.withColumnsRenamed({"rep": "b", "label": "lb"}), "b").where("la <> lb")
    merged = components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    final = at.join(merged.select(F.col("node").alias("label"), F.col("label").alias("lower")), "label", "left").select("rep", F.coalesce("lower", "label").alias("label"))

    named = reps.select("rep", "digest", "first").join(final, "rep").select("digest", "first", "label")
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    by_digest = written(named.join(heads, "label").select("digest", "head"), "heads")
    out = signed.select("doc_id", "file", "row", "n_shingles", "digest").join(few_rows(by_digest, BROADCAST_ROWS // 5), "digest", "left")
    alone = F.col("digest").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id"))
    stays = alone | ((F.col("file") == F.col("head.file")) & (F.col("row") == F.col("head.row")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "file", "row", stays.alias("stays"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    return near_rows(located(docs)).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns as they were."""
    docs = located(docs)
    return without(docs, written(near_rows(docs).where("not stays").select("file", "row"), "gone"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLES: dict[str, str] = {}
