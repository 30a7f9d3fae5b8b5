"""Quality scores by naive Bayes support vectors.

Features are indicators of n-grams, hashed to 2^BITS places: words and pairs of words, and shapes, pairs and triples of
shapes (a shape is a word with runs of small letters, capitals and digits shortened to one sign each, marked if the word
repeats the one before). Each place is scaled by the log ratio of its smoothed document frequencies in the two classes; a
linear hinge-loss model of the scaled, normalised indicators is fitted by dual coordinate descent, and a logistic curve
fitted to its training margins gives the score.

Training takes at most SAMPLE labelled rows (all there are, if fewer; chosen by a hash of doc_id). The model is 2^BITS
numbers, whatever the corpus.

Defined cases: null and empty texts have no features and get the score of the model's bias; with no labels, or of one
class only, every score is the share of label 1 (0.5 without any); repeated rows each get a row; a row with a null doc_id is
scored, never learned from, and its held_out is null; of labels that aren't 0 or 1 nothing is learned; an empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import buffers, documents, id_text, table, text_steps
from ._words import hash_spans, mix, words
from .language_id import fold

BITS, SAMPLE, EPOCHS, COST = 20, 12_000, 8, 1.0
PREDICTED = 0.3

_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("0")
_KIND[0x80:] = ord("a")


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Ascending distinct places of each text's n-grams."""
    starts, ends, of = words(data, offsets)
    w = hash_spans(data, starts, ends)
    kind = _KIND[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    at = np.cumsum(keep)
    short, fine = kind[keep], at - 1
    shape = hash_spans(short, fine[starts], fine[ends - 1] + 1) if len(starts) else np.zeros(0, np.uint64)
    again = np.zeros(len(w), bool)
    again[1:] = w[1:] == w[:-1]
    again[of[:-1][of[:-1] < len(w)]] = False
    shape = mix(shape + again.astype(np.uint64))
    salted = []
    for salt, (x, width) in enumerate(((w, 1), (w, 2), (shape, 1), (shape, 2), (shape, 3))):
        many = max(0, len(x) - width + 1)
        s = np.full(many, salt, np.uint64)
        for k in range(width):
            s = mix(s * np.uint64(5) + x[k : k + many])
        salted.append((s >> np.uint64(64 - BITS)).astype(np.int32))
    widths = (1, 2, 1, 2, 3)
    return [np.unique(np.concatenate([s[a : max(a, b - k + 1)] for s, k in zip(salted, widths, strict=True)])) for a, b in zip(of[:-1], of[1:], strict=True)]


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(weights of places, scales of places, bias, slope, shift): score = 1 / (1 + exp(-(slope * margin + shift)))."""
    size = 1 << BITS
    weights = np.zeros(size, np.float32)
    share = float(labels.mean()) if len(labels) else 0.5
    if len(np.unique(labels)) < 2:
        odds = min(max(share, 1e-6), 1 - 1e-6)
        return weights, weights, 0.0, 0.0, float(np.log(odds / (1 - odds)))
    n = [np.ones(size), np.ones(size)]
    for x, y in zip(rows, labels, strict=True):
        n[y][x] += 1
    many = np.bincount(labels, minlength=2) + 2.0
    ratio = (np.log(n[1] / many[1]) - np.log(n[0] / many[0])).astype(np.float32)
    ratio[(n[0] == 1) & (n[1] == 1)] = 0
    scaled = []
    for x in rows:
        v = ratio[x]
        scaled.append(v / max(1e-9, float(np.sqrt((v * v).sum()))))
    sign = np.where(labels == 1, 1.0, -1.0)
    cost = COST * len(labels) / (2 * np.bincount(labels))[labels]  # both classes weigh the same
    alpha, bias, w = np.zeros(len(rows)), 0.0, np.zeros(size, np.float32)
    norm = np.array([float((v * v).sum()) for v in scaled]) + 1.0
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            x, v, y = rows[k], scaled[k], sign[k]
            gradient = y * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[k] - gradient / norm[k], 0.0), cost[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * y
                w[x] += np.float32(step) * v
                bias += step
                alpha[k] = new
    margin = np.array([float(w[x] @ v) for x, v in zip(rows, scaled, strict=True)]) + bias
    slope, shift = 1.0, 0.0
    target = np.where(labels == 1, (many[1] - 1) / many[1], 1 / many[0])
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * slope, (p - target).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum()]])
        d = np.linalg.solve(h, g)
        slope, shift = slope - float(d[0]), shift - float(d[1])
        if abs(d).max() < 1e-9:
            break
    return w * ratio, ratio, bias, slope, shift


def train(rows: DataFrame, sample: int = SAMPLE) -> tuple:
    """Model of rows (doc_id, text, label 0 or 1), fitted in one task on at most about `sample` rows."""
    there = rows.count()
    if there > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < math.ceil(sample / there * (1 << 40)))
    found = pa.schema([("label", pa.int32()), ("places", pa.binary())])
    out = pa.schema([("weights", pa.binary()), ("ratio", pa.binary()), ("bias", pa.float64()), ("slope", pa.float64()), ("shift", pa.float64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_steps(batch.column("text")):
                yield table({"label": batch.column("label")[a:b], "places": [x.tobytes() for x in features(*buffers(batch.column("text")[a:b]))]}, found)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, labels = [], []
        for batch in batches:
            places += [np.frombuffer(x.as_py(), np.int32) for x in batch.column("places")]
            labels += batch.column("label").to_pylist()
        order = sorted(range(len(places)), key=lambda k: (places[k].tobytes(), labels[k]))  # rows come in any order
        weights, ratio, bias, slope, shift = fit([places[k] for k in order], np.array([labels[k] for k in order], np.int64))
        yield table({"weights": [weights.astype(np.float32).tobytes()], "ratio": [ratio.astype(np.float32).tobytes()], "bias": [bias], "slope": [slope], "shift": [shift]}, out)

    made = rows.select("label", "text").mapInArrow(look, "label int, places binary")
    row = made.repartition(1).mapInArrow(learn, "weights binary, ratio binary, bias double, slope double, shift double").first()
    ratio = np.frombuffer(row.ratio, np.float32)
    return np.frombuffer(row.weights, np.float32), ratio * ratio, row.bias, row.slope, row.shift


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, square, bias, slope, shift = shared.value
        for batch in batches:
            for a, b in text_steps(batch.column("text")):
                margin = []
                for x in features(*buffers(batch.column("text")[a:b])):
                    margin.append(float(weights[x].sum()) / max(1e-9, float(np.sqrt(square[x].sum()))) + bias)
                scores = 1 / (1 + np.exp(-np.clip(slope * np.array(margin) + shift, -30, 30)))
                yield table({"doc_id": batch.column("doc_id")[a:b], "score": scores}, schema)

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with their quality label, the held-out fifth left out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(fold(5) != 0)
    return id_text(docs).join(marked, "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score(docs, train(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
