"""Language identification, word first.

A word that training knows scores each language by the log of its relative frequency there. A word it doesn't know is scored
by its character n-grams, of the longest length of which training knows any in it, then of shorter ones: the mean log
frequency of those n-grams. Scores of a text's words add up; the posterior of the best language is the text's score.

Training counts all words, and all n-grams of them, of a sample of the labelled documents: about SAMPLE of them (all there
are, if fewer; chosen by a hash of doc_id), and about RARE at least of each language. A word or n-gram is known from LEAST
occurrences on, with its count in every language; there is no other bound, so the model's size goes with the sample's.
Words and n-grams are held as 64-bit hashes.

Defined cases: text that is null or has no letter is `und` with score 0; without any learned language every text is `und`;
ties go to the alphabetically first language; repeated rows each get a row; a row with a null doc_id gets a prediction, is
never learned from, and its held_out is null. Extra columns are ignored, or kept as they are by keep_identified.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import documents, id_text, small_batches, table, text_steps, tidied, written
from ._words import HashIndex, hash_spans, mix, words

SAMPLE, RARE, LEAST = 20_000, 1_000, 2
LONGEST = 5
LEAST_SCORE = 0.5
#: Bytes of text that a worker scores in one step.
STEP = 1 << 20
_TIMES = np.random.default_rng(11).integers(0, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_letters: list[np.ndarray] = []
_scorers: dict[str, Scorer] = {}


def fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def code_points(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts one after the other, and where each text begins (one entry more than texts)."""
    data = np.frombuffer("".join(many).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.cumsum([0, *map(len, many)])


def gram_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words, each between two blanks, and the number of the word that each one is of."""
    size = ends - starts + 2
    begin = np.cumsum(size) - size
    many = np.maximum(size - n + 1, 0)
    padded = np.full(int(size.sum()), ord(" "), np.uint64)
    inner = np.repeat(begin + 1, size - 2) + np.arange(int((size - 2).sum())) - np.repeat(np.cumsum(size - 2) - size + 2, size - 2)
    padded[inner] = data[np.repeat(starts, size - 2) + inner - np.repeat(begin + 1, size - 2)]
    of = np.repeat(np.arange(len(size)), many)
    at = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(len(of))
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h += padded.take(at + k) * _TIMES[k]
    return mix(h), of


def train(rows: DataFrame, sample: int = SAMPLE, rare: int = RARE) -> dict:
    """Model of rows (doc_id, text, lang): languages, and for words (order 0) and n-grams hashes and log frequencies by
    language."""
    small_batches(rows.sparkSession)
    rows = rows.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))  # one row a language
    share = F.greatest(F.lit(sample) / F.sum("n").over(Window.partitionBy(F.lit(0))), F.lit(rare) / F.col("n"))
    limits = sizes.select("lang", F.ceil(F.least(share, F.lit(1.0)) * float(1 << 40)).alias("limit"))
    taken = rows.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("limit"))
    found = taken.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word"))
    counts = written(found.groupBy("lang", "word").agg(F.count("*").alias("times")), "words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return {"id": uuid.uuid4().hex, "langs": [], "orders": []}
    schema = pa.schema([("lang", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("times", pa.int64())])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for first in range(0, batch.num_rows, 50_000):
                part = batch.slice(first, 50_000)
                data, at = code_points(part.column("word").to_pylist())
                lang, times = (part.column(c).to_numpy().astype(np.int64) for c in ("lang", "times"))
                for n in range(LONGEST + 1):
                    h, of = gram_hashes(data, at[:-1], at[1:], n) if n else (hash_spans(data, at[:-1], at[1:]), np.arange(len(lang)))
                    for x in np.unique(lang).tolist():
                        own = lang[of] == x
                        value, place = np.unique(h[own], return_inverse=True)
                        total = np.bincount(place, times[of[own]]).astype(np.int64)
                        yield table({"lang": np.full(len(value), x), "n": np.full(len(value), n), "h": value.view(np.int64), "times": total}, schema)

    numbered = counts.select((F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int").alias("lang"), "word", "times")
    made = numbered.mapInArrow(grams, "lang int, n int, h long, times long").groupBy("n", "h", "lang").agg(F.sum("times").alias("times"))
    made = written(made, "grams")
    totals = np.ones((LONGEST + 1, len(langs)))
    for r in made.groupBy("n", "lang").agg(F.sum("times").alias("times")).collect():
        totals[r.n, r.lang] = r.times
    known = made.groupBy("n", "h").agg(F.sum("times").alias("all"), F.collect_list(F.struct("lang", "times")).alias("each")).where(F.col("all") >= LEAST)
    got = known.select("n", "h", "each").toArrow().combine_chunks()
    order, keys = got.column("n").to_numpy(), got.column("h").to_numpy().view(np.uint64)
    each = got.column("each").combine_chunks()
    row = np.repeat(np.arange(len(order)), np.diff(each.offsets.to_numpy()))
    lang, times = (each.flatten().field(c).to_numpy() for c in ("lang", "times"))
    # what a language hasn't counts there as half of one occurrence
    rates = np.log(0.5 / totals)[order] if len(order) else np.zeros((0, len(langs)))
    rates[row, lang] = np.log(times / totals[order[row], lang])
    rates = rates.astype(np.float32)
    return {"id": uuid.uuid4().hex, "langs": langs, "orders": [(keys[order == n], rates[order == n]) for n in range(LONGEST + 1)]}


class Scorer:
    """Scores texts by a model."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.orders = [(HashIndex(keys), np.concatenate([rates, np.zeros((1, len(self.langs)), np.float32)])) for keys, rates in model["orders"]]

    def word_rates(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log frequency by language of each word."""
        out = np.zeros((len(starts), len(self.langs)))
        index, rates = self.orders[0]
        at = index.find(hash_spans(data, starts, ends))
        known = at < len(rates) - 1
        out[known] = rates[at[known]]
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            index, rates = self.orders[n]
            h, of = gram_hashes(data, starts[left], ends[left], n)
            at = index.find(h)
            hit = at < len(rates) - 1
            at, of = at[hit], of[hit]
            many = np.bincount(of, minlength=len(left))
            some = many > 0
            for k in range(len(self.langs)):
                out[left[some], k] = np.bincount(of, rates[at, k], len(left))[some] / many[some]
            left = left[~some]
        return out

    def predict(self, many: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(many), np.zeros(len(many))
        if not self.langs:
            return names, scores
        data, offsets = code_points([t.lower() if t else "" for t in many])
        starts, ends, of = words(data, offsets, letters().take(data)) if len(data) else (np.zeros(0, np.int64),) * 2 + (np.zeros(len(offsets), np.int64),)
        if not len(starts):
            return names, scores
        h = hash_spans(data, starts, ends)
        _, first, place = np.unique(h, return_index=True, return_inverse=True)
        first_order = np.argsort(first)  # spans have to ascend
        number = np.empty(len(first), np.int64)
        number[first_order] = np.arange(len(first))
        rates = self.word_rates(data, starts[first[first_order]], ends[first[first_order]])
        texts = np.flatnonzero(np.diff(of))
        total = np.add.reduceat(rates[number[place]], of[:-1][texts], axis=0)
        best = total.argmax(axis=1)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        scores[texts] = p[np.arange(len(texts)), best] / p.sum(axis=1)
        for k, b in zip(texts.tolist(), best.tolist(), strict=True):
            names[k] = self.langs[b]
        return names, scores


def scorer(shared: Broadcast) -> Scorer:
    """One per worker process and model; an earlier model's goes."""
    model = shared.value
    if model["id"] not in _scorers:
        _scorers.clear()
        _scorers[model["id"]] = Scorer(model)
    return _scorers[model["id"]]


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the sample's vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared)
        for batch in tidied(batches):
            for a, b in text_steps(batch.column("text"), STEP):
                names, scores = own.predict(batch.column("text")[a:b].to_pylist())
                yield table({"doc_id": batch.column("doc_id")[a:b], "lang_pred": names, "score": scores}, schema)

    return id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is found with a score of `least` or more."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared)
        for batch in tidied(batches):
            for a, b in text_steps(batch.column(at), STEP):
                names, scores = own.predict(batch.column(at)[a:b].to_pylist())
                yield batch.slice(a, b - a).filter(pa.array([x != "und" and s >= least for x, s in zip(names, scores.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(fold(3) != 1)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, train(training_rows(docs)))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
