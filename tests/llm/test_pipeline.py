"""The pipeline against a brute-force version, on the smallest tables and on odd and empty ones."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkglyph.llm import language_id
from sparkglyph.llm._tokens import default_tokenizer

SF = "/root/testdata/sf0.001"
RULES = ((re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def masked(text):
    spans = sorted((m.start(), m.end()) for p, g, n in RULES for m in p.finditer(text) if m.end(g) - m.start(g) >= n)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def brute(rows, identified):
    """doc_id -> text after stages 1 to 4, by rows (doc_id, text) with distinct ids."""
    groups = defaultdict(list)
    for d, t in rows:
        if identified[d]:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d, t or ""))
    rest = sorted((d, t) for _, d, t in map(min, groups.values()))
    sets, least = [shingles(t) for _, t in rest], list(range(len(rest)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and least[i] != least[j] and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    return {d: masked(t) for k, (d, t) in enumerate(rest) if least[k] == k}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = language_id.identify(docs, language_id.train(language_id.training_rows(docs))).collect()
    identified = {r.doc_id: r.lang_pred != "und" and r.score >= language_id.LEAST_SCORE for r in said}
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], identified)
    tok = Tokenizer.from_file(default_tokenizer())
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys() and len(want) < docs.count()
    for d, text in want.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        at = 0
        for _, (start, length, crc) in sorted(pieces[d].items()):
            assert start == at and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024


@pytest.mark.parametrize("rows", [0, 6])
def test_odd_tables(spark, tmp_path, rows):
    """An empty table, and one with nulls, repeated ids and a column whose name operators use."""
    texts = ["the cat sat on the mat and the dog sat on the rug", None, "", "the cat and the dog and the cat again here", "the cat and the dog and the cat again here", "password=abcdefgh the cat said to the other cat"][:rows]
    names = {"doc_id": pa.array([1, 2, None, 4, 4, 1][:rows], pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * rows, pa.string()), "source": pa.array(["s"] * rows, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "file": pa.array(["f"] * rows, pa.string())}
    pq.write_table(pa.table(names), f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:  # language learns nothing reliable of six rows
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(names), name
    left = sorted((str(r.doc_id), r.text or "", r.n_chars) for r in docs.collect())
    want = [("1", texts[0], len(texts[0])), ("1", "[SECRET] the cat said to the other cat", 38), ("2", "", 0), ("4", texts[3], len(texts[3]))] if rows else []
    assert left == sorted(want)
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path))
    assert packed.agg(F.count("*")).first()[0] == len(want)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= rows
