"""Every query of the n-gram engine against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from sparkglyph.operators import counts as C
from sparkglyph.operators import models as M
from sparkglyph.operators import smoothing as S
from sparkglyph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "benchmark", "events", "nation")


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_streamed_equals_batch(spark):
    from sparkglyph.operators import personal

    batch = personal.word_frequencies(spark.read.parquet(f"{SF}/events.parquet")).collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, catalog.QUERIES["stream_word_frequencies"](spark, SF).collect()))


def test_empty_and_null_lines(spark):
    from sparkglyph.functions.text import lines
    from sparkglyph.operators.counts import ngram_counts

    docs = spark.createDataFrame([(None,), ("",), ("one",), ("Say it, say it\nso",)], "text string")
    got = {(r.n, r.ctx, r.w): r["count"] for r in ngram_counts(lines(docs)).collect()}
    assert got == {(1, "", "one"): 1, (1, "", "say"): 2, (1, "", "it"): 1, (1, "", "so"): 1, (2, "say", "say"): 1, (2, "say", "it"): 1, (3, "say say", "it"): 1}


def test_textbook_discounts_are_lower(spark):
    from sparkglyph.operators.smoothing import katz_discounts

    counts = spark.createDataFrame([(2, "c", f"w{i}-{r}", r) for r, n in ((1, 100), (2, 40), (3, 20), (4, 12), (5, 8), (6, 5)) for i in range(n)], "n int, ctx string, w string, count long")
    plain, book = ({r.r: r.d for r in katz_discounts(counts, textbook=t).collect()} for t in (False, True))
    assert all(book[r] < plain[r] <= 1 for r in book)


def test_unpruned_trigrams_by_brute_force(spark, tmp_path):
    """Every observed context has its list, from its own followers and all of the bigram backoff."""
    from collections import Counter, defaultdict

    import numpy as np

    draw = np.random.default_rng(7)
    words = [a + b for a in "abcdefg" for b in "uvwxyz"]
    lines = [[words[int(x)] for x in draw.zipf(1.4, 9) % len(words)] for _ in range(300)]
    pd.DataFrame({"text": [" ".join(x) for x in lines]}).to_parquet(f"{tmp_path}/documents.parquet")
    bi, tri = Counter(), Counter()
    for x in lines:
        bi.update(zip(x, x[1:], strict=False))
        tri.update(zip(x, x[1:], x[2:], strict=False))
    pairs, after, follows = Counter(w for _, w in bi), defaultdict(dict), defaultdict(dict)
    for (a, w), n in bi.items():
        after[a][w] = n
    for (a, b, w), n in tri.items():
        follows[a, b][w] = n

    def scored(own, low):
        total = sum(own.values())
        return {w: max(own.get(w, 0) - 0.75, 0) / total + 0.75 * len(own) / total * low.get(w, 0) for w in own.keys() | low.keys()}

    low = {a: {w: x for w, x in scored(own, {w: pairs[w] / len(bi) for w in own}).items()} for a, own in after.items()}
    want = {}
    for (a, b), own in follows.items():
        raw = sorted(scored(own, low[b]).values(), reverse=True)[:10]
        want[f"{a} {b}"] = [x / raw[0] for x in raw]
    got = defaultdict(list)
    for r in catalog.QUERIES["kn_trigram_unpruned"](spark, str(tmp_path)).orderBy("ctx", "rank").collect():
        got[r.ctx].append(r.score)
        own, (a, b) = follows[tuple(r.ctx.split())], r.ctx.split()
        assert r.support == sum(own.values()) and r.w in after[b]
    assert got.keys() == want.keys() and min(map(lambda x: sum(x.values()), follows.values())) < 10
    assert all(got[c] == pytest.approx(want[c], abs=1e-4) for c in want)


def test_phrases_from_whole_texts(spark, tmp_path):
    items = ["One two three four five six", "a b", "it's two Three four 5 six seven eight", "zz one two three"]
    pd.DataFrame({"item_id": range(len(items)), "text": items}).to_parquet(f"{tmp_path}/benchmark.parquet")
    pd.DataFrame({"text": ["say one two three four now", "six seven eight"]}).to_parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, text in enumerate(items):
        t = text.lower().split()
        for n in (3, 4, 5):
            for i in range(len(t) - n + 1):
                if "5" not in t[i : i + n]:
                    want.setdefault(" ".join(t[i : i + n]), k)
    assert {r.phrase: r["at"] for r in catalog.QUERIES["phrase_candidates"](spark, str(tmp_path)).collect()} == want
    counts = {r.phrase: r["count"] for r in catalog.QUERIES["phrase_counts"](spark, str(tmp_path)).collect()}
    assert counts == dict.fromkeys(["one two three", "two three four", "one two three four", "six seven eight"], 1)
    common = {r.phrase for r in catalog.QUERIES["phrase_all_common"](spark, str(tmp_path)).collect()}
    assert common == {p for p in want if set(p.split()) <= set("say one two three four now six seven eight".split())}


def test_lines_are_cut_once(spark):
    lines = spark.createDataFrame([("a  b c\x85D'e, f　" + "x" * 31 + " g\x1c" + "y" * 30 + " \t",), ("",), (None,)], "line string")
    counted = C.ngram_counts(lines, (2,))
    assert sum("lower(line" in x for x in counted._jdf.queryExecution().optimizedPlan().toString().split("\n")) == 1
    t = ["a", "b", "c", "f", "g", "y" * 30]
    assert {(r.ctx, r.w) for r in counted.collect()} == set(zip(t, t[1:]))


def test_only_asked_contexts_are_counted(spark, monkeypatch):
    lines = spark.createDataFrame([("a b c a b d b c",), ("b c a",)], "line string")
    only = spark.createDataFrame([("a b",), ("x y",)], "ctx string")
    rows = lambda: {(r.n, r.ctx, r.w, r["count"]) for r in C.ngram_counts(lines, (2, 3), {3: only}).collect()}
    every = {(r.n, r.ctx, r.w, r["count"]) for r in C.ngram_counts(lines, (2, 3)).collect()}
    assert rows() == {x for x in every if x[0] == 2 or x[1] == "a b"}
    monkeypatch.setattr(C, "FEW", 1)
    assert rows() == every


def test_totals_come_with_the_counts(spark):
    lines = spark.createDataFrame([("a b c a b d b c",), ("b c a",)], "line string")
    made = C.totalled_counts(lines, (1, 2, 3))
    plain = C.ngram_counts(lines, (1, 2, 3))
    assert sorted(made.select("n", "ctx", "w", "count").collect()) == sorted(plain.collect())
    for n in (2, 3):
        assert sorted(C.with_totals(made, n, 2).collect()) == sorted(C.with_totals(plain, n, 2).collect())
    plan = C.with_totals(C.totalled_counts(lines, (2, 3)), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_katz_backoff_lists_unseen_words_without_a_join_of_all_seen(spark, tmp_path):
    lines = spark.createDataFrame([("a b c a b d b c a a b",), ("b c a e",)], "line string")
    found = S.katz_trigrams(C.totalled_counts(lines, (1, 2, 3)), least=1)
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
    seen = {(r.ctx, r.w) for r in C.of_order(C.ngram_counts(lines, (3,)), 3).collect()}
    rows = [(r.ctx, r.w) for r in found.collect()]
    assert len(rows) == len(set(rows)) and seen <= set(rows)


def test_one_order_is_counted_before_it_is_dealt(spark):
    lines = spark.createDataFrame([("a b c a b d b c",), ("b c a",)] * 3, "line string")
    made = C.totalled_counts(lines, (2,))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("partial_count") == 1
    assert plan.index("Window") < plan.index("Exchange hashpartitioning") < plan.index("partial_count")


def test_best_followers_without_ranks(spark):
    """tops() of rows is what it is of their ranked lists, with ties and contexts of more than ten followers."""
    rows = [("t", w, 0.5, 9) for w in "zyb"] + [("m", f"w{i:02}", 1.0 - (i % 7) / 10, 30) for i in range(13)] + [("o", "x", 0.25, 1)]
    rows = spark.createDataFrame(rows, "ctx string, w string, raw double, support long")
    want, got = M.tops(S.top_followers(rows), "a"), M.tops(rows, "a")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert {(r.ctx, r.top_a, r.n_a) for r in got.collect()} == {("t", "b", 3), ("m", "w00", 10), ("o", "x", 1)}


@pytest.mark.parametrize("name", ["compare_three_way", "top_disagreements"])
def test_comparisons_rank_nothing(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "strategy=shuffle_hash" in plan


def test_each_place_is_dealt_once(spark, monkeypatch):
    lines = spark.createDataFrame([("a b c a b d b c",), ("b c a",), ("",), (None,), ("a",), ("e f",), ("a b",), ("it's 5 a b c",)], "line string")
    cut, tokens = [], C.tokens
    monkeypatch.setattr(C, "tokens", lambda line: cut.append(1) or tokens(line))
    made = C.three_orders(lines)
    assert len(cut) == 1
    want = C.totalled_counts(lines, (1, 2, 3))
    assert made.columns == want.columns and len(made.collect()) == want.count()
    assert {tuple(r) for r in made.collect()} == {tuple(r) for r in want.collect()}


def test_pruned_contexts_are_dealt_once_for_sums_and_ranks(spark):
    lines = spark.createDataFrame([("a b c a b d b c a b c",), ("b c a e a b d",)] * 3, "line string")
    found = S.top_followers(S.pruned_trigrams(C.three_orders(lines)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("ShuffledHashJoin")]  # what follows the last join moves nothing
    counts = C.totalled_counts(lines, (1, 2, 3))
    both, _, beta = S._katz_parts(counts, S.LEAST, S.FOLLOWERS, False)
    assert {(r.ctx, r.w) for r in found.collect()} <= {(r.ctx, r.w) for r in both.collect()} and beta.where("beta > 0").count() == 0
    assert found.where("ctx = 'a b'").count() == 2
