"""Text sources, stores and filters on made-up files and tables."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from sparkglyph.functions import text as T
from sparkglyph.operators import personal as U
from sparkglyph.operators import phrases as P
from sparkglyph.sources import store
from sparkglyph.sources import text as S


def put(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_lines_and_lists(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write("one\ntwo\nthree\n")
    assert S.lines(spark, str(tmp_path / "a.gz"), 2).count() == 2
    rows = S.tsv(spark, put(tmp_path / "b.tsv", "a\tb\tc\nd\te\n\tx\t\n"), ("p", "q", "r"))
    assert sorted(map(tuple, rows.collect())) == [("", "x", ""), ("a", "b", "c")]
    good = S.counts_strict(spark, put(tmp_path / "c.tsv", "# head\n\nthe\t5\nof\t3\n"))
    assert sorted(map(tuple, good.collect())) == [("of", 3), ("the", 5)]
    for k, bad in enumerate(("the\t0", "the\tx", "the", "a\tb\t1")):
        with pytest.raises(Exception, match="expected a word"):
            S.counts_strict(spark, put(tmp_path / f"bad{k}.tsv", bad)).collect()
    pairs = S.pair_counts(spark, put(tmp_path / "d.tsv", "Of the\t5\nof the\t2\nof\t1\na b c\t1\nof x1\t9\nin it\tmany\n"))
    assert list(map(tuple, pairs.collect())) == [("of", "the", 7)]
    words = S.frequency_list(spark, put(tmp_path / "e.txt", "the 50\nOf 40\na 99\nx1 9\nold 1\nword\n"), least=2, most=2)
    assert list(map(tuple, words.collect())) == [("the", 50), ("of", 40)]


def test_records(spark, tmp_path):
    entries = [json.dumps({"word": "a b", "pos": "noun", "senses": [{"glosses": ["g1", "g2"]}]}), "{broken", json.dumps({"word": "c", "senses": []}), ""]
    got = S.dictionary_entries(spark, put(tmp_path / "a.json", "\n".join(entries)))
    assert sorted(map(tuple, got.collect())) == [("a b", "noun", "g1"), ("c", "", "")]
    posts = '<Session><Posts><Post class="Statement">10-19-20sUser7 well this is “fine” now…</Post><Post class="System">JOIN a b c d e</Post><Post class="Emotion">lol ha ha ha ha</Post><Post class="Greet">hi you</Post></Posts></Session>'
    assert [r.sentence.split() for r in S.chat_posts(spark, put(tmp_path / "p.xml", posts)).collect()] == [["well", "this", "is", "fine", "now"]]
    lines = "L1 +++$+++ u0 +++$+++ m0 +++$+++ ANN +++$+++ Caf\xe9 is where we all go now. It is closed. They said it would be open all day!\nbroken +++$+++ line\n"
    said = sorted(r.sentence for r in S.dialogue_sentences(spark, put(tmp_path / "d.txt", lines, "iso-8859-1")).collect())
    assert said == ["Caf\xe9 is where we all go now.", "They said it would be open all day!"]
    emoji = "# group: Hands\n# subgroup: x\n1F44B ; fully-qualified # \U0001f44b E0.6 waving\n1F44B 1F3FB ; fully-qualified # \U0001f44b\U0001f3fb E1.0 waving light\n263A ; unqualified # ☺ E0.6 face\n# group: Empty\n# group: Food\n1F34E ; fully-qualified # \U0001f34e E0.6 apple\n"
    got = S.emoji_test(spark, put(tmp_path / "e.txt", emoji)).orderBy("category_no", "place").collect()
    assert [(r.category, r.base, r.variants) for r in got] == [("Hands", "\U0001f44b", ["\U0001f44b\U0001f3fb"]), ("Food", "\U0001f34e", [])]


def test_stores(spark, tmp_path):
    model = spark.createDataFrame([("a", 1, "x", 1.0, 7), ("a", 2, "y", 0.5, 7), ("b c", 1, "x", 1.0, 3)], "ctx string, rank int, w string, score double, support long")
    store.write_model_json(model, str(tmp_path / "m"))
    assert sorted(map(tuple, store.read_model_json(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, model.collect()))
    nested = put(tmp_path / "n.json", json.dumps({"a": {"followers": [["x", 1.0], ["y", 0.5]], "support": 7}}))
    flat = put(tmp_path / "f.json", json.dumps({"b": [["z", 0.25]]}))
    assert sorted(map(str, map(tuple, store.import_model_json(spark, [nested, flat]).collect()))) == ["('a', 1, 'x', 1.0, 7)", "('a', 2, 'y', 0.5, 7)", "('b', 1, 'z', 0.25, None)"]
    counts = spark.createDataFrame([(1, "", "a", 3), (2, "a", "b", 2)], "n int, ctx string, w string, count long")
    assert sorted(map(tuple, store.counted(counts).collect())) == [(1, "", "a", 3), (2, "a", "b", 2)]
    store.write_pack(str(tmp_path / "pack"), spark.createDataFrame([(0, "a"), (1, "b")], "word_id long, w string"), followers=model)
    vocabulary, header = store.open_pack(spark, str(tmp_path / "pack"))
    assert vocabulary.count() == header["words"] == 2
    spark.createDataFrame([("OTHER", 1, 2)], "magic string, version int, words long").write.mode("overwrite").parquet(str(tmp_path / "pack/header"))
    with pytest.raises(ValueError, match="isn't a pack"):
        store.open_pack(spark, str(tmp_path / "pack"))


def test_cleaning(spark):
    rows = spark.createDataFrame([("ANN SMITH:",), ("- Well, hello there you",), ("  ",), ("",), ("Too short",), ("-One two three",)], "line string")
    got = sorted((r.clean, r.reason) for r in T.cleaned(rows).collect())
    assert got == sorted([("ANN SMITH:", "label"), ("Well, hello there you", "kept"), ("Too short", "short"), ("One two three", "kept")])
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(T.without_boilerplate, "x *** START OF BOOK *** body *** END OF BOOK *** y") == " body "
    assert one(T.without_boilerplate, "no markers") == "no markers"
    assert one(T.without_markdown, "# Head\n`x` [link](u) ![i](u) a_b ```c\nd``` e").split() == ["Head", "link", "a", "b", "e"]
    assert one(T.without_mentions, "11-08-teensUser12.. hi") == "hi"
    assert one(T.plain_typography, "“a” ‘b’ c—d…") == "a 'b' c d "
    assert [one(T.is_inflection, g) for g in ("Plural of x", "past tense of y", "a plural of", None)] == [True, True, False, False]
    years = spark.createDataFrame([("of_ADP The_DET", 1990, 5), ("of the", 2000, 7), ("of the", 1800, 9), ("of 1", 2000, 1)], "ngram string, year int, match_count long")
    assert list(map(tuple, P.collapse_years(years, 1900).collect())) == [("of the", 12)]
    ctx, prefix = T.typed(F.col("t"))
    ends = spark.createDataFrame([("I Want ",), ("I want to",), ("to",), ("",)], "t string").select(ctx, prefix).collect()
    assert list(map(tuple, ends)) == [("want", ""), ("want", "to"), ("", "to"), ("", "")]


def test_eviction(spark):
    """Recorded one by one with a bound on followers, against a fold in plain Python."""
    import random

    draw = random.Random(4)
    said = [(u, k, draw.choice("abcdefgh")) for u in range(4) for k in range(120)]
    events = spark.createDataFrame([(u * 1000 + k, u, w, k) for u, k, w in said], "event_id long, user_id long, event_type string, k int").withColumn("ts", F.timestamp_seconds("k"))
    want = {}
    for u in range(4):
        words, held = [w for v, _, w in said if v == u], {}
        for tick, (prev, w) in enumerate(zip(words, words[1:], strict=False)):
            own = held.setdefault(prev, {})
            dee, last = own.pop(w, (0.0, tick)) if w not in own else own[w]
            own[w] = (dee + math.exp((last - tick) / 200), tick)
            if len(own) > 3:
                least = min(d for d, _ in own.values())
                del own[[x for x, (d, _) in own.items() if d == least][-1]]
        want |= {(u, p, w): (round(d, 9), t) for p, own in held.items() for w, (d, t) in own.items()}
    got = {(r.user_id, r.prev, r.w): (round(r.dee, 9), r.last_tick) for r in U.recorded(events, most=3).collect()}
    assert got == want and max(sum(1 for k in want if k[:2] == p) for p in {k[:2] for k in want}) == 3


def test_nodes(spark):
    words = spark.createDataFrame([("ab", 3), ("abc", 5), ("x", 1)], "w string, count long")
    assert {r.prefix: r.most for r in U.prefix_maxima(words).collect()} == {"a": 5, "ab": 5, "abc": 5, "x": 1}
    assert U.pruned_dictionary(words, most_nodes=5).count() == 3
    assert [r.w for r in U.pruned_dictionary(words, most_nodes=4, keep=1).collect()] == ["abc"]
