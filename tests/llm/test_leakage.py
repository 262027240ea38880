import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spliceframe.llm import leakage as lk


def test_words():
    assert lk.words_of(["A<b>b</b>c &amp;d&nbsp;[quote=x]Éf[/quote] 1,5 a_b а&lt;i&gt;"]) == [["a", "b", "c", "d", "éf", "1", "5", "a", "b", "a", "i"]]
    assert lk.words_of(["", "<br/>"]) == [[], []]
    assert lk.words_of(["[see this] a < b > c"]) == [["see", "this", "a", "b", "c"]]


def _truth(docs, items):
    out = set()
    for i, t in items:
        if i is None or t is None:
            continue
        words = lk.words_of([t])[0]
        size = min(13, len(words))
        grams = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if size else set()
        for d, text in docs:
            if d is not None and text is not None:
                own = lk.words_of([text])[0]
                if any(tuple(own[k : k + size]) in grams for k in range(len(own) - size + 1)) and size:
                    out.add((d, i))
    return out


@pytest.mark.parametrize("shard, rows", [(100, 50_000), (250_000, 50_000), (1000, 8)])
def test_equals_brute_force(spark, monkeypatch, shard, rows):
    monkeypatch.setattr(lk, "SHARD_WORDS", shard)
    monkeypatch.setattr(lk, "ITEM_ROWS", rows)
    r = random.Random(shard)
    word = lambda: r.choice("abcdefgh") * r.choice([1, 1, 2])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 12, 13, 14, 40])))) for i in range(20)]
    items += [(20, items[5][1]), (21, ""), (22, None), (None, "a b"), (23, "..."), (24, "zz " * 13)]
    docs = [(d, " ".join(word() for _ in range(r.randrange(40)))) for d in range(80)]
    for d in range(80, 140):
        t = r.choice(items)[1] or ""
        w = t.split()
        a = r.randrange(len(w)) if w else 0
        docs.append((d, docs[d - 80][1] + " <b>" + "  ".join(w[a : a + r.randrange(1, 30)]).upper() + "</b> tail"))
    docs += [(500, None), (None, items[3][1]), (501, ""), (502, "zz " * 5000), docs[100], docs[100]]
    ddl = "string"
    d = spark.createDataFrame(docs, f"doc_id long, text {ddl}").repartition(3)
    i = spark.createDataFrame(items, f"item_id long, item_text {ddl}")
    want = _truth(docs, items)
    assert {tuple(x) for x in lk.leaked(d, i).collect()} == want and want


@pytest.mark.parametrize("shard", [7, 20, 250_000])
def test_spans_merge(spark, monkeypatch, shard):
    monkeypatch.setattr(lk, "SHARD_WORDS", shard)
    text = " ".join(f"w{k}" for k in range(40))
    d = spark.createDataFrame([(1, "x y " + text + " z"), (2, text + " q " + text)], "doc_id long, text string")
    i = spark.createDataFrame([(7, text), (8, "y w0")], "item_id long, item_text string")
    assert sorted(tuple(x) for x in lk.leaked_spans(d, i).collect()) == [(1, 7, 2, 41), (1, 8, 1, 2), (2, 7, 0, 39), (2, 7, 41, 80)]


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    i = spark.createDataFrame([(7, "a b")], "item_id long, item_text string")
    assert lk.leaked(d.limit(0), i).collect() == [] and lk.leaked(d, i.limit(0)).collect() == []
    assert lk.leaked(d, i).count() == 1


def test_places_cut_the_span_out(spark):
    text = " ".join(f"wörd{k}" for k in range(15))
    raw = "Yes [quote=a]" + text.replace("wörd3", "W<b>ö</b>RD3").replace("wörd4", "wö​rd4").replace("wörd5", "w&ouml;rd5").replace(" wörd7", "&nbsp;\n[i]wörd7[/i]") + "[/quote] no"
    raw = raw.replace("W<b>ö</b>RD3", "WÖRD3")
    d = spark.createDataFrame([(1, raw), (1, raw), (1, "x"), (2, "a " + text)], "doc_id long, text string")
    i = spark.createDataFrame([(7, text)], "item_id long, item_text string")
    got = {r["doc_id"]: r for r in lk.leaked_places(d, i).collect()}
    assert got[1]["first_word"] == 1 and raw[: got[1]["begin_char"]] == "Yes [quote=a]" and raw[got[1]["end_char"] :] == "[/quote] no"
    assert (got[2]["begin_char"], got[2]["end_char"]) == (2, 2 + len(text)) and len(got) == 2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAе́​ <>[]/b&;=*ﬁ")), max_size=30))
def test_as_many_places_as_words(text):
    places, words = lk.word_places(text), lk.words_of([text])[0]
    assert len(places) in (0, len(words))
    for (begin, end), word in zip(places, words):
        assert begin < end and (not text[begin:end].isascii() or not text[begin:end].isalnum() or text[begin:end].lower() == word)
    if text.isascii() and "&" not in text:
        assert len(places) == len(words)


def test_tags():
    words = lambda t: lk.words_of([t])[0]
    assert words("a [center]b[/center] [email=x@y]c[/email] [table]d [li]e [*]f") == list("abcdef")
    assert words("[deleted] [own]x[/own] [sic] [b]") == ["deleted", "x", "sic"]


def test_a_large_item_block_is_small_on_the_driver():
    import pickle

    items = [(i, [f"w{(i * 7919 + k) % 5000}" for k in range(300)]) for i in range(1000)]
    block = lk._Phrases(items)
    assert len(pickle.dumps(block)) < 2_000_000
    (matrix, begin, held) = block.by_length()[0]
    assert matrix.shape[1] == 13 and begin[-1] == len(held) and len(np.unique(matrix, axis=0)) == len(matrix)
