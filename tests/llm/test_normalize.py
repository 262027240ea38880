from hypothesis import given, settings
from hypothesis import strategies as st

from spliceframe.llm import normalize as nm

form = lambda *t: nm.consistent_forms(list(t))

SAME = [
    ("Ａbc１２", "Abc12"),
    ("ﬁne ﬂat", "fine flat"),
    ("café", "café"),
    ("cаfе́", "café"),
    ("ѐ", "è"),
    ("a​b‍c⁠d﻿", "abcd"),
    ("e​́", "é"),
    ("so­ft", "soft"),
    (" a  \n\tb　", "a b"),
    ("ΑΒЗΖ", "ABЗZ"),
    ("️a͏", "a"),
    (" ", ""),
]
DIFFER = [("a", "A"), ("cafe", "café"), ("a.", "a"), ("a", "b"), ("&amp;", "&"), ("<b>a</b>", "a"), ("и", "й"), ("a b", "ab")]


def test_same_and_different():
    for a, b in SAME:
        assert form(a)[0] == form(b)[0], (a, b)
    for a, b in DIFFER:
        assert form(a)[0] != form(b)[0], (a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("е́​ Ａ\0ﬁо")), max_size=12), max_size=6))
def test_stable_and_joined_equals_single(texts):
    once = form(*texts)
    assert form(*once) == once
    assert once == [form(t)[0] for t in texts]
    assert [nm.folded(nm.folded(f)) for f in once] == [nm.folded(f) for f in once]


def test_columns(spark):
    df = spark.createDataFrame([(1, " Straße ", "x"), (2, None, "x"), (3, "", "x"), (4, "Ａ" * 3_000_000, "x")], "doc_id long, text string, form string")
    got = {r["doc_id"]: r for r in nm.normalized(df).collect()}
    assert (got[1]["form"], got[1]["folded"]) == ("Straße", "strasse")
    assert got[2]["form"] is None and got[2]["folded"] is None and got[3]["form"] == ""
    assert got[4]["form"] == "A" * 3_000_000
    assert nm.normalized(df.limit(0)).columns == ["doc_id", "text", "form", "folded"]


def test_pairs(spark):
    rows = [(1, "café"), (2, "café"), (3, "café"), (4, "Café"), (5, ""), (6, " ​"), (7, None), (8, "x"), (8, "x"), (9, "ｘ"), (None, "ｘ"), (10, "ca­fé")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in nm.same_looking_pairs(df).collect())
    assert got == [(1, 2), (1, 3), (1, 10), (2, 10), (3, 10), (5, 6), (8, 9)]
    assert nm.same_looking_pairs(df.limit(0)).collect() == []


def test_a_frequent_form_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nm, "LIST", 2)
    monkeypatch.setattr(nm, "BLOCK", 3)
    variants = ["abc", "ａbc", "аbc", "a\u200bbc", "abc ", "αbc"]
    rows = [(i, variants[i % 6]) for i in range(60)] + [(100 + i, "other") for i in range(5)]
    got = sorted(tuple(r) for r in nm.same_looking_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == [(i, j) for i in range(60) for j in range(i + 1, 60) if i % 6 != j % 6]


def test_letters_of_one_script_stay_apart():
    for letters, alike in ((nm.CYRILLIC, nm.CYRILLIC_AS), (nm.GREEK, nm.GREEK_AS)):
        assert len(letters) == len(alike) == len(set(letters)) and len(set(alike)) >= len(alike) - 1
    assert form("αινου")[0] == "aivou" and form("νο")[0] != form("νσ")[0]
