import itertools
import random

import numpy as np
import pytest

from spliceframe.llm import packing as pk


def _fewest(sizes, capacity):
    """By brute force over the orders of first-fit."""
    best = len(sizes)
    for order in set(itertools.permutations(sizes)):
        bins = []
        for s in order:
            for i, f in enumerate(bins):
                if f + s <= capacity:
                    bins[i] += s
                    break
            else:
                bins.append(s)
        best = min(best, len(bins))
    return best


@pytest.mark.parametrize("seed", range(25))
def test_bound_and_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 10, 12, 20])
    sizes = [r.randrange(0, capacity + 1) for _ in range(r.randrange(1, 8))]
    exact = _fewest(sizes, capacity)
    bound = pk.containers_bound(np.array(sizes), np.ones(len(sizes), int), capacity)
    bins = pk.best_fit_decreasing(np.array(sizes), capacity)
    assert bound <= exact <= bins.max() + 1
    assert np.bincount(bins, weights=sizes).max() <= capacity


def test_known_bounds():
    assert pk.containers_bound(np.array([6]), np.array([5]), 10) == 5
    assert pk.containers_bound(np.array([4]), np.array([6]), 10) == 3
    assert pk.containers_bound(np.array([]).astype(int), np.array([]).astype(int), 10) == 0
    assert pk.containers_bound(np.array([0]), np.array([5]), 10) == 1


def _check(packing, docs, capacity):
    rows = packing.rows.collect()
    fill, held = {}, {}
    for x in rows:
        fill[x["container_id"]] = fill.get(x["container_id"], 0) + x["size"]
        held.setdefault(x["doc_id"], []).append((x["part_no"], x["parts"], x["size"]))
    assert len(fill) == packing.containers and max(fill.values(), default=0) <= capacity
    assert {d: sum(p[2] for p in v) for d, v in held.items()} == docs
    for d, v in held.items():
        assert len(v) == max(1, -(-docs[d] // capacity)) == v[0][1] and sorted(p[0] for p in v) == list(range(len(v)))
    return rows


@pytest.mark.parametrize("items", [40, 300, 25_000])
def test_packs_every_document_once(spark, monkeypatch, items):
    monkeypatch.setattr(pk, "PART_ITEMS", items)
    r = random.Random(items)
    docs = {i: r.choice([0, r.randrange(1, 60), r.randrange(30, 70), r.randrange(1, 450)]) for i in range(1500)}
    packing = pk.pack(spark.createDataFrame(list(docs.items()), "doc_id long, size long").repartition(4), 100)
    _check(packing, docs, 100)
    assert packing.bound <= packing.containers <= packing.bound * (1.03 if items < 100 else 1.01) + 1


def test_rounds_lower_the_total(spark, monkeypatch):
    monkeypatch.setattr(pk, "PART_ITEMS", 20)
    df = spark.createDataFrame([(i, 30) for i in range(400)], "doc_id long, size long")
    packing = pk.pack(df, 100)
    assert packing.rounds >= 1 and packing.containers - packing.bound <= 2


def test_empty_and_sizes(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (None, "x"), (4, "x" * 500_000), (3, "a b c"), (5, "<|endoftext|>")], "doc_id long, text string")
    got = sorted(tuple(x) for x in pk.token_sizes(df).collect())
    assert got[:4] == [(1, 0), (2, 0), (3, 3), (3, 3)] and got[4][0] == 4 and got[4][1] > 2048 and got[5][1] > 1
    packing = pk.pack(pk.token_sizes(df).limit(0))
    assert packing.containers == packing.bound == 0 and packing.rows.collect() == []


def test_certificates_and_exit(spark, monkeypatch):
    monkeypatch.setattr(pk, "PART_ITEMS", 10)
    packing = pk.pack(spark.createDataFrame([(i, 34) for i in range(40)] + [(100 + i, 33) for i in range(2)], "doc_id long, size long"), 100)
    rows = packing.certificates.collect()
    assert {r["round"] for r in rows} == set(range(packing.rounds + 1)) and all(r["containers"] >= r["bound"] for r in rows)
    assert sum(r["pieces"] for r in rows if r["round"] == 0) == 42
    assert packing.gap == packing.containers - packing.bound >= 0
