import random

import pytest
from pyspark.sql import functions as F

from spliceframe.operators import intervals as iv


def _spans(seed, n=120, chroms="AB"):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randrange(1, 300)
        out.append((i, r.choice(chroms), s, s + r.choice([0, 1, 5, 40, 200])))
    return out


@pytest.mark.parametrize("width", [7, 1000])
def test_overlapping_pairs(spark, width):
    rows = _spans(1)
    df = spark.createDataFrame(rows, "id int, chrom string, s int, e int")
    got = [(x["u"], x["v"]) for x in iv.overlapping_pairs(df, ["chrom"], "id", "s", "e", width).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[3] > b[2] and a[2] < b[3] and a[3] > a[2] and b[3] > b[2]}
    assert len(got) == len(set(got)) and set(got) == want


def test_touching_ends(spark):
    df = spark.createDataFrame([(1, "A", 1, 10), (2, "A", 10, 20), (3, "A", 11, 20), (4, "B", 1, 10)], "id int, chrom string, s int, e int")
    assert [(x["u"], x["v"]) for x in iv.overlapping_pairs(df, ["chrom"], "id", "s", "e").collect()] == [(2, 3)]
    assert {(x["chrom"], x["depth"]) for x in iv.max_depth(df, ["chrom"], "s", "e").collect()} == {("A", 2), ("B", 1)}


@pytest.mark.parametrize("tile", [5, 64, 10_000])
def test_depth_equals_counting(spark, tile):
    rows = _spans(2)
    runs = iv.depth_runs(spark.createDataFrame(rows, "id int, chrom string, s int, e int"), ["chrom"], "s", "e", tile).collect()
    depth = {}
    for x in runs:
        for p in range(x["start"], x["end"]):
            assert (x["chrom"], p) not in depth
            depth[x["chrom"], p] = x["depth"]
    for c in "AB":
        for p in range(0, 600):
            assert depth.get((c, p), 0) == sum(r[1] == c and r[2] <= p < r[3] for r in rows)
    by = {}
    for x in sorted(runs, key=lambda x: (x["chrom"], x["start"])):
        assert by.get(x["chrom"], (x["start"], None))[0] == x["start"] and by.get(x["chrom"], (0, None))[1] != x["depth"]
        by[x["chrom"]] = (x["end"], x["depth"])


@pytest.mark.parametrize("width", [10, 1_000_000])
def test_containment(spark, width):
    items, genes = _spans(3), _spans(4, 30)
    i = spark.createDataFrame(items, "id int, chrom string, jx_start int, jx_end int")
    g = spark.createDataFrame([(f"g{a}", *b) for a, *b in genes], "gene_id string, chrom string, g_start int, g_end int")
    got = [(x["id"], x["gene_id"]) for x in iv.containment_join(i, g, width).collect()]
    assert sorted(got) == sorted((a[0], f"g{b[0]}") for a in items for b in genes if a[1] == b[1] and b[2] <= a[2] and a[3] <= b[3])


def test_covered_by(spark):
    a, b = _spans(5), _spans(6, 40)
    left = spark.createDataFrame(a, "id int, chrom string, s int, e int")
    right = spark.createDataFrame(b, "id int, chrom string, s int, e int")
    got = {x["id"] for x in iv.covered_by(left, right, "chrom", "s", "e", 90, 16).collect()}
    shared = lambda x, y: min(x[3], y[3]) - max(x[2], y[2])
    assert got == {x[0] for x in a if any(x[1] == y[1] and shared(x, y) > 0 and shared(x, y) * 10 >= 9 * (x[3] - x[2]) for y in b)}


def test_regions_tiles_and_merging(spark):
    runs = spark.createDataFrame([("A", 0, 3, 1), ("A", 3, 5, 2), ("A", 5, 8, 1)], "chrom string, start int, end int, depth long")
    regions = spark.createDataFrame([("x", "A", 2, 6), ("y", "A", 8, 9), ("z", "B", 0, 9)], "gene_id string, chrom string, g_start int, g_end int")
    for width in (2, 100):
        assert sorted(tuple(r) for r in iv.region_stats(runs, regions, width).collect()) == [("x", 6, 4, 1, 2), ("y", 0, 0, 0, 0), ("z", 0, 0, 0, 0)]
    assert sorted(tuple(r) for r in iv.tiled(runs, ["chrom"], 4).collect()) == [("A", 0, 5), ("A", 1, 5)]
    df = spark.createDataFrame([("A", 1, 10), ("A", 3, 4), ("A", 14, 20), ("A", 26, 30), ("B", 14, 15)], "chrom string, s int, e int")
    assert sorted(tuple(r) for r in iv.merged_nearby(df, ["chrom"], "s", "e", 5).collect()) == [("A", 1, 20, 3), ("A", 26, 30, 1), ("B", 14, 15, 1)]


def test_empty(spark):
    df = spark.createDataFrame([], "id int, chrom string, s int, e int")
    assert iv.depth_runs(df, ["chrom"], "s", "e").collect() == [] and iv.overlapping_pairs(df, ["chrom"], "id", "s", "e").collect() == []
    assert df.where(F.col("id") > 0).count() == 0


def _spread(spark, n=60):
    r = random.Random(n)
    return [(c, a, a + r.randrange(1, 40)) for c in ("x", None) for a in (r.randrange(0, 2000) for _ in range(n))]


@pytest.mark.parametrize("tile", [7, 100, 10_000])
def test_merged_nearby_by_tiles(spark, tile):
    rows = _spread(spark)
    got = sorted((str(r["c"]), r["start"], r["end"], r["n"]) for r in iv.merged_nearby(spark.createDataFrame(rows, "c string, s int, e int"), ["c"], "s", "e", 5, tile).collect())
    want = []
    for c in ("x", None):
        for _, a, b in sorted(x for x in rows if x[0] == c):
            if want and want[-1][0] == str(c) and a - want[-1][2] < 5:
                want[-1] = (str(c), want[-1][1], max(want[-1][2], b), want[-1][3] + 1)
            else:
                want.append((str(c), a, b, 1))
    assert got == sorted(want)


def test_signal_over_regions(spark):
    signal = spark.createDataFrame([("c", 0, 10, 0.5), ("c", 10, 30, 2.25), ("c", 30, 30, 9.0), ("c", 12, 14, None), ("d", 0, 100, -1.5)], "chrom string, start int, end int, value double")
    regions = spark.createDataFrame([("g", "c", 5, 25), ("h", "d", 10, 20), ("none", "e", 0, 9), ("empty", "c", 9, 9)], "gene_id string, chrom string, g_start int, g_end int")
    got = {r["gene_id"]: tuple(r)[1:] for r in iv.signal_stats(signal, regions, 8).collect()}
    assert got == {"g": (36.25, 36.25 / 20, 0.5, 2.25), "h": (-15.0, -1.5, -1.5, -1.5), "none": (0.0, 0.0, 0.0, 0.0)}
    for op, value in (("sum", 36.25), ("mean", 36.25 / 20), ("min", 0.5), ("max", 2.25), ("other", 36.25)):
        assert {r["gene_id"]: r["value"] for r in iv.region_value(signal, regions, op).collect()}["g"] == value
    blocks = spark.createDataFrame([("c", 0, 10), ("c", 8, 30), ("d", 5, 5)], "chrom string, start int, end int")
    inside = spark.createDataFrame([("c", 5, 9), ("c", 20, 40), ("d", 0, 9)], "chrom string, start int, end int")
    assert [tuple(r) for r in iv.shared_bases(blocks, inside, 8).collect()] == [("c", 4 + 1 + 10)]
