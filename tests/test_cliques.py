import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceframe.functions import alternates as alt
from spliceframe.operators import cliques as cl
from spliceframe.operators import intervals as iv
from spliceframe.operators import mates as mt
from spliceframe.plans import junction_queries as jq


@pytest.mark.parametrize("seed", range(10))
def test_largest_clique(seed):
    r = random.Random(seed)
    segments = [np.array([(s, s + r.randrange(0, 12)) for s in (r.randrange(60) for _ in range(r.choice([1, 1, 3])))]) for _ in range(11)]
    graph = cl.conflicts(segments)
    over = lambda u, v: any(a[1] > b[0] and a[0] < b[1] and a[1] > a[0] and b[1] > b[0] for a in segments[u] for b in segments[v])
    for u, v in itertools.combinations(range(11), 2):
        assert (graph[u] >> v & 1) == (graph[v] >> u & 1) == over(u, v)
    best = max(k for k in range(1, 12) for c in itertools.combinations(range(11), k) if all(graph[u] >> v & 1 for u, v in itertools.combinations(c, 2)))
    assert cl.largest_clique(graph) == (best, True)


def test_budget():
    assert cl.largest_clique([], 10) == (0, True)
    size, exact = cl.largest_clique(cl.conflicts([np.array([[i, i + 40]]) for i in range(60)]), 5)
    assert size <= 40 and not exact
    assert cl.largest_clique(cl.conflicts([np.array([[0, 9]])] * 700)) == (700, True)


def test_path_nodes_conflict_with_their_junctions(spark):
    j = "array<struct<jx_start:int,jx_end:int>>"
    chains = spark.createDataFrame([("f", "A", 2, [(1, 5), (9, 12)]), ("f", "A", 2, [(1, 5), (9, 12)]), ("f", "A", 1, [(4, 7)]), ("g", "B", 1, [(1, 5)])], f"bam_file string, chrom string, n_junctions int, j {j}")
    got = {r["bam_file"]: tuple(r)[1:] for r in cl.path_cliques(cl.path_nodes(chains, "bam_file", 2), "bam_file").collect()}
    assert got == {"f": (4, 4, 3, True), "g": (1, 0, 1, True)}


def test_mates(spark):
    rows = [("p", 1 + 2 + 64, "A", 1, 15, "10M"), ("p", 1 + 2 + 128 + 16, "A", 6, -15, "10M"), ("q", 1 + 64, "A", 1, 15, "10M"), ("q", 1 + 128 + 16, "A", 6, -15, "10M"), ("x", 1 + 2 + 64, "A", 1, 0, "5M"), ("s", 1 + 64, "A", 1, 30, "5M10N5M"), ("s", 1 + 128 + 16, "A", 11, -30, "5M10N5M")]
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, tlen int, cigar string")
    assert sorted(tuple(r) for r in mt.fragment_lengths(df).collect()) == [(10, 1), (15, 2)]
    assert [tuple(r) for r in mt.fragment_summary(mt.fragment_lengths(df)).collect()] == [(3, 40 / 3, 15, 2)]
    own = mt.coverage_events(df.where("qname = 'p'"))
    assert [tuple(r) for r in iv.depth_runs(own, ["chrom"], "start", "end", 7, F.col("weight")).orderBy("start").collect()] == [("A", 0, 15, 1)]
    assert mt.fragment_lengths(df.limit(0)).collect() == []


def test_alternates(spark):
    df = spark.createDataFrame([(11, "2S3M1I3M2D2M5N2M", "1A4^CC1T1N0", "GGACGTACGTTAN")], "pos int, cigar string, md string, seq string")
    p, c, m, s = (F.col(x) for x in ("pos", "cigar", "md", "seq"))
    r = df.select(alt.cigar_alternates(p, c, s, True).alias("a"), alt.md_mismatches(p, c, m, s).alias("x"), alt.md_mismatches(p, c, m, s, True).alias("n")).first()
    assert [tuple(x) for x in r["a"]] == [(10, "S", "GG"), (13, "I", "T"), (16, "D", "2")]
    assert [tuple(x) for x in r["x"]] == [(11, "X", "C"), (19, "X", "T")]
    assert [tuple(x) for x in r["n"]][-1] == (26, "X", "N")


def test_sequences(spark):
    df = spark.createDataFrame([("AAAAC",), ("TTTTA",), ("AA",), ("ACGT",), ("",)], "s string").coalesce(1)
    got = [tuple(r) for r in df.select(alt.poly_a(F.col("s")), alt.reverse_complement(F.col("s"))).collect()]
    assert got == [("A", "GTTTT"), ("T", "TAAAA"), (None, "TT"), (None, "ACGT"), (None, "")]


@pytest.mark.parametrize("steps", [1, 20])
def test_open_branches_are_finished(spark, steps):
    r = random.Random(steps)
    rows = [(g, c, [(s, s + r.randrange(1, 12)) for s in (r.randrange(60) for _ in range(r.choice([1, 1, 3])))]) for g in ("f", None, "g") for c in "AB" for _ in range(25)]
    nodes = spark.createDataFrame(rows, "bam_file string, chrom string, segments array<struct<jx_start:int,jx_end:int>>")
    want = {g: max(cl.largest_clique(cl.conflicts([np.array(x[2]) for x in rows if x[:2] == (g, c)]))[0] for c in "AB") for g in ("f", None, "g")}
    got = cl.path_cliques(nodes, "bam_file", steps).collect()
    assert {x["bam_file"]: x["clique_number"] for x in got} == want and len(got) == 3 and all(x["exact"] for x in got)


def test_paths_of_one_read_are_nodes(spark, monkeypatch):
    reads = spark.createDataFrame([("f", "r", "A", 1, 5), ("f", "r", "A", 9, 12), ("f", "q", "A", 4, 7)], "bam_file string, read string, chrom string, jx_start int, jx_end int")
    monkeypatch.setattr(jq.bridge, "reads", lambda spark, folder: reads)
    assert [tuple(x) for x in jq.path_cliques(spark, "").collect()] == [("f", 4, 4, 3, True)]


def test_depth_is_a_clique():
    assert cl.deepest([]) == 0
    assert cl.deepest([np.array([[1, 5], [4, 9]]), np.array([[9, 12], [3, 5]]), np.array([[5, 5]]), np.array([[12, 20]])]) == 2


def _overlap(x, y):
    return any(a < d and c < b and a < b and c < d for a, b in x for c, d in y)


def test_paths_of_a_gene_leave_no_branch(spark, monkeypatch):
    r, rows = random.Random(7), set()
    while len(rows) < 400:
        at = sorted(r.sample(range(8), r.choice([2, 2, 4, 6, 8])))
        rows.add(tuple((100 * a + r.randrange(3), 100 * b + 50 - r.randrange(3)) for a, b in zip(at[::2], at[1::2])))
    edges = sum(_overlap(x, y) for x, y in itertools.combinations(rows, 2))
    nodes = spark.createDataFrame([(f, c, list(x)) for f, c in (("f", "A"), ("f", "B"), ("g", None)) for x in rows], "bam_file string, chrom string, segments array<struct<jx_start:int,jx_end:int>>")
    monkeypatch.delattr(cl, "_finished")
    assert sorted(tuple(x) for x in cl.path_cliques(nodes, "bam_file", 100_000).collect()) == [("f", 800, 2 * edges, 342, True), ("g", 400, edges, 342, True)]


@pytest.mark.parametrize("seed", range(10))
def test_bounds(seed):
    r = random.Random(seed)
    segments = [np.array([(s, s + r.randrange(0, 12)) for s in (r.randrange(60) for _ in range(r.choice([1, 1, 3])))]) for _ in range(40)]
    edges = sum(_overlap(x, y) for x, y in itertools.combinations(segments, 2))
    assert sum(sum(map(int.bit_count, cl.conflicts(part))) for part in cl.components(segments)) == 2 * edges
    best, exact = cl.largest_clique(cl.conflicts(segments))
    assert exact
    for known in range(best + 2):
        kept, n = cl._core(segments, known)
        bound, own = cl._ordered(kept, known)
        assert n == edges and (own or best <= known)
        if best > known:
            assert cl.largest_clique(cl.conflicts(own)) == (best, True) and bound >= best
        assert known <= cl.extended(own, cl.Conflicts(own), known, bound) <= max(best, known)


@pytest.mark.parametrize("steps", [1, 50])
def test_rounds_end(spark, steps):
    r = random.Random(steps)
    parts = {(g, p): [np.array([(s, s + r.randrange(1, 12)) for s in (r.randrange(60) for _ in range(r.choice([1, 3])))]) for _ in range(25)] for g in ("f", None) for p in ("0", "0:B")}
    graphs = spark.createDataFrame([(g, p, [x.astype(np.int64).tobytes() for x in own]) for (g, p), own in parts.items()], "g string, part string, graph array<binary>")
    branches = spark.createDataFrame([(g, p, 1, (cl._bytes((1 << 25) - 1), 0)) for g, p in parts], "g string, part string, clique_number long, b struct<candidates:binary,size:int>")
    found = cl._finished(graphs, branches, branches.select("g", "clique_number"), 3, steps)
    want = {g: max(cl.largest_clique(cl.conflicts(parts[g, p]))[0] for p in ("0", "0:B")) for g in ("f", None)}
    assert {x["g"]: x["n"] for x in found.groupBy("g").agg(F.max("clique_number").alias("n")).collect()} == want
