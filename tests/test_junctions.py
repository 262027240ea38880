import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceframe.functions import cigar as cg
from spliceframe.functions import labels as lb
from spliceframe.functions.special import digamma, gammaln
from spliceframe.operators import annotation as an
from spliceframe.operators import export as ex
from spliceframe.operators import graph as gr
from spliceframe.operators import inference as inf
from spliceframe.operators import mates as mt
from spliceframe.operators import reads as rd
from spliceframe.operators import results as rs
from spliceframe.plans import junction_queries as jq


def _list(df, column):
    return [[tuple(x) for x in r[0]] for r in df.select(column).collect()]


def test_anchored_introns(spark):
    cigars = ["5M100N10M", "6M100N6M", "6M49N6M", "6M50N6M", "6M500001N6M", "3M3M60N6M", "6M2D60N6M", "6M1I60N6M", "*"]
    df = spark.createDataFrame([(1000, c) for c in cigars], "pos int, cigar string").coalesce(1)
    got = _list(df, cg.anchored_introns(F.col("pos"), F.col("cigar")))
    assert got == [[], [(1006, 1105)], [], [(1006, 1055)], [], [(1006, 1065)], [], [], []]


def test_cigar_coordinates(spark):
    df = spark.createDataFrame([(1000, "10M100N20M2I5D3M60N7M"), (1, "3S4M")], "pos int, cigar string").coalesce(1)
    p, c = F.col("pos"), F.col("cigar")
    assert _list(df, cg.introns(p, c)) == [[(1010, 1109), (1138, 1197)], []]
    assert _list(df, cg.anchored_introns(p, c)) == [[(1010, 1109)], []]
    assert _list(df, cg.blocks(p, c)) == [[(1000, 1009), (1110, 1129), (1135, 1137), (1198, 1204)], [(1, 4)]]
    assert [tuple(r) for r in df.select(cg.reference_end(p, c), cg.aligned_bases(c), cg.soft_clipped(c)).collect()] == [(1204, 40, 0), (4, 4, 3)]


def test_flags_and_names(spark):
    df = spark.createDataFrame([(f, "MT") for f in (0, 4, 16, 256, 2048, 2304)], "flag int, rname string")
    assert sorted(r["flag"] for r in rd.primary(df).collect()) == [0, 16]
    assert sorted(r["flag"] for r in rd.masked(df).collect()) == [0, 16, 2048]
    names = spark.createDataFrame([("MT",), ("1",), ("X",), ("22",), ("GL1",)], "c string").coalesce(1)
    assert [r[0] for r in names.select(rd.with_chr(F.col("c"))).collect()] == ["chrM", "chr1", "chrX", "chr22", "GL1"]
    assert [r[0] for r in names.select(rd.with_chr(F.col("c"), "mouse")).collect()][3] == "22"


def test_reads_count_once(spark):
    df = spark.createDataFrame([("A", "r", 1, 2, 0), ("A", "r", 1, 2, 1), ("A", "q", 1, 2, 0), ("B", "r", 1, 2, None)], "chrom string, read string, jx_start int, jx_end int, is_unique int")
    assert sorted(tuple(r) for r in rd.junction_reads(df, ["chrom"]).collect()) == [("A", 1, 2, 1, 1), ("B", 1, 2, 0, 1)]


def test_paths(spark):
    rows = [("A", "r1", 5, 6), ("A", "r1", 1, 2), ("A", "r2", 1, 2), ("A", "r2", 5, 6), ("A", "r2", 5, 6), ("A", "r3", 1, 2)]
    df = spark.createDataFrame(rows, "chrom string, read string, jx_start int, jx_end int")
    chains = rd.read_chains(df, ["chrom"])
    assert [tuple(r) for r in rd.paths(chains, ["chrom"]).collect()] == [("A", "1-2,5-6", 2, 2)]
    assert sorted(tuple(r) for r in gr.cooccurrence_prior(chains, ["chrom"]).collect()) == [("A", "1-2", "5-6", 1.0), ("A", "5-6", "1-2", 1.0)]


def test_nodes_keep_strands_apart(spark):
    j = spark.createDataFrame([("s", "A", 2, 9, "+", 20), ("t", "A", 2, 9, "+", 20), ("s", "A", 2, 9, "-", 40), ("s", "B", 2, 9, "+", 99), ("s", "A", 3, 9, "+", 1)], "sample_id string, chrom string, jx_start int, jx_end int, strand string, score int")
    g = spark.createDataFrame([("g", "A", 1, 10, "+")], "gene_id string, chrom string, g_start int, g_end int, strand string")
    nodes = gr.gene_nodes(j, g)
    assert [(r["node_id"], r["strand"], r["score"]) for r in nodes.orderBy("node_id").collect()] == [(0, "+", 40), (1, "-", 40)]
    assert sorted(tuple(r) for r in gr.document_matrix(j, nodes).collect()) == [("g", "s", 0, 20), ("g", "s", 1, 40), ("g", "t", 0, 20)]
    assert [tuple(r) for r in gr.clique_numbers(nodes).collect()] == [("g", 2, 2)]


def test_independent_sets_are_largest(spark):
    spans = [(1, 10), (5, 15), (10, 20), (12, 30), (20, 25)]
    nodes = spark.createDataFrame([("g", i, "A", s, e) for i, (s, e) in enumerate(spans)], "gene_id string, node_id int, chrom string, jx_start int, jx_end int")
    assert sorted(r["node_id"] for r in gr.independent_sets(nodes).collect()) == [0, 2, 4]


def test_attributes(spark):
    df = spark.createDataFrame([('gene_id "G 1"; transcript_id T1; gene_id "G2";',), ("ID=g1;Name=a b;ID=g2",), ("",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(an.attributes(F.col("t"))).collect()] == [{"gene_id": "G2", "transcript_id": "T1"}, {"ID": "g2", "Name": "a b"}, {}, None]


def test_features(spark):
    lines = ["#x", "1\ta\tgene\t9\t5\t.\t+\t.\tID=g", "1\ta\tgene\t9\t5\t.\t+\t.", "1\ta\tgene\tx\t5\t.\t+\t.\tID=g"]
    got = an.features(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["start"], r["end"], r["attributes"]) for r in got] == [(5, 9, {"ID": "g"})]


def test_exons(spark):
    rows = [("ok", "A", 101, 200), ("ok", "A", 301, 400), ("bad", "A", 1, 50), ("touch", "A", 101, 200), ("touch", "A", 201, 300), ("two", "A", 101, 200), ("two", "B", 301, 400)]
    got = ex.transcript_exons(spark.createDataFrame(rows, "transcript_id string, chrom string, jx_start int, jx_end int"))
    assert sorted(tuple(r) for r in got.collect()) == [("ok", 1, "A", 100, 100), ("ok", 2, "A", 201, 300), ("ok", 3, "A", 401, 401)]
    assert "exon_number \"2\"" in [r["value"] for r in ex.gtf_lines(got).orderBy("exon_no").collect()][1]


def test_special_functions():
    x = np.array([1e-3, 0.5, 1, 2, 7.5, 100, 1e6])
    assert np.allclose(gammaln(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
    h = 1e-5
    assert np.allclose(digamma(x[1:-1]), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x[1:-1]], rtol=1e-6)
    assert abs(digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-12


@pytest.mark.parametrize("seed", range(8))
def test_heaviest_sets(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 30, 9)
    e = s + rng.integers(1, 15, 9)
    w = rng.normal(size=(3, 9))
    masks = inf.heaviest_sets(w, s, e)
    for row, mask in zip(w, masks):
        best = 0.0
        for bits in range(2**9):
            at = [i for i in range(9) if bits >> i & 1]
            if all(e[i] <= s[j] or e[j] <= s[i] for i in at for j in at if i < j):
                best = max(best, row[at].sum())
        at = np.flatnonzero(mask)
        assert all(e[i] <= s[j] or e[j] <= s[i] for i in at for j in at if i < j) and abs(row[at].sum() - best) < 1e-9


SPANS = {0: (1, 10), 1: (20, 30), 2: (5, 15), 3: (25, 40)}


def _two_transcripts(spark, samples=12):
    nodes = spark.createDataFrame([("g", i, s, e) for i, (s, e) in SPANS.items()], "gene_id string, node_id int, jx_start int, jx_end int")
    matrix = spark.createDataFrame([("g", f"s{d}", n, 60 if (n < 2) == (d % 2 == 0) else 2) for d in range(samples) for n in SPANS], "gene_id string, sample_id string, node_id int, count long")
    return matrix, nodes, spark.createDataFrame([("g", 4, 2), ("h", 3, 1)], "gene_id string, nodes long, clique_number long")


@pytest.mark.parametrize("entries", [20_000, 8])
def test_two_transcripts_come_apart(spark, monkeypatch, entries):
    monkeypatch.setattr(inf, "ENTRIES", entries)
    rows = inf.inferred(*_two_transcripts(spark)).collect()
    again = inf.inferred(*_two_transcripts(spark)).collect()
    assert [(r["k"], r["node_id"], r["member"], round(r["share"], 6)) for r in sorted(rows)] == [(r["k"], r["node_id"], r["member"], round(r["share"], 6)) for r in sorted(again)]
    assert all(r["converged"] and r["iterations"] > 2 for r in rows)
    assert abs(sum(r["expected_count"] for r in rows) - 12 * 2 * 62) < 1e-6
    for k in (0, 1):
        members = [SPANS[r["node_id"]] for r in rows if r["k"] == k and r["member"]]
        assert all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(members) for b in members[i + 1 :])
    top = {k: {r["node_id"] for r in rows if r["k"] == k and r["share"] > 0.2} for k in (0, 1)}
    assert sorted(map(sorted, top.values())) == [[0, 1], [2, 3]]


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    shares = []
    for entries in (20_000, 8):
        monkeypatch.setattr(inf, "ENTRIES", entries)
        shares.append({(r["k"], r["node_id"]): r["share"] for r in inf.inferred(*_two_transcripts(spark, 20), tolerance=1e-9).collect()})
    assert shares[0].keys() == shares[1].keys() and all(abs(shares[0][x] - shares[1][x]) < 1e-3 for x in shares[0])


def test_counts_by_sample_sum_to_those_of_the_nodes(spark):
    given = _two_transcripts(spark)
    whole = {(r["k"], r["node_id"]): r["expected_count"] for r in inf.inferred(*given, tolerance=1e-9).collect()}
    by = inf.inferred(*given, by_sample=True, tolerance=1e-9).groupBy("k", "node_id").agg(F.sum("expected_count").alias("c"), F.count_distinct("sample_id").alias("n")).collect()
    assert all(abs(whole[r["k"], r["node_id"]] - r["c"]) < 0.1 for r in by) and max(r["n"] for r in by) == 12


def test_fits_say_whether_they_settled(spark):
    rows = inf.inferred(*_two_transcripts(spark), iterations=2).collect()
    assert {(r["iterations"], r["converged"]) for r in rows} == {(2, False)}
    matrix, nodes, cliques = _two_transcripts(spark)
    assert inf.inferred(matrix.limit(0), nodes, cliques).collect() == []


def test_queries_fit_to_the_tolerance(spark):
    rows = jq.infer_cavi(spark, "/root/testdata/sf0.001").select("gene_id", "iterations", "converged").distinct().collect()
    assert rows and all(r["converged"] or r["iterations"] == inf.SWEEPS for r in rows) and any(r["converged"] and r["iterations"] > 20 for r in rows)


def test_covers_splits_and_variants(spark):
    lower = spark.createDataFrame([("g", 0, 0), ("g", 1, 0), ("g", 2, 1), ("g", 3, 1)], "gene_id string, node_id int, lo int")
    assert sorted(r["node_id"] for r in gr.node_cover(lower).collect()) == [1, 3]
    matrix = spark.createDataFrame([("g", f"s{i:02d}") for i in range(20)] * 2 + [("g", None), ("h", "x")], "gene_id string, sample_id string")
    split = gr.sample_split(matrix).collect()
    assert len(split) == 21 and sum(not r["training"] for r in split if r["gene_id"] == "g") == 1
    members = spark.createDataFrame([("g", "T1", "a"), ("g", "T1", "b"), ("g", "T2", "b"), ("g", "T2", "c"), ("g", "T3", "d"), ("h", "T1", "a"), ("h", "T2", "c")], "gene_id string, transcript string, node string")
    reference = gr.reference_edges(members, "gene_id")
    assert sorted(tuple(r) for r in reference.collect()) == [("g", "a", "c"), ("g", "a", "d"), ("g", "b", "d"), ("g", "c", "d"), ("h", "a", "c")]
    overlaps = spark.createDataFrame([("g", "a", "b"), ("g", "a", "x")], "gene_id string, u string, v string")
    count = {v: gr.active_edges(overlaps, reference, members, "gene_id", v).count() for v in ("current", "hybrid", "reference")}
    assert count == {"current": 2, "hybrid": 7, "reference": 6}
    cliques = spark.createDataFrame([("g", 3)], "gene_id string, clique_number long")
    assert [r["clusters"] for r in gr.cluster_numbers(cliques).orderBy("clusters").collect()] == list(range(3, 20, 2))


def test_clusters_merge_and_count(spark):
    rows = [("g", 0, 1, True, 2.0), ("g", 0, 2, False, 1.0), ("g", 1, 1, True, 4.0), ("g", 2, 1, False, 8.0)]
    df = spark.createDataFrame(rows, "gene_id string, k int, node_id int, member boolean, expected_count double")
    assert sorted((r["members"], r["clusters"], r["expected_count"]) for r in inf.merged_clusters(df).collect()) == [([], 1, 8.0), ([1], 2, 7.0)]
    got = inf.sample_counts(df.withColumn("sample_id", F.lit("s"))).orderBy("k").collect()
    assert [(r["member_count"], r["all_count"]) for r in got] == [(2.0, 3.0), (4.0, 4.0), (0.0, 8.0)]


def test_initial_sets():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 60, 25)
    e = s + rng.integers(1, 15, 25)
    masks = inf.initial_sets(s, e, 6, rng)
    for mask in masks:
        at = np.flatnonzero(mask)
        assert len(at) and all(e[i] <= s[j] or e[j] <= s[i] for i in at for j in at if i < j)
    assert masks[0].sum() == max(m.sum() for m in masks)


def test_labels(spark):
    df = spark.createDataFrame([("1:5-9",), ("5-9",), ("a:b:5-9",), ("x",), ("1:5-",), (None,)], "t string").coalesce(1)
    got = [r[0] and tuple(r[0]) for r in df.select(lb.parsed_label(F.col("t"))).collect()]
    assert got == [("1", 5, 9), (None, 5, 9), ("a:b", 5, 9), None, None, None]


def test_results(spark):
    nodes = spark.createDataFrame([("g", 0, "A", 5, 9), ("g", 1, "A", 20, 30)], "gene_id string, node_id int, chrom string, jx_start int, jx_end int")
    result = spark.createDataFrame([("g", 0, 0, True, 0.5), ("g", 1, 0, False, 0.1), ("g", 0, 1, True, 0.5)], "gene_id string, k int, node_id int, member boolean, share double")
    assert sorted(tuple(r) for r in rs.wide_shares(result, 2).collect()) == [("g", 0, 0.5, 0.1), ("g", 1, 0.5, None)]
    assert sorted(tuple(r) for r in rs.transcript_members(result, nodes).collect()) == [("g_C0", "A", 5, 9), ("g_C0", "A", 20, 30)]
    by = spark.createDataFrame([("g", "s", 1, 0, True, 3.0)], "gene_id string, sample_id string, k int, node_id int, member boolean, expected_count double")
    assert [tuple(r) for r in rs.result_rows(by, nodes).collect()] == [("g", "g.t1", 1, 0, 5, 9, "s", 3.0)]
    a = spark.createDataFrame([("g ",), ("h",), ("g",)], "x string")
    b = spark.createDataFrame([("h",), ("i",)], "y string")
    rows = spark.createDataFrame([("g",), ("h",), ("i",), ("j",)], "gene string")
    assert {r[0] for r in rs.restricted(rows, a, "gene", b).collect()} == {"g", "h", "i"}
    assert {r[0] for r in rs.restricted(rows, a, "gene", b, every=True).collect()} == {"h"}
    tiles = spark.createDataFrame([("A", 1, 6)], "chrom string, tile int, bases long")
    contigs = spark.createDataFrame([("A", 13), ("B", 3)], "name string, length int")
    assert sorted(tuple(r) for r in rs.with_zero_tiles(tiles, contigs, 10).collect()) == [("A", 0, 0, 0.0), ("A", 1, 6, 2.0), ("B", 0, 0, 0.0)]


def test_too_many_samples_for_columns(spark, monkeypatch):
    monkeypatch.setattr(jq, "PIVOT", 1)
    with pytest.raises(ValueError, match="more than 1 samples"):
        jq.sample_matrix(spark, "/root/testdata/sf0.001")


def test_scores_of_the_best_transcript(spark):
    configs = spark.createDataFrame([("c", "1", 100, 200), ("c", "1", 300, 400), ("c", "1", 300, 400), ("d", "1", 9000, 9100), ("e", None, 1, 2)], "config string, chrom string, jx_start int, jx_end int")
    reference = spark.createDataFrame([("T1", "1", 112, 188), ("T2", "1", 100, 213), ("T2", "1", 301, 399), ("T3", "2", 100, 200)], "transcript_id string, chrom string, jx_start int, jx_end int")
    assert {r["config"]: r["score"] for r in an.tolerance_scores(configs, reference).collect()} == {"c": 0.5, "d": 0.0, "e": 0.0}
    assert an.tolerance_scores(configs.limit(0), reference).collect() == []


def test_information_criteria(spark):
    df = spark.createDataFrame([(4, 3, 2, -10.0, 7)], "d int, v int, k int, l double, w int")
    plain, extended = df.select(*rs.information_criteria(*(F.col(c) for c in "dvklw"))).first()
    assert abs(plain - (5 * math.log(4) + 20)) < 1e-9 and abs(extended - ((1 + 7 + 3 + 6 + 1) * math.log(4) + 20)) < 1e-9


def test_gtf_lines_of_transcripts(spark):
    members = spark.createDataFrame([("t", "1", 101, 200), ("t", "1", 301, 400), ("u", "2", 11, 20)], "transcript_id string, chrom string, jx_start int, jx_end int")
    owners = spark.createDataFrame([("t", "g", "+"), ("t", "g", "+"), ("u", "h", "+"), ("u", "h", None)], "transcript_id string, gene_id string, strand string")
    lines = [r["value"].split("\t") for r in ex.gtf_transcripts(ex.transcript_exons(members), owners, "x").orderBy("transcript_id", "exon_no").collect()]
    assert [(x[2], x[3], x[4], x[6]) for x in lines] == [("transcript", "100", "401", "+"), ("exon", "100", "100", "+"), ("exon", "201", "300", "+"), ("exon", "401", "401", "+"), ("transcript", "10", "21", "."), ("exon", "10", "10", "."), ("exon", "21", "21", ".")]
    assert lines[0][8] == 'gene_id "g"; transcript_id "t";' and lines[2][8] == 'gene_id "g"; transcript_id "t"; exon_number "2";'


def test_paths_as_nodes(spark):
    chains = spark.createDataFrame([("f", "1", "r1", 2, "10-20,30-40", [(10, 20), (30, 40)]), ("f", "1", "r2", 2, "10-20,30-40", [(10, 20), (30, 40)]), ("f", "1", "r3", 1, "20-30", [(20, 30)]), ("f", "1", "r4", 1, "35-50", [(35, 50)]), ("f", "1", "r5", 1, "35-99", [(35, 99)])], "bam_file string, chrom string, read string, n_junctions int, chain string, j array<struct<jx_start:int,jx_end:int>>")
    genes = spark.createDataFrame([("g", "1", 1, 60), ("h", "1", 25, 60)], "gene_id string, chrom string, g_start int, g_end int")
    members = gr.path_members(chains, genes, "bam_file")
    assert {(r["gene_id"], r["node"], r["kind"], r["count"]) for r in members.collect()} == {("g", "10-20", "junction", 2), ("g", "30-40", "junction", 2), ("g", "20-30", "junction", 1), ("g", "35-50", "junction", 1), ("g", "10-20,30-40", "path", 2), ("h", "30-40", "junction", 2), ("h", "35-50", "junction", 1)}
    got = {(r["gene_id"], r["node"]): r["conflicts"] for r in gr.path_conflicts(members, "bam_file").collect()}
    assert got == {("g", "10-20"): 1, ("g", "30-40"): 2, ("g", "20-30"): 0, ("g", "35-50"): 2, ("g", "10-20,30-40"): 3, ("h", "30-40"): 1, ("h", "35-50"): 1}


def test_short_fragments(spark):
    lengths = spark.createDataFrame([(100, 2), (999, 1), (1000, 5)], "length int, n long")
    assert tuple(mt.short_fragments(lengths).first()) == (3, 1199 / 3) and tuple(mt.short_fragments(lengths.limit(0)).first()) == (0, None)
