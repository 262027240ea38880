import gzip
import os

from pyspark.sql import functions as F

from spliceframe.operators import reads as rd
from spliceframe.sources import small_files
from spliceframe.sources import readers, writers
from spliceframe.streaming import junction_stream as js


def _write(path, text):
    with (gzip.open if str(path).endswith(".gz") else open)(path, "wt") as f:
        f.write(text)
    return str(path)


def test_sam(spark, tmp_path):
    line = "r1\t0\t1\t100\t60\t6M100N6M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tXS:A:-\tMD:Z:12\n"
    path = _write(tmp_path / "a.sam.gz", "@SQ\tSN:1\tLN:1000\n" + line + "short\t0\n" + line.replace("XS:A:-\t", "").replace("100", "x", 1))
    row = readers.sam(spark, path).collect()
    assert [(r["qname"], r["pos"], r["strand"], r["md"]) for r in row] == [("r1", 100, "-", "12")]
    assert [tuple(r) for r in readers.sam_contigs(spark, path).collect()] == [("1", 1000)]
    assert [tuple(r)[1:] for r in rd.read_introns(readers.sam(spark, path)).collect()] == [("1", 106, 205, 1)]


def test_junc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("g", "S1", "1", 5, 9, 3, "+"), ("g", "S2", "1", 5, 9, None, None)], "gene_key string, sample string, chrom string, jx_start int, jx_end int, score int, strand string")
    writers.write_by_gene(df, f"{tmp_path}/genes")
    writers.write_by_gene(df, f"{tmp_path}/genes")
    got = readers.junc(spark, f"{tmp_path}/genes")
    assert sorted(tuple(r)[1:] for r in got.fillna(-1).collect()) == [("1", 5, 9, -1, "."), ("1", 5, 9, 3, "+")]
    path = _write(tmp_path / "SMP1.x.junc.gz", "chrom\tchromStart\tchromEnd\t.\tscore\tstrand\n1\t9\t5\t.\t3\t-\nbad\n")
    assert [tuple(r) for r in readers.junc(spark, path).collect()] == [("SMP1", "1", 5, 9, 3, "-")]


def test_jxs(spark, tmp_path):
    seven = "1\t10\t0\t0\t5M\t20-11,x,30-40,7\t1"
    path = _write(tmp_path / "a.jxs.tsv", seven + "\n" + seven + "\t" + seven + "\n" + seven + "\t" + seven.replace("1\t10", "2\t10") + "\nx\ty\n")
    got = readers.jxs(spark, path)
    assert sorted((r["chrom"], r["jx_start"], r["jx_end"]) for r in got.collect()) == [("1", 11, 20)] * 3 + [("1", 30, 40)] * 3
    assert got.select("read").distinct().count() == 2


def test_annotation(spark, tmp_path):
    gtf = '1\tt\tgene\t50\t9\t.\t+\t.\tgene_id "A"; gene_name "N";\n' + "".join(f'1\tt\texon\t{s}\t{e}\t.\t-\t.\tgene_id "{g}"; transcript_id "T";\n' for g, s, e in (("A", 1, 99), ("B", 10, 20), ("B", 31, 40)))
    path = _write(tmp_path / "a.gtf", "#!x\n" + gtf)
    assert sorted(tuple(r) for r in readers.gene_intervals(spark, path).collect()) == [("A", "N", "1", 9, 50, "+"), ("B", "B", "1", 10, 40, "-")]
    assert readers.exons(spark, path).count() == 3


def test_regions_and_signals(spark, tmp_path):
    b = readers.bed(spark, _write(tmp_path / "a.bed", "1\t5\t9\n1\tx\t9\n1\t1\t2\n")).orderBy("ord").collect()
    assert [(r["start"], r["end"]) for r in b] == [(5, 9), (1, 2)]
    path = _write(tmp_path / "a.bg", "1\t0\t5\t1.5\n1\t5\t6\t\n")
    assert [r["value"] for r in readers.bedgraph(spark, path).collect()] == [1.5]
    names = spark.createDataFrame([("x/A.SAM",), ("a.junc.gz",), ("a.jxs.tsv",), ("a.gff3",), ("b.bam",)], "p string").coalesce(1)
    assert [r[0] for r in names.select(readers.file_format(F.col("p"))).collect()] == ["sam", "junc", "jxs", "annotation", None]


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/gene_junc.parquet"
    rows = lambda df: df.where("loaded_at IS NOT NULL AND gene_name IS NOT NULL")
    batch = js.windowed_counts(rows(spark.read.parquet(path)), ["gene_name"], "loaded_at", "1 hour", "1 hour")
    stream = js.once(js.windowed_counts(rows(js.stream_of(spark, path)), ["gene_name"], "loaded_at", "1 hour", "0 seconds"))
    want = {tuple(r) for r in batch.collect()}
    got = {tuple(r) for r in stream.collect()}
    newest = max(r[1] for r in want)
    assert got and got <= want and all(r[1] == newest for r in want - got)


def test_sums_keep_the_order_of_the_regions(spark, tmp_path):
    regions = readers.bed(spark, _write(tmp_path / "a.bed", "2\t5\t9\n1\t1\t4\n2\t0\t3\n"))
    sums = spark.createDataFrame([("1", 1, 4, 7), ("2", 5, 9, 3)], "chrom string, start int, end int, value long")
    writers.write_region_sums(sums, regions, f"{tmp_path}/sums")
    parts = sorted((tmp_path / "sums").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "2\t5\t9\t3\n1\t1\t4\t7\n2\t0\t3\t0\n"
    writers.write_region_sums(sums, regions, f"{tmp_path}/sums", coordinates=False)
    assert "".join(p.read_text() for p in sorted((tmp_path / "sums").glob("part-*"))) == "3\n7\n0\n"


def test_small_files_come_back_whole(spark, tmp_path):
    rows = [("a/1.junc", "x"), ("a/1.junc", "y\tz"), ("b.junc", "ключ"), (None, "lost"), ("b.junc", None)] + [(f"d/{i}.junc", f"v{i}") for i in range(300)]
    small_files.write_small_files(spark.createDataFrame(rows, "file_name string, value string").repartition(4), f"{tmp_path}/store")
    got = sorted((r["file_name"], r["value"]) for r in small_files.read_small_files(spark, f"file://{tmp_path}/store").collect())
    assert got == sorted(r for r in rows if None not in r)
    assert sum(len(f) for _, _, f in os.walk(tmp_path)) == 302


def test_no_small_files(spark, tmp_path):
    small_files.write_small_files(spark.createDataFrame([], "file_name string, value string"), f"{tmp_path}/store")
    assert small_files.read_small_files(spark, f"{tmp_path}/store").count() == 0


def test_large_folders_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILE_ROWS", 100)
    rows = [("g", "s", "1", i, i + 5, 1, "+") for i in range(450)] + [("h", "s", "1", i, i + 5, 1, None) for i in range(20)]
    writers.write_by_gene(spark.createDataFrame(rows, "gene_key string, sample string, chrom string, jx_start int, jx_end int, score int, strand string"), f"{tmp_path}/by")
    files = {k: [f for f in os.listdir(f"{tmp_path}/by/gene_key={k}/sample=s") if f.endswith(".csv")] for k in "gh"}
    assert 1 < len(files["g"]) <= 5 and len(files["h"]) == 1
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/by").count() == 470


def test_junctions_of_reads_with_strand_and_cigar(spark, tmp_path):
    rows = [("r1", "1", 5, 9, "+", "4M5N4M", 1), ("r2", "1", 7, 9, None, None, 0)]
    writers.write_all_junctions(spark.createDataFrame(rows, "qname string, chrom string, jx_start int, jx_end int, strand string, cigar string, is_unique int"), f"{tmp_path}/all")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/all").collect()) == ["r1\t1\t5\t9\t+\t4M5N4M\t1", "r2\t1\t7\t9\t0\t*\t0"]
    chains = spark.createDataFrame([("1", 2, [(5, 9), (20, 30)], "5-9,20-30", "-", "x", 3)], "chrom string, n_junctions int, j array<struct<jx_start:int,jx_end:int>>, chain string, strand string, cigar string, pos int")
    writers.write_chains(chains, f"{tmp_path}/jxs")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/jxs").collect()] == ["1\t3\t-\t0\tx\t5-9,20-30\t1"]
