"""Readers of the file formats, each by Spark's text or CSV source; ``.gz`` files are read like others.

Lines with too few columns or coordinates that aren't whole numbers are left out, reversed coordinates swapped. For lines that must be
accounted for use operators.parse_errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceframe.operators.annotation import features

_FORMATS = ((r"\.sam(\.gz)?$", "sam"), (r"\.junc(\.gz)?$", "junc"), (r"\.jxs\.tsv(\.gz)?$", "jxs"), (r"\.(gtf|gff3?)(\.gz)?$", "annotation"), (r"\.bed(\.gz)?$", "bed"), (r"\.(bedgraph|bg)(\.gz)?$", "bedgraph"))


def file_format(path: Column) -> Column:
    """The format by the ending of a file name, null if unknown."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(_FORMATS):
        out = F.when(F.lower(path).rlike(pattern), name).otherwise(out)
    return out


def _columns(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(F.split("value", "\t").alias("f"), "value", F.col("_metadata.file_path").alias("file"))


def _at(i: int, kind: str = "string") -> Column:
    return F.get("f", F.lit(i)).try_cast(kind)


def sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of SAM text with XS (transcribed strand, ``0`` if absent) and MD (null if absent)."""
    rows = _columns(spark, path).where(~F.col("value").startswith("@") & (F.size("f") >= 6))

    def tag(name: str) -> Column:
        return F.get(F.filter(F.slice("f", 12, F.greatest(F.size("f"), F.lit(1))), lambda t: t.startswith(name)), F.lit(0))

    names = (("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "int"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "int"), ("tlen", "int"), ("seq", "string"), ("qual", "string"))
    out = rows.select(*(_at(i, kind).alias(n) for i, (n, kind) in enumerate(names)), F.coalesce(F.substring(tag("XS:A:"), 6, 1), F.lit("0")).alias("strand"), F.substring(tag("MD:Z:"), 6, 1_000_000).alias("md"), "file")
    return out.where(F.col("flag").isNotNull() & F.col("pos").isNotNull())


def sam_contigs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, length) of the @SQ lines of SAM text."""
    rows = _columns(spark, path).where(F.col("value").startswith("@SQ"))
    field = lambda k: F.substring(F.get(F.filter("f", lambda x: x.startswith(k)), F.lit(0)), 4, 1000)
    return rows.select(field("SN:").alias("name"), field("LN:").try_cast("int").alias("length")).distinct()


def junc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Junctions of ``.junc`` files with their sample (the file's name up to the first dot)."""
    rows = _columns(spark, path).where(F.size("f") >= 6)
    a, b = _at(1, "int"), _at(2, "int")
    sample = F.regexp_extract(F.col("file"), r"([^/.]+)[^/]*$", 1)
    out = rows.select(sample.alias("sample_id"), _at(0).alias("chrom"), F.least(a, b).alias("jx_start"), F.greatest(a, b).alias("jx_end"), _at(4, "int").alias("score"), _at(5).alias("strand"), (a.isNotNull() & b.isNotNull()).alias("_ok"))
    return out.where("_ok").drop("_ok")


def intron_list(text: Column) -> Column:
    """array<struct<jx_start, jx_end>> of ``a-b,c-d``; parts that aren't two numbers are left out, reversed ones swapped."""
    pairs = F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), "-"))
    whole = F.filter(pairs, lambda p: (F.size(p) == 2) & F.forall(p, lambda x: x.rlike(r"\A[0-9]{1,9}\z")))
    return F.transform(whole, lambda p: F.struct(F.least(F.get(p, F.lit(0)).cast("int"), F.get(p, F.lit(1)).cast("int")).alias("jx_start"), F.greatest(F.get(p, F.lit(0)).cast("int"), F.get(p, F.lit(1)).cast("int")).alias("jx_end")))


def jxs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, read, chrom, jx_start, jx_end, is_unique) of co-occurring junctions: 7 columns, or 14 with a mate; mates on two chromosomes are dropped.

    A line is a read; its name is its place in the file, as the format has none.
    """
    rows = _columns(spark, path).where((F.size("f") >= 6) & ((F.size("f") <= 12) | (F.get("f", F.lit(7)) == F.get("f", F.lit(0)))))
    both = F.concat(intron_list(_at(5)), F.when(F.size("f") > 12, intron_list(_at(12))).otherwise(F.array()))
    rows = rows.withColumn("read", F.monotonically_increasing_id().cast("string"))  # before the lists are exploded
    rows = rows.select("file", "read", _at(0).alias("chrom"), F.coalesce(_at(6, "int"), F.lit(0)).alias("is_unique"), F.explode(both).alias("x"))
    return rows.select("file", "read", "chrom", "x.jx_start", "x.jx_end", "is_unique")


def annotation(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Features of GTF or GFF3 files: chrom, feature, start, end, strand, attributes."""
    return features(spark.read.text(path))


def exons(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(gene_id, transcript_id, chrom, e_start, e_end, strand) of the exons that name both."""
    a = F.col("attributes")
    rows = annotation(spark, path).where((F.col("feature") == "exon") & a["gene_id"].isNotNull() & a["transcript_id"].isNotNull())
    return rows.select(a["gene_id"].alias("gene_id"), a["transcript_id"].alias("transcript_id"), "chrom", F.col("start").alias("e_start"), F.col("end").alias("e_end"), "strand")


def gene_intervals(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(gene_id, gene_name, chrom, g_start, g_end, strand): the gene features if a gene has any, else the span of its exons."""
    a = F.col("attributes")
    ident = F.coalesce(a["gene_id"], a["ID"])
    rows = annotation(spark, path).where(F.col("feature").isin("gene", "exon") & ident.isNotNull())
    rows = rows.select(ident.alias("gene_id"), F.coalesce(a["gene_name"], a["Name"], ident).alias("gene_name"), "chrom", "start", "end", "strand", (F.col("feature") == "gene").cast("int").alias("own"))
    best = rows.groupBy("gene_id").agg(F.max("own").alias("_own"))
    rows = rows.join(best, "gene_id").where(F.col("own") == F.col("_own"))
    known = F.when(F.col("strand") != ".", F.col("strand"))
    return rows.groupBy("gene_id").agg(F.min("gene_name").alias("gene_name"), F.min("chrom").alias("chrom"), F.min("start").alias("g_start"), F.max("end").alias("g_end"), F.coalesce(F.min(known), F.lit(".")).alias("strand"))


def bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, start, end, ord): regions, 0-based and half-open; ord grows in the order of the lines."""
    rows = _columns(spark, path).select(_at(0).alias("chrom"), _at(1, "int").alias("start"), _at(2, "int").alias("end"), F.monotonically_increasing_id().alias("ord"))
    return rows.where(F.col("start").isNotNull() & F.col("end").isNotNull())


def bedgraph(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, chrom, start, end, value) of signal intervals, 0-based and half-open; any number of files."""
    rows = _columns(spark, path).select("file", _at(0).alias("chrom"), _at(1, "int").alias("start"), _at(2, "int").alias("end"), _at(3, "float").alias("value"))
    return rows.where(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("value").isNotNull())
