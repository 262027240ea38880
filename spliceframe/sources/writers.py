"""Writers of the file formats. Folders are overwritten whole, so a repeated run doesn't count twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceframe.session import hinted, staged

JUNC_COLUMNS = ("chrom", "chromStart", "chromEnd", ".", "score", "strand")


def _junc(df: DataFrame) -> DataFrame:
    values = (F.col("chrom"), F.col("jx_start"), F.col("jx_end"), F.lit("."), F.col("score"), F.coalesce(F.col("strand"), F.lit(".")))
    return df.select(*(c for c in ("gene_key", "sample") if c in df.columns), *(v.alias(n) for v, n in zip(values, JUNC_COLUMNS)))


def write_junc(df: DataFrame, path: str) -> None:
    """``.junc`` files with a header from (chrom, jx_start, jx_end, score, strand)."""
    _junc(df).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


#: rows of a file in a folder of a gene and sample
FILE_ROWS = 1_000_000


def write_by_gene(df: DataFrame, path: str) -> None:
    """Junctions in folders gene_key=.../sample=...; rows of a pair of them are brought together first, so that a folder has one file, or one for about every
    ``FILE_ROWS`` rows of a pair that has more, each written by a task of its own."""
    rows = _junc(df)
    keys = ["gene_key", "sample"]
    large = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files")).where(F.col("_files") > 1)
    large = hinted(staged(large.select(*(F.col(k).alias(f"_{k}") for k in keys), "_files"), "large-folders"))
    rows = rows.join(large, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop("_gene_key", "_sample")
    salted = rows.withColumn("_file", F.pmod(F.xxhash64("chrom", "chromStart", "chromEnd"), F.coalesce("_files", F.lit(1)))).drop("_files")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small ones aren't joined
    sorted_ = salted.repartition(parts, *keys, "_file").sortWithinPartitions(*keys, "_file", "chrom", "chromStart").drop("_file")
    sorted_.write.mode("overwrite").partitionBy(*keys).option("sep", "\t").option("header", True).csv(path)


def write_chains(chains: DataFrame, path: str) -> None:
    """``.jxs.tsv`` lines of reads with two junctions or more (from operators.reads.read_chains). Columns pos, strand, tlen, cigar and is_unique are written where
    ``chains`` has them; else the first junction's start, 0, 0, * and 1."""
    own = {"pos": F.col("j")[0]["jx_start"], "strand": F.lit("0"), "tlen": F.lit(0), "cigar": F.lit("*"), "is_unique": F.lit(1)}
    value = {c: F.col(c) if c in chains.columns else x for c, x in own.items()}
    rows = chains.where(F.col("n_junctions") >= 2).select("chrom", *(value[c].alias(c) for c in ("pos", "strand", "tlen", "cigar")), "chain", value["is_unique"].alias("is_unique"))
    rows.write.mode("overwrite").option("sep", "\t").csv(path)


def write_all_junctions(rows: DataFrame, path: str) -> None:
    """``.all_jxs.tsv`` lines, one for each junction of a read: qname, chrom, jx_start, jx_end, strand, cigar, is_unique (a null strand is 0, a null cigar *)."""
    out = rows.select("qname", "chrom", "jx_start", "jx_end", F.coalesce("strand", F.lit("0")).alias("strand"), F.coalesce("cigar", F.lit("*")).alias("cigar"), "is_unique")
    out.write.mode("overwrite").option("sep", "\t").csv(path)


def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """Text lines (column ``value``), ordered by ``order`` over all files."""
    df.orderBy(*order).select("value").write.mode("overwrite").text(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """Coverage runs as bedGraph, ordered by chromosome and place."""
    runs.orderBy("chrom", "start").select("chrom", "start", "end", "depth").write.mode("overwrite").option("sep", "\t").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A manifest: one JSON line per row."""
    df.write.mode("overwrite").json(path)


def write_region_sums(sums: DataFrame, regions: DataFrame, path: str, coordinates: bool = True) -> None:
    """Sums (chrom, start, end, value) of regions in the order of their file (``ord`` of readers.bed), 0 for regions without any; with or without coordinates."""
    j = regions.join(sums, ["chrom", "start", "end"], "left").orderBy("ord").withColumn("value", F.coalesce("value", F.lit(0)))
    j.select(*(["chrom", "start", "end"] if coordinates else []), "value").write.mode("overwrite").option("sep", "\t").csv(path)
