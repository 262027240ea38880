"""From alignments and per-read junctions to counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceframe.functions import cigar as cg

UNIQUE_QUALITY = 10


def primary(df: DataFrame, supplementary: bool = False) -> DataFrame:
    """Mapped, primary alignments (flag without 4 and 256, nor 2048 unless ``supplementary``)."""
    return df.where(F.col("flag").bitwiseAND(4 + 256 + (0 if supplementary else 2048)) == 0)


def masked(df: DataFrame, any_of: int | None = None, none_of: int = 260) -> DataFrame:
    """Alignments with any bit of ``any_of`` (all if None) and no bit of ``none_of``."""
    keep = F.col("flag").bitwiseAND(none_of) == 0
    return df.where(keep if any_of is None else keep & (F.col("flag").bitwiseAND(any_of) != 0))


def with_chr(chrom: Column, species: str = "human") -> Column:
    """The name with ``chr`` for the numbered chromosomes of the species, X, Y, M; MT becomes chrM; other names stay."""
    numbered = [str(i) for i in range(1, {"human": 22, "mouse": 19}[species] + 1)]
    return F.when(chrom == "MT", "chrM").when(chrom.isin(*numbered, "X", "Y", "M"), F.concat(F.lit("chr"), chrom)).otherwise(chrom)


def read_introns(df: DataFrame, anchored: bool = True) -> DataFrame:
    """(qname, chrom, jx_start, jx_end, is_unique), one row per intron of a read."""
    spans = (cg.anchored_introns if anchored else cg.introns)(F.col("pos"), F.col("cigar"))
    unique = F.when(F.col("mapq") >= UNIQUE_QUALITY, 1).otherwise(0)
    rows = df.select("qname", F.col("rname").alias("chrom"), unique.alias("is_unique"), F.explode(spans).alias("x"))
    return rows.select("qname", "chrom", F.col("x.s").alias("jx_start"), F.col("x.e").alias("jx_end"), "is_unique")


def junction_reads(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, jx_start, jx_end, n_unique, n_multi): reads per junction, each read once (unique if any of its rows is)."""
    once = df.groupBy(*keys, "jx_start", "jx_end", "read").agg(F.max("is_unique").alias("u"))
    return once.groupBy(*keys, "jx_start", "jx_end").agg(F.count_if(F.col("u") == 1).alias("n_unique"), F.count_if(F.coalesce(F.col("u"), F.lit(0)) != 1).alias("n_multi"))


def read_chains(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, read, chain): the distinct junctions of each read, in order, as one text ``start-end,start-end``."""
    once = df.groupBy(*keys, "read").agg(F.sort_array(F.collect_set(F.struct("jx_start", "jx_end"))).alias("j"))
    text = F.array_join(F.transform("j", lambda x: F.concat_ws("-", x["jx_start"], x["jx_end"])), ",")
    return once.select(*keys, "read", F.size("j").alias("n_junctions"), text.alias("chain"), F.col("j"))


def paths(chains: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chain, n_junctions, n_reads): long-read paths, chains of two junctions or more with their reads."""
    return chains.where(F.col("n_junctions") >= 2).groupBy(*keys, "chain", "n_junctions").agg(F.count(F.lit(1)).alias("n_reads"))


def coverage_blocks(df: DataFrame) -> DataFrame:
    """(chrom, start, end): aligned blocks of the alignments, 0-based and half-open."""
    rows = df.select(F.col("rname").alias("chrom"), F.explode(cg.blocks(F.col("pos"), F.col("cigar"))).alias("b"))
    return rows.select("chrom", (F.col("b.s") - 1).alias("start"), F.col("b.e").alias("end"))


def read_ends(df: DataFrame) -> DataFrame:
    """(chrom, pos, side, n): alignments that start (or end) at a position."""
    ends = F.array(F.struct(F.lit("start").alias("side"), F.col("pos").alias("pos")), F.struct(F.lit("end").alias("side"), cg.reference_end(F.col("pos"), F.col("cigar")).alias("pos")))
    return df.select(F.col("rname").alias("chrom"), F.explode(ends).alias("x")).groupBy("chrom", "x.pos", "x.side").agg(F.count(F.lit(1)).alias("n"))


def totals(df: DataFrame) -> DataFrame:
    """One row: alignments, aligned bases and soft-clipped bases."""
    return df.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(cg.aligned_bases(F.col("cigar"))), F.lit(0)).alias("bases"), F.coalesce(F.sum(cg.soft_clipped(F.col("cigar"))), F.lit(0)).alias("soft_clipped"))
