"""Read pairs: fragment lengths, and coverage that counts a pair's bases once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceframe.functions import cigar as cg


def _bits(mask: int, value: int) -> Column:
    return F.col("flag").bitwiseAND(mask) == value


def pairs(df: DataFrame) -> DataFrame:
    """(qname, rname, first, second): the two primary alignments of a pair on one contig as structs (pos, flag, tlen, cigar), by position.

    Only names with exactly two such alignments; a name with any number of them is aggregated in constant memory.
    """
    mates = df.where(_bits(1 + 4 + 8 + 256 + 2048, 1))
    row = F.struct("pos", "flag", "tlen", "cigar")
    both = mates.groupBy("qname", "rname").agg(F.min(row).alias("first"), F.max(row).alias("second"), F.count(F.lit(1)).alias("n"))
    return both.where(F.col("n") == 2).drop("n")


def fragment_lengths(df: DataFrame) -> DataFrame:
    """(length, n): outer length of pairs on opposite strands, without the distinct introns of both mates (with them if they exceed it)."""
    p = pairs(df).where((F.col("first.flag").bitwiseXOR(F.col("second.flag"))).bitwiseAND(16) == 16)
    introns = F.array_distinct(F.concat(cg.introns(F.col("first.pos"), F.col("first.cigar")), cg.introns(F.col("second.pos"), F.col("second.cigar"))))
    spliced = F.aggregate(introns, F.lit(0), lambda a, x: a + x["e"] - x["s"] + 1)
    outer = F.abs(F.col("first.tlen"))
    return p.where(outer > 0).select(F.when(spliced > outer, outer).otherwise(outer - spliced).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


def fragment_summary(lengths: DataFrame) -> DataFrame:
    """One row: count, mean, mode (the smallest of several), mode_count of a histogram (length, n)."""
    best = F.max(F.struct("n", (-F.col("length")).alias("l")))
    out = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.sum(F.col("length") * F.col("n")).alias("total"), best.alias("b"))
    return out.select("count", F.try_divide("total", "count").alias("mean"), (-F.col("b.l")).alias("mode"), F.col("b.n").alias("mode_count"))


def short_fragments(lengths: DataFrame, below: int = 1000) -> DataFrame:
    """One row: count and mean of the fragments of a histogram (length, n) that are shorter than ``below``; the mean of none is null."""
    out = lengths.where(F.col("length") < below).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.sum(F.col("length") * F.col("n")).alias("total"))
    return out.select("count", F.try_divide("total", "count").alias("mean"))


def coverage_events(df: DataFrame) -> DataFrame:
    """(chrom, start, end, weight): aligned blocks (weight 1), and the parts that both mates of a proper pair cover (weight -1)."""
    block = F.explode(cg.blocks(F.col("pos"), F.col("cigar"))).alias("b")
    plus = df.select(F.col("rname").alias("chrom"), block).select("chrom", (F.col("b.s") - 1).alias("start"), F.col("b.e").alias("end"), F.lit(1).alias("weight"))
    p = pairs(df).where(F.col("first.flag").bitwiseAND(2) == 2)
    a, b = cg.blocks(F.col("first.pos"), F.col("first.cigar")), cg.blocks(F.col("second.pos"), F.col("second.cigar"))
    p = p.select("rname", a.alias("a"), b.alias("b"))
    shared = F.flatten(F.transform("a", lambda x: F.transform(F.filter("b", lambda y: (y["s"] <= x["e"]) & (x["s"] <= y["e"])), lambda y: F.struct(F.greatest(x["s"], y["s"]).alias("s"), F.least(x["e"], y["e"]).alias("e")))))
    minus = p.select(F.col("rname").alias("chrom"), F.explode(shared).alias("x")).select("chrom", (F.col("x.s") - 1).alias("start"), F.col("x.e").alias("end"), F.lit(-1).alias("weight"))
    return plus.unionByName(minus)


def paired_chains(df: DataFrame) -> DataFrame:
    """(qname, rname, first, second): the junctions of both mates (``start-end,start-end``) of pairs of which a mate has two or both have one; else
    a mate's list is empty if it has less than two and the other none. Pairs whose first tlen is 0 are left out."""
    text = lambda x: F.array_join(F.transform(x, lambda i: F.concat_ws("-", i["s"], i["e"])), ",")
    p = pairs(df).where(F.col("first.tlen") != 0)
    p = p.select("qname", "rname", cg.introns(F.col("first.pos"), F.col("first.cigar")).alias("a"), cg.introns(F.col("second.pos"), F.col("second.cigar")).alias("b"))
    n, m = F.size("a"), F.size("b")
    both = (n >= 1) & (m >= 1)
    rows = p.where(both | (n >= 2) | (m >= 2))
    return rows.select("qname", "rname", F.when(both | (n >= 2), text(F.col("a"))).otherwise("").alias("first"), F.when(both | (m >= 2), text(F.col("b"))).otherwise("").alias("second"))
