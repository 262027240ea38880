"""Annotations: attributes, introns of transcripts, strands, reference conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attributes(text: Column) -> Column:
    """map of a GTF (``key "value";`` or ``key value``) or GFF3 (``key=value;``) attribute column; the last of repeated keys wins."""
    gff = text.contains("=") & ~text.rlike(r'\w+\s+"')
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.when(gff, F.split(p, "=", 2)).otherwise(F.split(p, r"\s+", 2)))
    named = F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(F.trim(F.get(p, F.lit(0))).alias("k"), F.regexp_replace(F.trim(F.get(p, F.lit(1))), r'^"|"$', "").alias("v")))
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def features(lines: DataFrame, line: str = "value") -> DataFrame:
    """Nine-column annotation lines as columns; short lines, comments and non-integer coordinates are left out, reversed ones swapped."""
    f = F.split(F.col(line), "\t")
    rows = lines.where(~F.col(line).startswith("#")).select(f.alias("f")).where(F.size("f") >= 9)
    a, b = F.get("f", F.lit(3)).try_cast("int"), F.get("f", F.lit(4)).try_cast("int")
    out = rows.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(2)).alias("feature"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"), F.get("f", F.lit(6)).alias("strand"), attributes(F.get("f", F.lit(8))).alias("attributes"), a.isNotNull().alias("_a"), b.isNotNull().alias("_b"))
    return out.where(F.col("_a") & F.col("_b")).drop("_a", "_b")


def gene_spans(exons: DataFrame) -> DataFrame:
    """(gene_id, chrom, g_start, g_end, strand) from exons: least start, greatest end; the strand is one other than ``.`` where there is any."""
    known = F.when(F.col("strand") != ".", F.col("strand"))
    return exons.groupBy("gene_id", "chrom").agg(F.min("e_start").alias("g_start"), F.max("e_end").alias("g_end"), F.coalesce(F.min(known), F.lit(".")).alias("strand"))


def transcript_introns(exons: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, chrom, jx_start, jx_end): gaps of one base or more between exons that follow each other."""
    order = Window.partitionBy("gene_id", "transcript_id").orderBy("e_start", "e_end")
    gaps = exons.select("gene_id", "transcript_id", "chrom", (F.col("e_end") + 1).alias("jx_start"), (F.lead("e_start").over(order) - 1).alias("jx_end"))
    return gaps.where(F.col("jx_end") >= F.col("jx_start"))


def strands_fixed(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """``rows`` with the strand of their gene (status: kept, fixed, unmapped where the gene is unknown or has none, no_gene)."""
    known = genes.where(F.col("strand").isin("+", "-")).groupBy("gene_id").agg(F.max("strand").alias("_strand"))
    j = rows.join(known, "gene_id", "left")
    status = F.when(F.col("gene_id").isNull(), "no_gene").when(F.col("_strand").isNull(), "unmapped").when(F.col("strand").eqNullSafe(F.col("_strand")), "kept").otherwise("fixed")
    return j.withColumn("status", status).withColumn("strand", F.coalesce("_strand", "strand")).drop("_strand")


def reference_sets(introns: DataFrame) -> DataFrame:
    """(gene_id, chrom, jx_start, jx_end, transcripts): the reference transcripts that hold an intron, in order."""
    return introns.groupBy("gene_id", "chrom", "jx_start", "jx_end").agg(F.sort_array(F.collect_set("transcript_id")).alias("transcripts"))


def within_tolerance(rows: DataFrame, reference: DataFrame, bases: int = 12) -> DataFrame:
    """(gene_id, jx_start, jx_end, matched): whether a junction has a reference intron of its gene with both ends within ``bases``.

    Starts are binned by the tolerance; a reference intron is offered in its own and the two neighbouring bins.
    """
    width = bases + 1
    bin_ = F.floor(F.col("jx_start") / width)
    ref = reference.select("gene_id", F.col("jx_start").alias("_s"), F.col("jx_end").alias("_e"), F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("_bin")).distinct()
    rows = rows.select("gene_id", "jx_start", "jx_end").distinct().withColumn("_bin", bin_)
    near = (F.abs(F.col("jx_start") - F.col("_s")) <= bases) & (F.abs(F.col("jx_end") - F.col("_e")) <= bases)
    hit = rows.join(ref, ["gene_id", "_bin"], "left").groupBy("gene_id", "jx_start", "jx_end").agg(F.max(F.coalesce(near, F.lit(False)).cast("int")).alias("matched"))
    return hit


def tolerance_scores(configs: DataFrame, reference: DataFrame, bases: int = 12) -> DataFrame:
    """(config, score): of the nodes of a config (config, chrom, jx_start, jx_end), each distinct one once, the share that the best single transcript of the reference
    (transcript_id, chrom, jx_start, jx_end) matches with both ends within ``bases``; 0 without any match."""
    width = bases + 1
    bin_ = F.floor(F.col("jx_start") / width)
    nodes = configs.select("config", "chrom", "jx_start", "jx_end").distinct()
    near = F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("_bin")
    ref = reference.select("transcript_id", F.col("chrom").alias("_c"), F.col("jx_start").alias("_s"), F.col("jx_end").alias("_e"), near).distinct()
    # the distinct junctions meet the reference, not each config's own copy of them
    places = nodes.select("chrom", "jx_start", "jx_end").distinct().withColumn("_pbin", bin_)
    on = (F.col("chrom") == F.col("_c")) & (F.col("_pbin") == F.col("_bin")) & (F.abs(F.col("jx_start") - F.col("_s")) <= bases) & (F.abs(F.col("jx_end") - F.col("_e")) <= bases)
    matched = places.join(ref, on).select("chrom", "jx_start", "jx_end", "transcript_id").distinct()
    best = nodes.join(matched, ["chrom", "jx_start", "jx_end"]).groupBy("config", "transcript_id").agg(F.count(F.lit(1)).alias("n")).groupBy("config").agg(F.max("n").alias("n"))
    size = nodes.groupBy("config").agg(F.count(F.lit(1)).alias("size"))
    return size.join(best, "config", "left").select("config", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("score"))


def safe_keys(names: DataFrame, name: str, ident: str) -> DataFrame:
    """(ident, key): the name with characters other than letters, digits, ``.``, ``_``, ``-`` as ``_``; keys of several ids get ``__<id>``."""
    key = F.regexp_replace(F.trim(F.col(name)), r"[^A-Za-z0-9._-]+", "_")
    rows = names.select(F.col(ident), key.alias("key")).distinct()
    several = F.count(F.lit(1)).over(Window.partitionBy("key")) > 1
    return rows.withColumn("_several", several).select(ident, F.when(F.col("_several"), F.concat_ws("__", "key", ident)).otherwise(F.col("key")).alias("key"))
