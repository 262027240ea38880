"""Transcripts and matrices for export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transcript_exons(members: DataFrame, flank: int = 1) -> DataFrame:
    """(transcript_id, exon_no, chrom, e_start, e_end) of transcripts given by their introns (transcript_id, chrom, jx_start, jx_end).

    Exons lie between introns, with ``flank`` bases before the first and after the last. Transcripts on several chromosomes, with overlapping or
    adjacent introns, or without room for the first flank are left out.
    """
    flank = max(1, flank)
    rows = members.select("transcript_id", "chrom", "jx_start", "jx_end").distinct()
    order = Window.partitionBy("transcript_id").orderBy("jx_start", "jx_end")
    rows = rows.select("*", F.lag("jx_end").over(order).alias("prev"), F.lead("jx_start").over(order).alias("next"), F.row_number().over(order).alias("no"))
    good = (F.col("jx_end") >= F.col("jx_start")) & (F.col("prev").isNull() | (F.col("jx_start") - F.col("prev") > 1)) & (F.col("prev").isNotNull() | (F.col("jx_start") > flank))
    ok = rows.groupBy("transcript_id").agg(F.min(good.cast("int")).alias("ok"), F.count_distinct("chrom").alias("chroms")).where((F.col("ok") == 1) & (F.col("chroms") == 1))
    rows = rows.join(ok.select("transcript_id"), "transcript_id", "left_semi")
    before = F.struct(F.col("no").alias("exon_no"), F.coalesce(F.col("prev") + 1, F.col("jx_start") - flank).alias("e_start"), (F.col("jx_start") - 1).alias("e_end"))
    after = F.struct((F.col("no") + 1).alias("exon_no"), (F.col("jx_end") + 1).alias("e_start"), (F.col("jx_end") + flank).alias("e_end"))
    exons = F.explode(F.when(F.col("next").isNull(), F.array(before, after)).otherwise(F.array(before)))
    return rows.select("transcript_id", "chrom", exons.alias("x")).select("transcript_id", F.col("x.exon_no").alias("exon_no"), "chrom", F.col("x.e_start").alias("e_start"), F.col("x.e_end").alias("e_end"))


def gtf_lines(exons: DataFrame, source: str = "spliceframe") -> DataFrame:
    """One text line per exon (GTF)."""
    text = F.concat_ws("\t", "chrom", F.lit(source), F.lit("exon"), "e_start", "e_end", F.lit("."), F.lit("."), F.lit("."), F.format_string('transcript_id "%s"; exon_number "%d";', "transcript_id", "exon_no"))
    return exons.select("transcript_id", "exon_no", text.alias("value"))


def gtf_transcripts(exons: DataFrame, owners: DataFrame, source: str = "spliceframe") -> DataFrame:
    """(transcript_id, exon_no, value): GTF lines, a ``transcript`` (exon_no 0) and its numbered ``exon`` lines, of exons of :func:`transcript_exons`.

    owners: (transcript_id, gene_id, strand), any number of rows a transcript, one for each member; the strand is given only if all agree on + or -, else it is ``.``.
    """
    known = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".")
    own = owners.groupBy("transcript_id").agg(F.min("gene_id").alias("gene_id"), F.when(F.min(known) == F.max(known), F.min(known)).otherwise(".").alias("strand"))
    whole = exons.groupBy("transcript_id", "chrom").agg(F.min("e_start").alias("e_start"), F.max("e_end").alias("e_end")).withColumn("exon_no", F.lit(0))
    rows = exons.unionByName(whole).join(own, "transcript_id")
    names = F.format_string('gene_id "%s"; transcript_id "%s";', "gene_id", "transcript_id")
    text = F.when(F.col("exon_no") == 0, names).otherwise(F.concat(names, F.format_string(' exon_number "%d";', "exon_no")))
    kind = F.when(F.col("exon_no") == 0, "transcript").otherwise("exon")
    return rows.select("transcript_id", "exon_no", F.concat_ws("\t", "chrom", F.lit(source), kind, "e_start", "e_end", F.lit("."), "strand", F.lit("."), text).alias("value"))


def sample_matrix(rows: DataFrame, keys: list[str], sample: str, value: str, samples: list[str]) -> DataFrame:
    """One row per keys with a column per sample of ``samples``: summed values, 0 where a sample has none."""
    return rows.groupBy(*keys).pivot(sample, samples).agg(F.sum(value)).na.fill(0, samples)
