"""Result tables of fitted genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_rows(by_sample: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gene_id, trans_id, trans_index, node_id, jx_start, jx_end, sample_id, expected_count) of the rows of ``inferred(..., by_sample=True)``."""
    place = nodes.select("gene_id", "node_id", "jx_start", "jx_end")
    name = F.concat(F.col("gene_id"), F.lit(".t"), F.col("k"))
    return by_sample.join(place, ["gene_id", "node_id"]).select("gene_id", name.alias("trans_id"), F.col("k").alias("trans_index"), "node_id", "jx_start", "jx_end", "sample_id", "expected_count")


def wide_shares(result: DataFrame, clusters: int) -> DataFrame:
    """(gene_id, node_id, k0, k1, ...): shares of the nodes in the first ``clusters`` clusters, one column each; null where a gene has fewer."""
    columns = [F.max(F.when(F.col("k") == k, F.col("share"))).alias(f"k{k}") for k in range(clusters)]
    return result.groupBy("gene_id", "node_id").agg(*columns)


def transcript_members(result: DataFrame, nodes: DataFrame) -> DataFrame:
    """(transcript_id, chrom, jx_start, jx_end) of the members of each cluster, for export.transcript_exons."""
    rows = result.where("member").join(nodes.select("gene_id", "node_id", "chrom", "jx_start", "jx_end"), ["gene_id", "node_id"])
    return rows.select(F.concat_ws("_", F.col("gene_id"), F.concat(F.lit("C"), F.col("k"))).alias("transcript_id"), "chrom", "jx_start", "jx_end")


def unconflicted_members(nodes: DataFrame, cliques: DataFrame) -> DataFrame:
    """(transcript_id, chrom, jx_start, jx_end): the one transcript of each gene without conflicts, of all its junctions."""
    alone = cliques.where(F.col("clique_number") == 1).select("gene_id")
    return nodes.join(alone, "gene_id", "left_semi").select(F.concat_ws("_", "gene_id", F.lit("C0")).alias("transcript_id"), "chrom", "jx_start", "jx_end").distinct()


def information_criteria(samples: Column, nodes: Column, clusters: Column, loglik: Column, reads: Column) -> tuple[Column, Column]:
    """(the criterion with nodes + clusters as its parameters, the extended one, which counts those of mixtures, reads, weights, masks and their prior), less twice the log-likelihood."""
    free = clusters - 1
    extended = free + reads * free + nodes * free + nodes * clusters + free
    return (nodes + clusters) * F.log(samples.cast("double")) - 2 * loglik, extended * F.log(samples.cast("double")) - 2 * loglik


def restricted(df: DataFrame, names: DataFrame, column: str, *others: DataFrame, every: bool = False) -> DataFrame:
    """Rows whose ``column`` is in the lists of names (one column each): in any, or with ``every`` in all of them. The lists' order and repeats don't matter."""
    lists = [x.select(F.trim(F.col(x.columns[0])).alias(column)).where(F.col(column) != "") for x in (names, *others)]
    if every:
        for x in lists:
            df = df.join(x.distinct(), column, "left_semi")
        return df
    union = lists[0]
    for x in lists[1:]:
        union = union.unionByName(x)
    return df.join(union.distinct(), column, "left_semi")


def with_zero_tiles(tiles: DataFrame, contigs: DataFrame, width: int) -> DataFrame:
    """(chrom, tile, bases, mean): tiles (chrom, tile, bases) of every contig (name, length), zeros where there is no coverage; the last tile's mean
    is over its true length."""
    every = contigs.where(F.col("length") > 0).select(F.col("name").alias("chrom"), "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / width).cast("int"))).alias("tile"))
    j = every.join(tiles, ["chrom", "tile"], "left").withColumn("bases", F.coalesce("bases", F.lit(0).cast("long")))
    own = F.least(F.lit(width), F.col("length") - F.col("tile") * width)
    return j.select("chrom", "tile", "bases", (F.col("bases") / own).alias("mean"))
