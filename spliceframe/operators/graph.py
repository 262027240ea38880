"""Junction nodes of genes, their conflict graph and what is counted on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceframe.operators.intervals import containment_join, max_depth, overlapping_pairs

NODE = ["chrom", "jx_start", "jx_end", "strand"]


def support(junctions: DataFrame, keys: list[str]) -> DataFrame:
    """Summed score per keys and junction (null scores count as none; all null: 0)."""
    return junctions.groupBy(*keys, *NODE).agg(F.coalesce(F.sum("score"), F.lit(0)).alias("score"))


def floored(supported: DataFrame, least: int) -> DataFrame:
    """Junctions with a summed score of ``least`` or more; ``least`` of 0 or below keeps all."""
    return supported.where(F.col("score") >= least) if least > 0 else supported


def gene_nodes(junctions: DataFrame, genes: DataFrame, least: int = 30) -> DataFrame:
    """(gene_id, node_id, chrom, jx_start, jx_end, strand, score): the junctions inside each gene, numbered from 0 by chrom, end, start, strand.

    Junctions are summed before the range join, which so meets each distinct junction once.
    """
    inside = containment_join(floored(support(junctions, []), least), genes)
    order = Window.partitionBy("gene_id").orderBy("chrom", "jx_end", "jx_start", F.col("strand").asc_nulls_first())
    return inside.withColumn("node_id", F.row_number().over(order) - 1).select("gene_id", "node_id", *NODE, "score")


def conflict_edges(nodes: DataFrame) -> DataFrame:
    """(gene_id, u, v, overlap_pct), u < v: nodes of a gene that can't be in one transcript; shared length over mean length."""
    pairs = overlapping_pairs(nodes, ["gene_id", "chrom"], "node_id", "jx_start", "jx_end", 10_000)
    shared = F.least("u_end", "v_end") - F.greatest("u_start", "v_start")
    mean = (F.col("u_end") - F.col("u_start") + F.col("v_end") - F.col("v_start")) / 2
    return pairs.select("gene_id", "u", "v", (shared / mean).alias("overlap_pct"))


def degrees(edges: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")), F.struct(F.col("v").alias("n"), F.col("u").alias("m"))))
    return edges.select("gene_id", both.alias("x")).groupBy("gene_id", F.col("x.n").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.min("x.m").alias("lowest"))


def lower_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gene_id, node_id, lo, degree): the smallest neighbour below a node, else the node itself."""
    d = degrees(edges)
    j = nodes.select("gene_id", "node_id").join(d, ["gene_id", "node_id"], "left")
    return j.select("gene_id", "node_id", F.least("node_id", F.coalesce("lowest", "node_id")).alias("lo"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def clique_numbers(nodes: DataFrame) -> DataFrame:
    """(gene_id, nodes, clique_number): the largest set of nodes that all conflict, so the least number of transcripts; 1 without conflicts.

    Junctions are intervals, so this is their greatest depth.
    """
    size = nodes.groupBy("gene_id").agg(F.count(F.lit(1)).alias("nodes"))
    deep = max_depth(nodes, ["gene_id", "chrom"], "jx_start", "jx_end").groupBy("gene_id").agg(F.max("depth").alias("depth"))
    return size.join(deep, "gene_id", "left").select("gene_id", "nodes", F.greatest(F.lit(1), F.coalesce("depth", F.lit(1))).cast("long").alias("clique_number"))


def document_matrix(junctions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gene_id, sample_id, node_id, count): scores of the samples at the nodes, sparse; junctions that are no node are left out."""
    per_sample = support(junctions, ["sample_id"]).where(F.col("score") > 0).withColumnRenamed("score", "count")
    own = nodes.select("gene_id", "node_id", *(F.col(c).alias(f"_{c}") for c in NODE))
    on = [per_sample[c].eqNullSafe(F.col(f"_{c}")) for c in NODE]
    return per_sample.join(own, on).select("gene_id", "sample_id", "node_id", "count")


def path_members(chains: DataFrame, genes: DataFrame, file: str) -> DataFrame:
    """(gene_id, file, node, kind, count, j): nodes of the genes that reads show in a file: every junction (count: the reads that hold it) and, as a node of several segments
    ``j``, every path of two junctions or more (count: the reads that show it whole). A node belongs to the genes that contain it from its first to its last base."""
    text = lambda x: F.concat_ws("-", x["jx_start"], x["jx_end"])
    one = chains.select(file, "chrom", F.explode("j").alias("x")).groupBy(file, "chrom", "x").agg(F.count(F.lit(1)).alias("count"))
    one = one.select(file, "chrom", F.lit("junction").alias("kind"), text(F.col("x")).alias("node"), "count", F.array("x").alias("j"))
    several = chains.where(F.col("n_junctions") >= 2).groupBy(file, "chrom", F.col("chain").alias("node"), "j").agg(F.count(F.lit(1)).alias("count"))
    nodes = one.unionByName(several.select(file, "chrom", F.lit("path").alias("kind"), "node", "count", "j"))
    spans = nodes.withColumns({"_from": F.array_min(F.transform("j", lambda x: x["jx_start"])), "_to": F.array_max(F.transform("j", lambda x: x["jx_end"]))})
    return containment_join(spans, genes, start="_from", end="_to").select("gene_id", file, "chrom", "node", "kind", "count", "j")


def path_conflicts(members: DataFrame, file: str) -> DataFrame:
    """(gene_id, file, node, conflicts): of the nodes of :func:`path_members` the number of others of their gene, file and chromosome that they conflict with: some
    segment of one overlaps some of the other (touching ends don't). The distinct junctions of a file meet each other once, whatever the number of paths that hold them."""
    keys = ["gene_id", file, "chrom"]
    segments = members.select(*keys, "node", F.explode("j").alias("x")).select(*keys, "node", "x.jx_start", "x.jx_end")
    distinct = segments.select(*keys, "jx_start", "jx_end").distinct().withColumn("_id", F.concat_ws("-", "jx_start", "jx_end"))
    pairs = overlapping_pairs(distinct, keys, "_id", "jx_start", "jx_end", 10_000).select(*keys, F.col("u").alias("_a"), F.col("v").alias("_b"))
    itself = distinct.where(F.col("jx_end") > F.col("jx_start")).select(*keys, F.col("_id").alias("_a"), F.col("_id").alias("_b"))
    both = pairs.unionByName(pairs.select(*keys, F.col("_b").alias("_a"), F.col("_a").alias("_b"))).unionByName(itself)
    held = segments.select(*keys, "node", F.concat_ws("-", "jx_start", "jx_end").alias("_a"))
    reached = held.join(both, [*keys, "_a"]).select(*keys, "node", "_b").distinct()
    other = held.select(*keys, F.col("node").alias("_other"), F.col("_a").alias("_b"))
    met = reached.join(other, [*keys, "_b"]).where(F.col("node") != F.col("_other")).groupBy(*keys, "node").agg(F.count_distinct("_other").alias("conflicts"))
    return members.select(*keys, "node").join(met, [*keys, "node"], "left").select("gene_id", file, "node", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def independent_sets(nodes: DataFrame) -> DataFrame:
    """(gene_id, node_id): a largest set of nodes without conflicts in each gene (earliest end first, ends may touch the next start).

    A gene's nodes, which number at most the junctions of a gene, are walked in order by a fold.
    """
    key = F.struct("jx_end", "jx_start", "node_id", "chrom")
    ordered = nodes.where(F.col("jx_end") > F.col("jx_start")).groupBy("gene_id", "chrom").agg(F.sort_array(F.collect_list(key)).alias("all"))
    start = F.struct(F.lit(-(2**31)).alias("at"), F.array().cast("array<int>").alias("ids"))
    walked = F.aggregate("all", start, lambda a, x: F.when(x["jx_start"] >= a["at"], F.struct(x["jx_end"].alias("at"), F.concat(a["ids"], F.array(x["node_id"])).alias("ids"))).otherwise(a), lambda a: a["ids"])
    return ordered.select("gene_id", F.explode(walked).alias("node_id"))


def cooccurrence_prior(chains: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, u, weight): of the reads with two junctions or more that hold v, the share that also holds u. v, u are ``start-end``."""
    name = lambda x: F.concat_ws("-", x["jx_start"], x["jx_end"])
    several = chains.where(F.col("n_junctions") >= 2).select(*keys, "j").groupBy(*keys, "j").agg(F.count(F.lit(1)).alias("w"))
    pairs = F.flatten(F.transform("j", lambda a: F.transform(F.filter("j", lambda b: b != a), lambda b: F.struct(name(a).alias("v"), name(b).alias("u")))))
    both = several.select(*keys, "w", F.explode(pairs).alias("p")).groupBy(*keys, "p.v", "p.u").agg(F.sum("w").alias("c"))
    one = several.select(*keys, "w", F.explode(F.transform("j", name)).alias("v")).groupBy(*keys, "v").agg(F.sum("w").alias("t"))
    return both.join(one, [*keys, "v"]).select(*keys, "v", "u", (F.col("c") / F.col("t")).alias("weight"))


def top_mass(weights: DataFrame, keys: list[str], ident: str, weight: str, share: float = 0.8) -> DataFrame:
    """Rows of positive weight, heaviest first, until ``share`` of the group's weight is reached (the row that reaches it included)."""
    order = Window.partitionBy(*keys).orderBy(F.col(weight).desc(), ident)
    before = F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(weight).over(Window.partitionBy(*keys))
    marked = weights.where(F.col(weight) > 0).withColumn("_before", before).withColumn("_total", total)
    return marked.where(F.col("_before") < F.col("_total") * share).drop("_before", "_total")


def reference_edges(members: DataFrame, group: str) -> DataFrame:
    """(group, u, v), u < v: junctions of a group that have reference transcripts but none in common; members are (group, transcript, node).

    As many as such pairs exist; a group is a gene, so its pairs are bounded by its junctions.
    """
    known = members.select(group, "node").distinct()
    one = known.select(group, F.col("node").alias("u"))
    two = known.select(group, F.col("node").alias("v"))
    sets = members.distinct().groupBy(group, "transcript").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    pairs = F.flatten(F.transform("nodes", lambda a, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    shared = sets.select(group, F.explode(pairs).alias("p")).select(group, "p.u", "p.v").distinct()
    return one.join(two, group).where(F.col("u") < F.col("v")).join(shared, [group, "u", "v"], "left_anti")


def active_edges(overlaps: DataFrame, reference: DataFrame, supported: DataFrame, group: str, variant: str) -> DataFrame:
    """(group, u, v) of a graph variant: ``current`` the overlaps; ``hybrid`` also the reference edges; ``reference`` both, between supported nodes (group, node) only."""
    if variant == "current":
        return overlaps.select(group, "u", "v")
    both = overlaps.select(group, "u", "v").unionByName(reference.select(group, "u", "v")).distinct()
    if variant == "hybrid":
        return both
    if variant != "reference":
        raise ValueError(variant)
    for end in "uv":
        both = both.join(supported.select(group, F.col("node").alias(end)).distinct(), [group, end], "left_semi")
    return both.select(group, "u", "v")


def cluster_numbers(cliques: DataFrame, most: int = 9) -> DataFrame:
    """(gene_id, clusters): numbers of clusters to try, every other one from the clique number on."""
    return cliques.select("gene_id", F.explode(F.sequence(F.col("clique_number"), F.col("clique_number") + 2 * (most - 1), F.lit(2).cast("long"))).alias("clusters"))


def _per_gene(rows: DataFrame, schema: str, solve) -> DataFrame:
    """Applies ``solve(gene, table) -> columns`` to the rows of each gene (bounded by its nodes or samples)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.table(solve(key[0].as_py(), pa.Table.from_batches(list(batches))))
        yield from out.select(names).to_batches()

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.groupBy("gene_id").applyInArrow(run, schema)


def node_cover(lower: DataFrame, i: int = 2) -> DataFrame:
    """(gene_id, node_id) of a generalised node cover, of nodes with their lowest neighbour (:func:`lower_neighbours`): nodes are taken in order; each adds one to
    the counters from its ``lo`` to itself, and is chosen, and takes its counts back, if a counter reaches ``i``."""

    def solve(gene: str, t: pa.Table) -> dict:
        t = t.sort_by("node_id")
        chosen, count = [], np.zeros(t.num_rows, np.int64)
        for node, lo in zip(t["node_id"].to_pylist(), t["lo"].to_pylist()):
            count[lo : node + 1] += 1
            if (count[lo : node + 1] == i).any():
                chosen.append(node)
                count[lo : node + 1] -= 1
        return {"gene_id": pa.array([gene] * len(chosen), pa.string()), "node_id": pa.array(chosen, pa.int32())}

    return _per_gene(lower.select("gene_id", "node_id", "lo"), "gene_id string, node_id int", solve)


def sample_split(matrix: DataFrame, percent: int = 95, seed: int = 2021) -> DataFrame:
    """(gene_id, sample_id, training): the samples of a gene, in order, permuted with the seed; the first ``percent`` train."""

    def solve(gene: str, t: pa.Table) -> dict:
        samples = sorted(set(t["sample_id"].to_pylist()))
        order = np.random.RandomState(seed).permutation(len(samples))
        training = np.zeros(len(samples), bool)
        training[order[: percent * len(samples) // 100]] = True
        return {"gene_id": pa.array([gene] * len(samples), pa.string()), "sample_id": pa.array(samples, pa.string()), "training": pa.array(training)}

    return _per_gene(matrix.select("gene_id", "sample_id").where(F.col("sample_id").isNotNull()).distinct(), "gene_id string, sample_id string, training boolean", solve)
