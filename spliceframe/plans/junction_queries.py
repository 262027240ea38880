"""Queries of the junction operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceframe.functions import alternates as alt
from spliceframe.functions import labels as lb
from spliceframe.operators import annotation as an
from spliceframe.operators import cliques as cl
from spliceframe.operators import export as ex
from spliceframe.operators import graph as gr
from spliceframe.operators import inference as inf
from spliceframe.operators import intervals as iv
from spliceframe.operators import mates as mt
from spliceframe.operators import reads as rd
from spliceframe.operators import results as rs
from spliceframe.session import staged
from spliceframe.sources import bridge
from spliceframe.sources.tables import table
from spliceframe.streaming import junction_stream as js

MIN_COV = 30
TILE = 500
PIVOT = 10_000


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return gr.gene_nodes(bridge.junctions(spark, folder), bridge.genes(spark, folder), MIN_COV)


def gene_min_k(spark: SparkSession, folder: str) -> DataFrame:
    """Junctions summed, floored and put into genes; the least number of transcripts each gene needs."""
    return gr.clique_numbers(_nodes(spark, folder))


def junction_totals(spark: SparkSession, folder: str) -> DataFrame:
    return gr.support(bridge.junctions(spark, folder), [])


def junction_sample_counts(spark: SparkSession, folder: str) -> DataFrame:
    return gr.support(bridge.junctions(spark, folder), ["sample_id"])


def junction_floor(spark: SparkSession, folder: str) -> DataFrame:
    return gr.floored(junction_totals(spark, folder), MIN_COV)


def gene_containment(spark: SparkSession, folder: str) -> DataFrame:
    distinct = bridge.junctions(spark, folder).select("chrom", "jx_start", "jx_end").distinct()
    return iv.containment_join(distinct, bridge.genes(spark, folder))


def node_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder)


def conflict_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = gr.conflict_edges(_nodes(spark, folder))
    return edges.select("gene_id", "u", "v", (F.floor(F.col("overlap_pct") * 10000 + 0.5) / 10000).alias("overlap_pct"))


def lower_neighbour(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _nodes(spark, folder)
    return gr.lower_neighbours(nodes, gr.conflict_edges(nodes))


def mis_greedy(spark: SparkSession, folder: str) -> DataFrame:
    return gr.independent_sets(_nodes(spark, folder)).groupBy("gene_id").agg(F.count(F.lit(1)).alias("independent_nodes"))


def document_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return gr.document_matrix(bridge.junctions(spark, folder), _nodes(spark, folder))


def document_row_sums(spark: SparkSession, folder: str) -> DataFrame:
    return document_matrix(spark, folder).groupBy("gene_id", "sample_id").agg(F.sum("count").alias("n_w"))


def top_mass_members(spark: SparkSession, folder: str) -> DataFrame:
    top = gr.top_mass(_nodes(spark, folder), ["gene_id"], "node_id", "score", 0.8)
    return top.select("gene_id", "node_id", "score")


def read_containment(spark: SparkSession, folder: str) -> DataFrame:
    reads = bridge.reads(spark, folder).groupBy("bam_file", "read").agg(F.min("chrom").alias("chrom"), F.max("chrom").alias("_other"), F.min("jx_start").alias("jx_start"), F.max("jx_end").alias("jx_end"))
    spans = reads.where(F.col("chrom") == F.col("_other")).drop("_other")
    return iv.containment_join(spans, bridge.genes(spark, folder)).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_reads"))


def sj_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rd.junction_reads(bridge.reads(spark, folder), ["bam_file", "chrom"])


def cooccurring_reads(spark: SparkSession, folder: str) -> DataFrame:
    return rd.read_chains(bridge.reads(spark, folder), ["bam_file", "chrom"]).where(F.col("n_junctions") >= 2).drop("j")


def path_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return rd.paths(rd.read_chains(bridge.reads(spark, folder), ["bam_file", "chrom"]), ["bam_file", "chrom"])


def _path_members(spark: SparkSession, folder: str) -> DataFrame:
    return gr.path_members(rd.read_chains(bridge.reads(spark, folder), ["bam_file", "chrom"]), bridge.genes(spark, folder), "bam_file")


def path_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Junctions and paths of the genes with the reads that show them in each file."""
    return _path_members(spark, folder).select("gene_id", "bam_file", "node", "kind", "count")


def path_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return gr.path_conflicts(staged(_path_members(spark, folder), "members"), "bam_file")


def cooc_prior(spark: SparkSession, folder: str) -> DataFrame:
    prior = gr.cooccurrence_prior(rd.read_chains(bridge.reads(spark, folder), ["bam_file", "chrom"]), ["bam_file", "chrom"])
    return prior.select("bam_file", "chrom", "v", "u", (F.floor(F.col("weight") * 10000 + 0.5) / 10000).alias("weight"))


def align_filter(spark: SparkSession, folder: str) -> DataFrame:
    return rd.primary(bridge.alignments(spark, folder)).select("qname", "flag", rd.with_chr(F.col("rname")).alias("rname"), "pos")


def align_mask(spark: SparkSession, folder: str) -> DataFrame:
    return rd.masked(bridge.alignments(spark, folder)).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def cigar_introns(spark: SparkSession, folder: str) -> DataFrame:
    return rd.read_introns(rd.primary(bridge.alignments(spark, folder)))


def cigar_introns_unfiltered(spark: SparkSession, folder: str) -> DataFrame:
    return rd.read_introns(rd.primary(bridge.alignments(spark, folder)), anchored=False)


def read_totals(spark: SparkSession, folder: str) -> DataFrame:
    return rd.totals(rd.primary(bridge.alignments(spark, folder)))


def read_ends(spark: SparkSession, folder: str) -> DataFrame:
    return rd.read_ends(rd.primary(bridge.alignments(spark, folder)))


def coverage_rle(spark: SparkSession, folder: str) -> DataFrame:
    return iv.depth_runs(rd.coverage_blocks(rd.primary(bridge.alignments(spark, folder))), ["chrom"], "start", "end", 1000)


def auc(spark: SparkSession, folder: str) -> DataFrame:
    return coverage_rle(spark, folder).groupBy("chrom").agg(F.sum(F.col("depth") * (F.col("end") - F.col("start"))).alias("auc"))


def tiled_windows(spark: SparkSession, folder: str) -> DataFrame:
    return iv.tiled(coverage_rle(spark, folder), ["chrom"], TILE)


def region_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Depth of the junctions of gene_junc over the genes."""
    rows = bridge.junctions(spark, folder)
    runs = iv.depth_runs(rows, ["chrom"], "jx_start", "jx_end")
    return iv.region_stats(runs, bridge.genes(spark, folder).where(F.col("g_start") < F.col("g_end")))


def merge_nearby(spark: SparkSession, folder: str) -> DataFrame:
    return iv.merged_nearby(bridge.genes(spark, folder), ["chrom"], "g_start", "g_end", 2200)


def exon_introns(spark: SparkSession, folder: str) -> DataFrame:
    return an.transcript_introns(bridge.exons(spark, folder))


def gene_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return an.gene_spans(bridge.exons(spark, folder))


def gtf_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes written as GTF text and parsed again."""
    text = F.concat(F.lit('gene_id "'), F.col("gene_id"), F.lit('"; transcript_id '), F.col("transcript_id"), F.lit('; gene_id "x"; gene_id "'), F.col("gene_id"), F.lit('";'))
    line = F.concat_ws("\t", "chrom", F.lit("t"), F.lit("exon"), "e_end", "e_start", F.lit("."), "strand", F.lit("."), text)
    f = an.features(bridge.exons(spark, folder).select(line.alias("value")))
    return f.groupBy(F.col("attributes")["gene_id"].alias("gene_id")).agg(F.count_distinct(F.col("attributes")["transcript_id"]).alias("transcripts"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


def strand_fix(spark: SparkSession, folder: str) -> DataFrame:
    rows = iv.containment_join(junction_totals(spark, folder), bridge.genes(spark, folder))
    return an.strands_fixed(rows, bridge.genes(spark, folder)).groupBy("gene_id", "strand", "status").agg(F.count(F.lit(1)).alias("n"))


def overlap_90pct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct junctions of reads of which a junction of gene_junc covers 90 % or more."""
    rows = bridge.reads(spark, folder).select("chrom", "jx_start", "jx_end").distinct()
    other = bridge.junctions(spark, folder).select("chrom", "jx_start", "jx_end").distinct()
    return iv.covered_by(rows, other, "chrom", "jx_start", "jx_end", 90, 10_000)


def tolerance_match(spark: SparkSession, folder: str) -> DataFrame:
    genes = bridge.genes(spark, folder)
    mine = iv.containment_join(bridge.reads(spark, folder).select("chrom", "jx_start", "jx_end").distinct(), genes)
    reference = iv.containment_join(bridge.junctions(spark, folder).select("chrom", "jx_start", "jx_end").distinct(), genes)
    return an.within_tolerance(mine, reference)


def reference_sets(spark: SparkSession, folder: str) -> DataFrame:
    sets = an.reference_sets(exon_introns(spark, folder))
    return sets.select("gene_id", "chrom", "jx_start", "jx_end", F.array_join("transcripts", ",").alias("transcripts"))


def safe_keys(spark: SparkSession, folder: str) -> DataFrame:
    return an.safe_keys(table(spark, folder, "gene_interval").where("gene_name IS NOT NULL"), "gene_name", "gene_id")


def sample_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the genes in every sample that the sample sheet names."""
    samples = [r[0] for r in table(spark, folder, "sample_sheet").select("sample_id").where("sample_id IS NOT NULL").distinct().orderBy("sample_id").limit(PIVOT + 1).collect()]
    if len(samples) > PIVOT:
        raise ValueError(f"more than {PIVOT} samples for a column each; junction_sample_counts gives the scores in rows")
    return ex.sample_matrix(bridge.junctions(spark, folder).where("gene NOT IN ('', '.')"), ["gene"], "sample_id", "score", samples)


def sample_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of junc_raw with the study and run of their sample, bucketed by the last two characters of both."""
    files = table(spark, folder, "junc_raw").groupBy("file_name").agg(F.count(F.lit(1)).alias("n_lines")).withColumn("sample_id", F.split("file_name", r"\.")[0])
    sheet = table(spark, folder, "sample_sheet").distinct()
    return files.join(sheet, "sample_id").select("file_name", "sample_id", "study", "run", "n_lines", F.concat(F.right("study", F.lit(2)), F.lit("/"), F.right("run", F.lit(2))).alias("bucket"))


def transcript_exons(spark: SparkSession, folder: str) -> DataFrame:
    """Exons of the chains that reads show."""
    chains = rd.read_chains(bridge.reads(spark, folder), ["bam_file", "chrom"]).select("bam_file", "chrom", "chain", "j").distinct()
    members = chains.select(F.concat_ws("|", "bam_file", "chrom", "chain").alias("transcript_id"), "chrom", F.explode("j").alias("x")).select("transcript_id", "chrom", "x.jx_start", "x.jx_end")
    return ex.transcript_exons(members)


def _inferred(spark: SparkSession, folder: str, by_sample: bool = False) -> DataFrame:
    nodes = staged(_nodes(spark, folder), "nodes")
    matrix = gr.document_matrix(bridge.junctions(spark, folder), nodes)
    return inf.inferred(matrix, nodes, gr.clique_numbers(nodes), by_sample=by_sample)


def infer_cavi(spark: SparkSession, folder: str) -> DataFrame:
    return _inferred(spark, folder)


def fragment_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return mt.fragment_lengths(bridge.mate_pairs(spark, folder))


def fragment_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = mt.fragment_summary(fragment_lengths(spark, folder))
    return s.select("count", (F.floor(F.col("mean") * 1000 + 0.5) / 1000).alias("mean"), "mode", "mode_count")


def pair_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage with the bases that both mates of a proper pair cover counted once."""
    return iv.depth_runs(mt.coverage_events(bridge.mate_pairs(spark, folder)), ["chrom"], "start", "end", 1000, F.col("weight"))


def pair_auc(spark: SparkSession, folder: str) -> DataFrame:
    return pair_coverage(spark, folder).groupBy("chrom").agg(F.sum(F.col("depth") * (F.col("end") - F.col("start"))).alias("auc"))


def read_alternates(spark: SparkSession, folder: str) -> DataFrame:
    p, c, s = F.col("pos"), F.col("cigar"), F.col("seq")
    every = F.concat(alt.md_mismatches(p, c, F.col("md"), s), alt.cigar_alternates(p, c, s, soft_clips=True))
    rows = bridge.altered(spark, folder).select("qname", F.explode(every).alias("x")).select("qname", F.col("x.pos").alias("pos0"), "x.op", "x.payload")
    return rows.groupBy("pos0", "op", "payload").agg(F.count(F.lit(1)).alias("n"))


def path_cliques(spark: SparkSession, folder: str) -> DataFrame:
    """Exact clique numbers of the conflict graphs of the junctions and paths that reads show."""
    chains = rd.read_chains(bridge.reads(spark, folder), ["bam_file", "chrom"])
    return cl.path_cliques(cl.path_nodes(chains, "bam_file"), "bam_file")


def cluster_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the genes' matrices and ln(samples) x (nodes + clusters) of the information criterion."""
    m = document_matrix(spark, folder).groupBy("gene_id").agg(F.count_distinct("sample_id").alias("samples"), F.sum("count").alias("reads"))
    j = m.join(gene_min_k(spark, folder), "gene_id")
    return j.select("gene_id", "samples", "reads", "nodes", "clique_number", (F.floor((F.col("nodes") + F.col("clique_number")) * F.log(F.col("samples").cast("double")) * 1000 + 0.5) / 1000).alias("penalty"))


def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly rows and scores by sample as a stream over gene_junc gives them, whole (complete mode)."""
    rows = js.stream_of(spark, f"{folder}/gene_junc.parquet").where("loaded_at IS NOT NULL")
    done = js.totals_of(js.windowed_counts(rows, ["sample_id"], "loaded_at", "1 hour", "30 days"))
    return done.select("sample_id", F.unix_seconds("window_start").alias("window_start"), "n_rows", "score")


def paired_chains(spark: SparkSession, folder: str) -> DataFrame:
    return mt.paired_chains(bridge.mate_pairs(spark, folder))


def reference_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Junctions of a file's reads that no read chain of two or more holds together, though each is in one."""
    chains = rd.read_chains(bridge.reads(spark, folder), ["bam_file", "chrom"]).where(F.col("n_junctions") >= 2)
    members = chains.select(F.concat_ws(":", "bam_file", "chrom").alias("file"), F.col("chain").alias("transcript"), "j").distinct()
    return gr.reference_edges(members.select("file", "transcript", F.explode("j").alias("x")).select("file", "transcript", F.concat_ws("-", "x.jx_start", "x.jx_end").alias("node")), "file")


def cluster_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return gr.cluster_numbers(gene_min_k(spark, folder))


def node_cover(spark: SparkSession, folder: str) -> DataFrame:
    return gr.node_cover(lower_neighbour(spark, folder))


def sample_split(spark: SparkSession, folder: str) -> DataFrame:
    return gr.sample_split(document_matrix(spark, folder))


def expected_counts(spark: SparkSession, folder: str) -> DataFrame:
    return inf.sample_counts(_inferred(spark, folder, by_sample=True))


def cluster_merge(spark: SparkSession, folder: str) -> DataFrame:
    return inf.merged_clusters(infer_cavi(spark, folder))


def unconflicted_exons(spark: SparkSession, folder: str) -> DataFrame:
    """Exons of the one transcript of every gene whose junctions don't conflict."""
    nodes = staged(_nodes(spark, folder), "nodes")
    return ex.transcript_exons(rs.unconflicted_members(nodes, gr.clique_numbers(nodes)))


def inferred_exons(spark: SparkSession, folder: str) -> DataFrame:
    """Exons of the transcripts of the fitted genes, as GTF lines."""
    nodes = staged(_nodes(spark, folder), "nodes")
    result = inf.inferred(gr.document_matrix(bridge.junctions(spark, folder), nodes), nodes, gr.clique_numbers(nodes))
    return ex.gtf_lines(ex.transcript_exons(rs.transcript_members(result, nodes)))


def node_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the distinct junctions, written and parsed again."""
    rows = bridge.junctions(spark, folder).select("chrom", "jx_start", "jx_end").distinct()
    label = lb.node_label(F.col("chrom"), F.col("jx_start"), F.col("jx_end"))
    return rows.select(label.alias("label"), lb.parsed_label(label).alias("x")).select("label", "x.chrom", "x.jx_start", "x.jx_end")


def zero_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles of 1 Mb of every chromosome of the genes under the junctions of reads, with zeros."""
    contigs = bridge.genes(spark, folder).groupBy(F.col("chrom").alias("name")).agg(F.max("g_end").alias("length"))
    runs = iv.depth_runs(bridge.reads(spark, folder), ["chrom"], "jx_start", "jx_end")
    tiles = rs.with_zero_tiles(iv.tiled(runs, ["chrom"], 1_000_000), contigs, 1_000_000)
    return tiles.select("chrom", "tile", "bases", (F.floor(F.col("mean") * 1000 + 0.5) / 1000).alias("mean"))


def listed_genes(spark: SparkSession, folder: str) -> DataFrame:
    """Junction rows of the genes that gene_interval names, by gene."""
    names = table(spark, folder, "gene_interval").select(F.upper("gene_name"))
    rows = rs.restricted(bridge.junctions(spark, folder), names, "gene")
    return rows.groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


def signal_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of junctions as a signal (a quarter each, so not whole) over the genes."""
    signal = bridge.junctions(spark, folder).select("chrom", F.col("jx_start").alias("start"), F.col("jx_end").alias("end"), (F.col("score") / 4).alias("value"))
    return iv.signal_stats(signal, bridge.genes(spark, folder))


def auc_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Bases under coverage by chromosome: all, of uniquely placed reads, and inside the genes of the exons."""
    reads = rd.primary(bridge.alignments(spark, folder))
    count = lambda df, c: rd.coverage_blocks(df).groupBy("chrom").agg(F.sum((F.col("end") - F.col("start")).cast("long")).alias(c))
    regions = an.gene_spans(bridge.exons(spark, folder)).select("chrom", F.col("g_start").alias("start"), F.col("g_end").alias("end"))
    annotated = iv.shared_bases(rd.coverage_blocks(reads), regions).withColumnRenamed("bases", "annotated_auc")
    out = count(reads, "auc").join(count(reads.where(F.col("mapq") >= rd.UNIQUE_QUALITY), "unique_auc"), "chrom", "left").join(annotated, "chrom", "left")
    return out.na.fill(0, ["unique_auc", "annotated_auc"])


def short_fragments(spark: SparkSession, folder: str) -> DataFrame:
    s = mt.short_fragments(fragment_lengths(spark, folder))
    return s.select("count", (F.floor(F.col("mean") * 1000 + 0.5) / 1000).alias("mean"))


def chain_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Of the junctions of every chain that a read shows, the share that the best sample of gene_junc has within 12 bases."""
    chains = rd.read_chains(bridge.reads(spark, folder), ["bam_file", "chrom"]).where(F.col("n_junctions") >= 2)
    configs = chains.select(F.concat_ws("|", "bam_file", "chrom", "chain").alias("config"), "chrom", "j").distinct().select("config", "chrom", F.explode("j").alias("x")).select("config", "chrom", "x.jx_start", "x.jx_end")
    reference = bridge.junctions(spark, folder).where("sample_id IS NOT NULL").select(F.col("sample_id").alias("transcript_id"), "chrom", "jx_start", "jx_end").distinct()
    return an.tolerance_scores(configs, reference).select("config", (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))


def cluster_criteria(spark: SparkSession, folder: str) -> DataFrame:
    """Both information criteria of every gene's matrix under the shares of its nodes in all reads."""
    m = document_matrix(spark, folder)
    by_node = m.groupBy("gene_id", "node_id").agg(F.sum("count").alias("c"))
    total = m.groupBy("gene_id").agg(F.sum("count").alias("reads"), F.count_distinct("sample_id").alias("samples"))
    fit = by_node.join(total, "gene_id").groupBy("gene_id", "reads", "samples").agg(F.sum(F.col("c") * F.log(F.col("c") / F.col("reads"))).alias("loglik"))
    plain, extended = rs.information_criteria(F.col("samples"), F.col("nodes"), F.col("clique_number"), F.col("loglik"), F.col("reads"))
    rounded = lambda c: F.floor(c * 100 + 0.5) / 100
    return fit.join(gene_min_k(spark, folder), "gene_id").select("gene_id", rounded(plain).alias("criterion"), rounded(extended).alias("extended"))


def gtf_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """The one transcript of every gene whose junctions don't conflict, as GTF lines."""
    nodes = staged(_nodes(spark, folder), "nodes")
    members = rs.unconflicted_members(nodes, gr.clique_numbers(nodes))
    owners = nodes.select(F.concat_ws("_", "gene_id", F.lit("C0")).alias("transcript_id"), "gene_id", "strand")
    return ex.gtf_transcripts(ex.transcript_exons(members), owners)


def _even_shares(spark: SparkSession, folder: str) -> DataFrame:
    """A result by sample of an even share of every gene's clusters; the members of cluster k are the nodes of the same parity."""
    m = document_matrix(spark, folder).where("sample_id IS NOT NULL").join(gene_min_k(spark, folder).where("clique_number >= 2"), "gene_id")
    k = F.explode(F.sequence(F.lit(0), F.col("clique_number").cast("int") - 1)).alias("k")
    rows = m.select("gene_id", "sample_id", "node_id", "clique_number", "count", k)
    return rows.select("gene_id", "sample_id", "k", "node_id", (F.col("node_id") % 2 == F.col("k") % 2).alias("member"), (F.col("count") / F.col("clique_number")).alias("expected_count"))


def sample_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Expected reads of every cluster and sample, at members and at all nodes, under even shares."""
    s = inf.sample_counts(_even_shares(spark, folder))
    return s.select("gene_id", "k", "sample_id", *((F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c) for c in ("member_count", "all_count")))


def merged_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters with the same members as one, under even shares."""
    by_node = _even_shares(spark, folder).groupBy("gene_id", "k", "node_id", "member").agg(F.sum("expected_count").alias("expected_count"))
    m = inf.merged_clusters(by_node)
    return m.select("gene_id", F.array_join("members", ",").alias("members"), "clusters", (F.floor(F.col("expected_count") * 1000 + 0.5) / 1000).alias("expected_count"))


def queries() -> dict:
    own = (signal_stats, auc_kinds, short_fragments, chain_scores, cluster_criteria, gtf_transcripts, sample_sums, merged_sets, unconflicted_exons, inferred_exons, node_labels, zero_tiles, listed_genes, paired_chains, reference_edges, cluster_numbers, node_cover, sample_split, expected_counts, cluster_merge, fragment_lengths, fragment_summary, pair_coverage, pair_auc, read_alternates, path_cliques, cluster_scores, stream_hourly, gene_min_k, junction_totals, junction_sample_counts, junction_floor, gene_containment, node_ids, conflict_edges, lower_neighbour, mis_greedy, document_matrix, document_row_sums, top_mass_members, read_containment, sj_counts, cooccurring_reads, path_nodes, path_matrix, path_conflicts, cooc_prior, align_filter, align_mask, cigar_introns, cigar_introns_unfiltered, read_totals, read_ends, coverage_rle, auc, tiled_windows, region_stats, merge_nearby, exon_introns, gene_intervals, gtf_attributes, strand_fix, overlap_90pct, tolerance_match, reference_sets, safe_keys, sample_matrix, sample_manifest, transcript_exons, infer_cavi)
    return {f.__name__: f for f in own}
