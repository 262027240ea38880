"""Junctions, genes, reads, alignments and exons as the operators take them, from the given tables.

The SQL of a view runs both in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spliceframe.sources.tables import table

#: (gene, sample_id, chrom, jx_start, jx_end, strand, score) of the rows with coordinates; reversed ones swapped, ``chr`` prefix dropped
JUNCTIONS = """SELECT upper(trim(gene_name)) AS gene, sample_id, CASE WHEN chrom LIKE 'chr%' THEN substr(chrom, 4) ELSE chrom END AS chrom,
  least(chrom_start, chrom_end) AS jx_start, greatest(chrom_start, chrom_end) AS jx_end, strand, score
  FROM gene_junc WHERE chrom IS NOT NULL AND chrom_start IS NOT NULL AND chrom_end IS NOT NULL"""

#: one row per gene_id: (gene_id, chrom, g_start, g_end, strand); of repeated rows the one that is greatest by all columns
GENES = """SELECT gene_id, chrom, g_start, g_end, strand FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY chrom DESC, g_start DESC, g_end DESC, strand DESC) AS k
  FROM (SELECT gene_id, CASE WHEN chrom LIKE 'chr%' THEN substr(chrom, 4) ELSE chrom END AS chrom, least(g_start, g_end) AS g_start, greatest(g_start, g_end) AS g_end, strand
  FROM gene_interval WHERE gene_id IS NOT NULL AND chrom IS NOT NULL AND g_start IS NOT NULL AND g_end IS NOT NULL) AS x) AS y WHERE k = 1"""

#: (bam_file, read, chrom, jx_start, jx_end, is_unique): rows of reads as delivered, repeated ones included
READS = """SELECT bam_file, CASE WHEN read_name LIKE '%/1' OR read_name LIKE '%/2' THEN substr(read_name, 1, length(read_name) - 2) ELSE read_name END AS read,
  CASE WHEN chrom LIKE 'chr%' THEN substr(chrom, 4) ELSE chrom END AS chrom, least(jx_start, jx_end) AS jx_start, greatest(jx_start, jx_end) AS jx_end, is_unique
  FROM all_jxs WHERE read_name IS NOT NULL AND chrom IS NOT NULL AND jx_start IS NOT NULL AND jx_end IS NOT NULL"""

#: (qname, flag, rname, pos, mapq, cigar) made from the events
ALIGN = """SELECT 'r' || CAST(event_id AS VARCHAR(20)) AS qname,
  CAST(CASE WHEN event_id % 17 = 0 THEN 4 WHEN event_id % 13 = 0 THEN 256 WHEN event_id % 11 = 0 THEN 2048 WHEN event_id % 2 = 0 THEN 16 ELSE 0 END AS INT) AS flag,
  CASE WHEN user_id % 3 = 0 THEN 'A' WHEN user_id % 3 = 1 THEN 'N' ELSE 'R' END AS rname,
  CAST(1 + (user_id % 100) * 20 AS INT) AS pos, CAST(event_id % 30 AS INT) AS mapq,
  CAST(4 + event_id % 12 AS VARCHAR(20)) || 'M' || CAST(40 + (event_id % 5) * 20 AS VARCHAR(20)) || 'N' || CAST(10 + event_id % 7 AS VARCHAR(20)) || 'M' ||
  CASE WHEN event_id % 3 = 0 THEN '2D' WHEN event_id % 3 = 1 THEN '1I' ELSE '' END || CAST(6 + event_id % 4 AS VARCHAR(20)) || 'M' ||
  CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(60 + (user_id % 4) * 30 AS VARCHAR(20)) || 'N9M' END AS cigar FROM events"""

#: (gene_id, transcript_id, chrom, e_start, e_end, strand) made from the order lines
EXONS = """SELECT 'G' || CAST(l_suppkey % 20 AS VARCHAR(20)) AS gene_id, 'T' || CAST(l_orderkey AS VARCHAR(20)) AS transcript_id, 'A' AS chrom,
  CAST(l_linenumber * 1000 + l_partkey % 50 AS INT) AS e_start, CAST(l_linenumber * 1000 + l_partkey % 50 + CAST(l_quantity AS INT) * 25 AS INT) AS e_end, '+' AS strand
  FROM lineitem"""

#: (qname, flag, rname, pos, tlen, cigar): two mates per event; some not proper, some on one strand, some spliced
PAIRS = """SELECT 'p' || CAST(event_id AS VARCHAR(20)) AS qname, CAST(1 + CASE WHEN event_id % 7 = 0 THEN 0 ELSE 2 END + CASE WHEN m = 0 THEN 64 ELSE 128 END + CASE WHEN m = 1 AND event_id % 11 <> 0 THEN 16 ELSE 0 END AS INT) AS flag,
  CASE WHEN user_id % 3 = 0 THEN 'A' WHEN user_id % 3 = 1 THEN 'N' ELSE 'R' END AS rname, CAST(1 + (user_id % 100) * 20 + m * (event_id % 40) AS INT) AS pos,
  CAST((1 - 2 * m) * (event_id % 40 + 25 + event_id % 9 + CASE WHEN event_id % 4 = 0 THEN 30 ELSE 0 END) AS INT) AS tlen,
  CASE WHEN m = 0 AND event_id % 12 = 0 THEN '10M20N' || CAST(10 + event_id % 30 AS VARCHAR(20)) || 'M' WHEN m = 0 THEN CAST(20 + event_id % 30 AS VARCHAR(20)) || 'M' WHEN event_id % 4 = 0 THEN '15M30N' || CAST(10 + event_id % 9 AS VARCHAR(20)) || 'M' ELSE CAST(25 + event_id % 9 AS VARCHAR(20)) || 'M' END AS cigar
  FROM (SELECT event_id, user_id, 0 AS m FROM events UNION ALL SELECT event_id, user_id, 1 FROM events) AS e"""

#: (qname, rname, pos, cigar, md, seq): one mismatch, insertion, deletion and soft clip per read
ALTERED = """SELECT 'a' || CAST(event_id AS VARCHAR(20)) AS qname, 'A' AS rname, CAST(1 + user_id % 1000 AS INT) AS pos,
  CAST(10 + event_id % 5 AS VARCHAR(20)) || 'M2I' || CAST(12 + event_id % 7 AS VARCHAR(20)) || 'M3D' || CAST(8 + event_id % 4 AS VARCHAR(20)) || 'M4S' AS cigar,
  CAST(event_id % 15 AS VARCHAR(20)) || 'A' || CAST(21 + event_id % 5 + event_id % 7 - event_id % 15 AS VARCHAR(20)) || '^GGG' || CAST(8 + event_id % 4 AS VARCHAR(20)) AS md,
  substr('ACGTTGCAACNGTACCATGACGTTGCAACGGTACCATGACGTTGCAACTTTTGGGG', 1, CAST(36 + event_id % 5 + event_id % 7 + event_id % 4 AS INT)) AS seq FROM events"""


def _view(spark: SparkSession, folder: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, folder, name))


def junctions(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, JUNCTIONS, "gene_junc")


def genes(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, GENES, "gene_interval")


def reads(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, READS, "all_jxs")


def alignments(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, ALIGN, "events")


def exons(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, EXONS, "lineitem")


def mate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, PAIRS, "events")


def altered(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, ALTERED, "events")
