"""Queries over the given tables: operators for general problems (numbered) and for junction data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceframe.operators.compaction import compact, duplicated
from spliceframe.operators.keyed_totals import frequent_keys, gene_key, keyed_totals
from spliceframe.operators.parse_errors import split_valid
from spliceframe.plans import junction_queries
from spliceframe.session import new_path, staged
from spliceframe.sources.small_files import read_small_files, write_small_files
from spliceframe.sources.tables import table

#: Bytes of rows as text per compacted file; Parquet takes about a quarter.
COMPACT_BYTES = 64 << 20


def junction_totals_by_gene(spark: SparkSession, folder: str) -> DataFrame:
    return keyed_totals(table(spark, folder, "gene_junc"), gene_key("gene_name"), {"sum_score": F.col("score")})


def fpkm_totals_by_gene(spark: SparkSession, folder: str) -> DataFrame:
    """fpkm counts where it is finite and above 0."""
    fpkm = F.col("fpkm")
    valid = F.when((fpkm > 0) & (fpkm < float("inf")) & ~F.isnan(fpkm), fpkm)
    return keyed_totals(table(spark, folder, "transcript_result"), gene_key("gene"), {"sum_fpkm": valid})


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name, key in (("gene_junc", "gene_name"), ("transcript_result", "gene")):
        totals = staged(keyed_totals(table(spark, folder, name), gene_key(key), {}), "totals")
        part = frequent_keys(totals, 20).select(F.lit(name).alias("table_name"), F.col("key").alias("gene"))
        out = part if out is None else out.unionByName(part)
    return out


def p1_gene_junc_totals(spark: SparkSession, folder: str) -> DataFrame:
    return junction_totals_by_gene(spark, folder).select(F.col("key").alias("gene"), "n_rows", "sum_score")


def p1_transcript_totals(spark: SparkSession, folder: str) -> DataFrame:
    return fpkm_totals_by_gene(spark, folder).select(F.col("key").alias("gene"), "n_rows", F.col("n_sum_fpkm").alias("n_fpkm"), F.round("sum_fpkm", 3).alias("sum_fpkm"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    broken = split_valid(table(spark, folder, "junc_raw"), keep=["raw_id"])[1]
    return broken.select("raw_id", F.col("parse_reason").alias("reason"))


def p3_valid_rows(spark: SparkSession, folder: str) -> DataFrame:
    valid = split_valid(table(spark, folder, "junc_raw"), keep=["raw_id", "file_name", "line_no"])[0]
    return valid.select("raw_id", "file_name", "line_no", "chrom", "chrom_start", "chrom_end", "score", "strand")


def _compacted(spark: SparkSession, folder: str) -> DataFrame:
    done = compact(table(spark, folder, "junc_parts"), new_path(spark, "compacted"), ["sample_id", "rec_no"], "written_at", COMPACT_BYTES)
    return spark.read.parquet(done.path)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return duplicated(_compacted(spark, folder)).select("sample_id", "rec_no")


def p4_compacted(spark: SparkSession, folder: str) -> DataFrame:
    return _compacted(spark, folder).select("sample_id", "rec_no", "chrom", "chrom_start", "chrom_end", "score", "strand", "n_copies")


#: the columns of a tiny file of the store, with their types in it (times as microseconds)
PARTS = {"sample_id": "string", "rec_no": "long", "chrom": "string", "chrom_start": "int", "chrom_end": "int", "score": "int", "strand": "string", "written_at": "long"}


def tiny_store(parts: DataFrame, path: str) -> DataFrame:
    """Writes ``parts`` as a store of tiny text files, one for each file_name, and gives the store as it is read from them (null for an empty field)."""
    micros = {"written_at": F.unix_micros("written_at")}
    text = F.concat_ws("\t", *(F.coalesce(micros.get(c, F.col(c)).cast("string"), F.lit("")) for c in PARTS))
    write_small_files(parts.select("file_name", text.alias("value")), path)
    field = F.split("value", "\t")
    fields = [F.when(field[i] != "", field[i]).cast(t).alias(c) for i, (c, t) in enumerate(PARTS.items())]
    return read_small_files(parts.sparkSession, path).select("file_name", *fields).withColumn("written_at", F.timestamp_micros("written_at"))


def p4_tiny_files(spark: SparkSession, folder: str) -> DataFrame:
    """The store written out as one small text file for each file_name, read from these files and consolidated."""
    store = staged(tiny_store(table(spark, folder, "junc_parts"), new_path(spark, "tiny")), "store")  # each file is opened once
    done = compact(store, new_path(spark, "compacted"), ["sample_id", "rec_no"], "written_at", COMPACT_BYTES)
    return spark.read.parquet(done.path).select("sample_id", "rec_no", "chrom", "chrom_start", "chrom_end", "score", "strand", "n_copies")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_gene_junc_totals, p1_transcript_totals, p3_found, p3_valid_rows, p4_found, p4_compacted, p4_tiny_files)} | junction_queries.queries()
