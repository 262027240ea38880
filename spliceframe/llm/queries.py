"""Queries over the given tables for training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceframe.llm import cooccurrence, leakage, normalize, packing, percentiles
from spliceframe.operators.keyed_totals import gene_key
from spliceframe.sources.tables import table

CONTAINER_TOKENS = 2048
P_FOUND = {"p25": 2500, "p50": 5000, "p75": 7500, "p99": 9900}


def _fpkm(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "transcript_result").select(gene_key("gene").alias("gene"), "sample_id", "fpkm", "run_at")
    return rows.where(F.col("gene").isNotNull() & F.col("sample_id").isNotNull() & percentiles.usable(F.col("fpkm")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    q = percentiles.quantiles(_fpkm(spark, folder), ["gene", "sample_id"], "fpkm", P_FOUND)
    return q.where((F.col("p99") >= 40 * F.col("p50")) | (F.col("p75") >= 20 * F.col("p25"))).select("gene", "sample_id")


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.quantiles(_fpkm(spark, folder), ["gene", "sample_id"], "fpkm", P_FOUND | {"p90": 9000})


def p2_combined_days(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles from summaries of the days of run_at (UTC), combined; rank error below n / 400 and n / 1,600 for every 64-fold number of days."""
    rows = _fpkm(spark, folder).withColumn("day", F.to_date("run_at"))
    days = percentiles.summaries(rows, ["gene", "sample_id", "day"], "fpkm")
    return percentiles.merged(days, ["gene", "sample_id"], P_FOUND)


def p2_day_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the percentiles of the combined days are within a rank error of n / 200, told by counting all values again."""
    combined = p2_combined_days(spark, folder).withColumn("of", F.array(*(F.struct(F.lit(p).alias("p"), F.col(c).alias("value")) for c, p in P_FOUND.items())))
    combined = combined.select(F.col("gene").alias("_g"), F.col("sample_id").alias("_s"), "n", "of")
    rows = _fpkm(spark, folder).join(combined, (F.col("gene") == F.col("_g")) & (F.col("sample_id") == F.col("_s")))
    counts = [F.count_if(F.col("fpkm") < F.col("of")[i]["value"]).alias(f"below{i}") for i in range(len(P_FOUND))] + [F.count_if(F.col("fpkm") <= F.col("of")[i]["value"]).alias(f"upto{i}") for i in range(len(P_FOUND))]
    told = rows.groupBy("gene", "sample_id", "n").agg(F.count(F.lit(1)).alias("rows"), *counts)
    within = F.col("rows") == F.col("n")
    for i, p in enumerate(P_FOUND.values()):
        k = percentiles.rank_of(F.col("n"), p)
        within &= (F.col(f"below{i}") * 200 < k * 200 + F.col("n")) & (k * 200 <= F.col(f"upto{i}") * 200 + F.col("n"))
    return told.select("gene", "sample_id", "n", within.alias("within"))


def _pairs(spark: SparkSession, folder: str, least: int) -> DataFrame:
    rows = table(spark, folder, "all_jxs").where(F.col("jx_start").isNotNull() & F.col("jx_end").isNotNull())
    item = cooccurrence.packed(F.least("jx_start", "jx_end"), F.greatest("jx_start", "jx_end"))
    rows = rows.select("bam_file", F.regexp_replace("read_name", r"/[12]\z", "").alias("read"), item.alias("junction"))
    pairs = cooccurrence.together(rows, "bam_file", "read", "junction", least)
    (a_start, a_end), (b_start, b_end) = cooccurrence.unpacked(F.col("a")), cooccurrence.unpacked(F.col("b"))
    return pairs.select("*", a_start.alias("a_start"), a_end.alias("a_end"), b_start.alias("b_start"), b_end.alias("b_end"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrence.lift_at_least(_pairs(spark, folder, 20), 4).select("bam_file", "a_start", "a_end", "b_start", "b_end")


def _scored_pairs(spark: SparkSession, folder: str, least: int) -> DataFrame:
    pairs = cooccurrence.scored(_pairs(spark, folder, least))
    return pairs.select("bam_file", "a_start", "a_end", "b_start", "b_end", "n_ab", "n_a", "n_b", "n", *((F.floor(F.col(c) * 10000 + 0.5) / 10000).alias(c) for c in ("lift", "conviction")))


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair held together by two reads or more, with lift and conviction."""
    return _scored_pairs(spark, folder, 2)


def p5_all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair that a read holds together, with lift and conviction."""
    return _scored_pairs(spark, folder, 1)


def _packing(spark: SparkSession, folder: str) -> packing.Packing:
    """``spark.spliceframe.tokenizer`` names the vocabulary file, at one path on all machines, where it isn't the usual one."""
    tokenizer = spark.conf.get("spark.spliceframe.tokenizer", packing.TOKENIZER)
    return packing.pack(packing.token_sizes(table(spark, folder, "documents"), tokenizer=tokenizer), CONTAINER_TOKENS)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packing(spark, folder).rows.where((F.col("parts") > 1) & (F.col("part_no") == 0)).select("doc_id")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packing(spark, folder).rows.select("doc_id", "part_no", F.col("size").alias("n_tokens"), "container_id")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by how full they are (in tenths), with the certified lower bound of their number."""
    done = _packing(spark, folder)
    fill = done.rows.groupBy("container_id").agg(F.sum("size").alias("n_tokens"), F.count(F.lit(1)).alias("pieces"))
    tenth = F.ceil(F.col("n_tokens") * 10 / CONTAINER_TOKENS).cast("int")
    by = fill.groupBy(tenth.alias("tenths_full")).agg(F.count(F.lit(1)).alias("containers"), F.sum("n_tokens").alias("n_tokens"), F.sum("pieces").alias("pieces"))
    return by.select("*", F.lit(done.containers).alias("all_containers"), F.lit(done.bound).alias("lower_bound"))


def p6_certificates(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and certified bound of every partition of every round."""
    return _packing(spark, folder).certificates


def p6_audit(spark: SparkSession, folder: str) -> DataFrame:
    """One row: documents packed, and how many break a rule: lost or cut anew (their pieces don't sum to their text), split below the limit, in two places;
    containers above the capacity; whether the containers are within a hundredth of the bound."""
    done = _packing(spark, folder)
    texts = table(spark, folder, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    by_doc = done.rows.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("part_no").alias("numbers"), F.max("parts").alias("parts"))
    j = texts.join(by_doc, "doc_id", "full")
    lost = F.col("size").isNull() | F.col("n_bytes").isNull() | (F.col("size") > F.col("n_bytes")) | ((F.col("size") == 0) & (F.col("n_bytes") > 0)) | (F.col("pieces") != F.col("parts")) | (F.col("numbers") != F.col("parts"))
    cut = (F.col("pieces") > 1) & (F.col("size") <= CONTAINER_TOKENS)
    docs = j.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(lost).alias("lost"), F.count_if(cut).alias("cut_below_limit"))
    full = done.rows.groupBy("container_id").agg(F.sum("size").alias("n")).agg(F.count_if(F.col("n") > CONTAINER_TOKENS).alias("above_capacity"))
    within = done.containers * 100 <= done.bound * 101 + 100
    return docs.select("*", F.lit(full.first()[0]).alias("above_capacity"), F.lit(within).alias("within_a_hundredth"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The spans of words of a post that it shares with an item."""
    return leakage.leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_places(spark: SparkSession, folder: str) -> DataFrame:
    """The spans with their place in the text in characters, for cutting them out."""
    return leakage.leaked_places(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.same_looking_pairs(table(spark, folder, "documents"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every post, with and without case."""
    return normalize.normalized(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "form", "folded")


def queries() -> dict:
    own = (p2_found, p2_percentiles, p2_combined_days, p2_day_errors, p5_found, p5_pairs, p5_all_pairs, p6_found, p6_containers, p6_fill, p6_certificates, p6_audit, p7_found, p7_spans, p7_places, p8_found, p8_forms)
    return {f.__name__: f for f in own}
