import math

import pytest
from pyspark.sql import functions as F

from spliceframe.operators import keyed_totals as kt


def _rows(spark):
    rows = [(" a", 1, 1.5, 9), ("A ", None, None, 9), ("b", 5, float("nan"), 9), ("", 1, 1.0, 9), (".", 1, 1.0, 9), (None, 1, 1.0, 9), ("c", None, None, 9)]
    return spark.createDataFrame(rows * 3, "gene string, v int, x double, n long")


@pytest.mark.parametrize("max_keys", [100, 0])
def test_totals(spark, max_keys):
    got = {r["key"]: r for r in kt.keyed_totals(_rows(spark).repartition(3), kt.gene_key("gene"), {"v": F.col("v"), "x": F.col("x")}, max_keys).collect()}
    assert set(got) == {"A", "B", "C"}
    assert (got["A"]["n_rows"], got["A"]["v"], got["A"]["n_v"], got["A"]["x"]) == (6, 3, 3, 4.5)
    assert got["B"]["v"] == 15 and math.isnan(got["B"]["x"])
    assert got["C"]["v"] is None and got["C"]["x"] is None and got["C"]["n_rows"] == 3


@pytest.mark.parametrize("max_keys", [100, 0])
def test_empty(spark, max_keys):
    assert kt.keyed_totals(_rows(spark).limit(0), kt.gene_key("gene"), {"v": F.col("v")}, max_keys).collect() == []


def test_many_splits_and_blocks_equal_groupby(spark):
    df = spark.range(0, 30_000, numPartitions=70).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 2500)).alias("k"), (F.col("id") * 7919).alias("v"))
    want = {r["k"]: (r["n"], r["s"]) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    got = {r["key"]: (r["n_rows"], r["v"]) for r in kt.keyed_totals(df, F.col("k"), {"v": F.col("v")}).collect()}
    assert got == want


def test_small_dictionaries_give_the_same(spark):
    df = spark.range(0, 5000, numPartitions=3).select(F.concat(F.lit("ключ"), F.col("id") % 333).alias("k"), (F.col("id") / 2).alias("v"))
    want = {r["k"]: (r["n"], r["s"]) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    got = [(r["key"], (r["n_rows"], r["v"])) for r in kt.keyed_totals(df, F.col("k"), {"v": F.col("v")}, max_keys=10).collect()]
    assert len(got) == 333 and dict(got) == want


def test_a_split_with_many_keys(spark):
    df = spark.range(0, 9000, numPartitions=1).select((F.col("id") % 4000).cast("string").alias("k"))
    got = {r["key"]: r["n_rows"] for r in kt.keyed_totals(df, F.col("k"), {}).collect()}
    assert len(got) == 4000 and sum(got.values()) == 9000 and set(got.values()) == {2, 3}


def test_frequent(spark):
    totals = spark.createDataFrame([("a", 98), ("b", 2), ("c", 1)], "key string, n_rows long")
    assert {r["key"] for r in kt.frequent_keys(totals.where("key <> 'c'"), 20).collect()} == {"a", "b"}
    assert {r["key"] for r in kt.frequent_keys(totals, 20).collect()} == {"a"}
