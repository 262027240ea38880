import math
import random

import pytest
from pyspark.sql import functions as F

from spliceframe.llm import percentiles as pc

WANTED = {"lowest": 1, "p25": 2500, "p50": 5000, "p99": 9900, "top": 10000}


def _truth(rows, wanted):
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    return {g: (len(v), *(sorted(v)[max(1, -(-len(v) * p // 10000)) - 1] for p in wanted.values())) for g, v in groups.items()}


@pytest.mark.parametrize("run", [8, 64, 4096])
def test_equals_sorting(spark, monkeypatch, run):
    monkeypatch.setattr(pc, "RUN", run)
    r = random.Random(run)
    rows = [("hot", r.choice([r.lognormvariate(0, 3), 7.0, float("inf"), float("-inf")])) for _ in range(1500)] + [(f"g{r.randrange(40)}", round(r.random(), 2)) for _ in range(900)]
    rows += [("same", 3.0)] * 500 + [(None, r.random()) for _ in range(300)] + [("none", None), ("none", float("nan")), ("one", 1.0), ("hot", float("nan"))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x["g"]: tuple(x[1:]) for x in pc.quantiles(df, ["g"], "v", WANTED).collect()}
    assert got == _truth(rows, WANTED)


def test_many_blocks_lanes_and_visits(spark, monkeypatch):
    for name, value in (("ASKS", 20), ("BROADCAST_BYTES", 4000), ("LANE", 1), ("LEAST", 1), ("RUN", 100)):
        monkeypatch.setattr(pc, name, value)
    r = random.Random(3)
    rows = [(f"g{r.randrange(60)}" if r.random() < 0.6 else "hot", round(r.gauss(0, 1), 2)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {x["g"]: tuple(x[1:]) for x in pc.quantiles(df, ["g"], "v", WANTED).collect()}
    assert got == _truth(rows, WANTED)


def test_rounds_for_every_group(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/transcript_result.parquet").where(pc.usable(F.col("fpkm")))
    found = pc.quantiles(rows, ["gene", "sample_id"], "fpkm", {"p50": 5000, "p99": 9900}, keep="rounds")
    low, high, n = found.agg(F.min("rounds"), F.max("rounds"), F.count("rounds")).first()
    assert low >= 1 and high > 1 and n == rows.select("gene", "sample_id").distinct().count()


def test_null_keys_and_their_places_are_told_apart(spark):
    df = spark.createDataFrame([(None, "a", 1.0), ("a", None, 2.0), (None, None, 3.0)], "x string, y string, v double")
    assert {tuple(r) for r in pc.quantiles(df, ["x", "y"], "v", {"p50": 5000}).collect()} == {(None, "a", 1, 1.0), ("a", None, 1, 2.0), (None, None, 1, 3.0)}


def test_summaries_merge_again(spark, monkeypatch):
    monkeypatch.setattr(pc, "FAN", 3)
    r = random.Random(8)
    rows = [("a" if r.random() < 0.9 else None, r.randrange(20), r.expovariate(1)) for _ in range(9000)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(4)
    days = pc.summaries(df, ["g", "day"], "v", steps=100)
    halves = [pc.merged_summaries(days.where(F.col("day") % 2 == i), ["g"], steps=100) for i in (0, 1)]
    whole = pc.merged_summaries(halves[0].unionByName(halves[1]), ["g"], steps=100)
    got = pc.read_quantiles(whole, WANTED).collect()
    assert {x["g"] for x in got} == {"a", None} and max(len(x["points"]) for x in whole.collect()) <= 400
    for x in got:
        v = sorted(y for g, _, y in rows if g == x["g"])
        assert x["n"] == len(v) and x["err"] <= len(v) * 0.025 + 40
        for c, p in WANTED.items():
            k = max(1, -(-len(v) * p // 10000))
            assert sum(y < x[c] for y in v) - x["err"] < k <= sum(y <= x[c] for y in v) + x["err"], (x["g"], c)


def test_empty(spark):
    assert pc.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", WANTED).collect() == []


def test_days_combine_within_the_stated_error(spark, monkeypatch):
    monkeypatch.setattr(pc, "RUN", 256)
    r = random.Random(5)
    rows = [("a" if r.random() < 0.8 else "b", r.choice([1, 2, 2, 2, 3]), r.lognormvariate(0, 2)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(4)
    parts = pc.summaries(df, ["g", "day"], "v", steps=100)
    assert max(len(x["points"]) for x in parts.collect()) <= 100
    for x in pc.merged(parts, ["g"], WANTED).collect():
        v = sorted(y for g, _, y in rows if g == x["g"])
        assert x["n"] == len(v)
        for c, p in WANTED.items():
            at_or_below, below = sum(y <= x[c] for y in v), sum(y < x[c] for y in v)
            k = max(1, -(-len(v) * p // 10000))
            assert below - len(v) / 100 <= k <= at_or_below + len(v) / 100, (x["g"], c)


def test_usable(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    assert [r["v"] for r in df.where(pc.usable(F.col("v"))).collect()] == [1.0]


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 5), ("a", "x", 3.0, 6), (None, "x", 2.0, 7)], "run string, n string, pieces double, count int")
    got = pc.quantiles(df, ["run"], "pieces", {"p50": 5000})
    assert got.columns == ["run", "n", "p50"] and {tuple(r) for r in got.collect()} == {("a", 2, 1.0), (None, 1, 2.0)}
