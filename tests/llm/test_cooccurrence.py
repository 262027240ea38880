import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spliceframe.llm import cooccurrence as co


def _truth(rows, least):
    baskets = defaultdict(set)
    for s, b, i in rows:
        if b is not None and i is not None:
            baskets[s, b].add(i)
    one, two, n = Counter(), Counter(), Counter()
    for (s, _), items in baskets.items():
        n[s] += 1
        one.update((s, i) for i in items)
        two.update((s, *p) for p in itertools.combinations(sorted(items), 2))
    return {(s, a, b, c, one[s, a], one[s, b], n[s]) for (s, a, b), c in two.items() if c >= least}


@pytest.mark.parametrize("large", [3, 256])
def test_equals_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(co, "LARGE", large)
    r = random.Random(large)
    rows = [(r.choice(["s", "s", "t", None]), f"b{r.randrange(60)}", r.randrange(-9, 9)) for _ in range(700)]
    rows += [("s", None, 1), ("s", "b1", None)] + [("s", "huge", i) for i in range(-9, 30)] + rows[:50]
    df = spark.createDataFrame(rows, "src string, basket string, item long").withColumn("weight", F.lit("x"))
    got = co.together(df.withColumnRenamed("src", "items"), "items", "basket", "item", 3)
    assert got.columns == ["items", "a", "b", "n_ab", "n_a", "n_b", "n"]
    assert {tuple(x) for x in got.collect()} == _truth(rows, 3)


def test_empty(spark):
    assert co.together(spark.createDataFrame([], "s string, b string, i long"), "s", "b", "i", 1).collect() == []


def test_packing_keeps_order(spark):
    values = [(-(2**31), 5), (-1, -1), (-1, 0), (0, -5), (0, 7), (2**31 - 1, -(2**31)), (2**31 - 1, 2**31 - 1)]
    df = spark.createDataFrame(values, "s int, e int").withColumn("p", co.packed(F.col("s"), F.col("e")))
    s, e = co.unpacked(F.col("p"))
    assert [tuple(x) for x in df.orderBy("p").select(s, e).collect()] == values


def test_scores(spark):
    df = spark.createDataFrame([(20, 40, 25, 200), (10, 10, 10, 100), (4, 10, 10, 100)], "n_ab long, n_a long, n_b long, n long")
    assert [x["n_ab"] for x in co.lift_at_least(df, 4).collect()] == [20, 10, 4]
    assert [x["n_ab"] for x in co.lift_at_least(df, 5).collect()] == [10]
    rows = co.scored(df).collect()
    assert rows[0]["lift"] == 4.0 and rows[0]["conviction"] == 1.75 and rows[1]["conviction"] is None
