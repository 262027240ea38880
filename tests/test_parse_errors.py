import pytest
from pyspark.sql import functions as F

from spliceframe.operators import parse_errors as pe

H = "chrom\tchromStart\tchromEnd\t.\tscore\tstrand"
CASES = [
    ("1\t5\t9\t.\t3\t+", None),
    ("1\t5\t9\t.\t3\t+\r", None),
    (" 1 \t 0005 \t9\t.\t00\t 1 ", None),
    ("1\t9\t5\t.\t3\t+\ta\tb\tc\td\te\tf", None),
    ('"1"\t"5"\t9\t"a\tb"\t3\t+', None),
    ('"1"\t5\t9\t"a ""b"""\t3\t+', None),
    ('"a\\t\tb"\t5\t9\t.\t3\t+', None),
    ('1\t5\t9\t"a"b\t3\t+', "quoting"),
    ('1\t5\t9\ta"b\t3\t+', "quoting"),
    ('1\t5\t9\t"a\t3\t+', "quoting"),
    ('"', "quoting"),
    ('x"', "quoting"),
    ("1\t5\t9\t.\t3", "column_count"),
    ("1\t5\t9\t.\t3\t+\t", "column_count"),
    ('""', "column_count"),
    ("  \t5\t9\t.\t3\t+", "chrom"),
    ('""\tx\t9\t.\t3\t+', "chrom"),
    ("1\t0\t9\t.\t3\t+", "coordinate"),
    ("1\t5\t2147483648\t.\t3\t+", "coordinate"),
    ("1\t2147483647\t00000000000002147483647\t.\t2147483647\t+", None),
    ("1\t5\t99999999999999999999999999\t.\tx\t+", "coordinate"),
    ("1\t-5\t9\t.\t3\t+", "coordinate"),
    ("1\t5.0\t9\t.\t3\t+", "coordinate"),
    ("1\t5٠\t9\t.\t3\t+", "coordinate"),
    ("1\t5\n\t9\t.\t3\t+", "coordinate"),
    ("1\t5\t9\t.\t-1\t+", "score"),
    ("1\t5\t9\t.\t\t?", "score"),
    ("1\t5\t9\t.\t3\t", "strand"),
    ("1\t5\t9\t.\t3\t++", "strand"),
    ("1\t5\t9\t.\t3\t+\r\r", "strand"),
    ("\t" * 50_000, "column_count"),
    ('"' * 50_001, "quoting"),
]
NONE = ["", "   ", "\r", "# x", "#", H, H + "\r", None]


def test_reasons(spark):
    lines = [c[0] for c in CASES] + NONE
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(lines)], "raw_id long, raw_line string, score string")
    got = {r["raw_id"]: r["parse_reason"] for r in pe.checked_lines(df).collect()}
    assert got == {i: c[1] for i, c in enumerate(CASES)}


def test_values(spark):
    df = spark.createDataFrame([('" a\\t\tb"\t 007 \t9\t.\t3\t-',), ("x",)], "raw_line string")
    valid, broken = pe.split_valid(df)
    assert [tuple(r)[1:] for r in valid.collect()] == [("a\\t\tb", 7, 9, 3, "-")]
    assert [tuple(r) for r in broken.collect()] == [("x", "column_count")]


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([("x",)] * 3, "raw_line string")
    assert pe.split_valid(df)[1].count() == 3
    assert pe.checked_lines(df.limit(0)).count() == 0


def test_dictionary_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(pe, "hinted", lambda d: d)
    df = spark.createDataFrame([(c[0],) for c in CASES], "raw_line string")
    assert sorted(str(r["parse_reason"]) for r in pe.checked_lines(df).collect()) == sorted(str(c[1]) for c in CASES)
    assert pe.invalid_values(pe.parsed_lines(df)).groupBy("column", "value").count().where(F.col("count") > 1).isEmpty()


@pytest.mark.parametrize("frequent", [1, 1000])
def test_every_column_beyond_the_bound(spark, monkeypatch, frequent):
    monkeypatch.setattr(pe, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pe, "FREQUENT", frequent)
    lines = [c[0] for c in CASES] * 3 + ["1\t5\t9\t.\t3\t+"] * 500 + [f"1\t5\tx{i}\t.\t3\t+" for i in range(300)] + ["1\t5\t9\t.\t3\t?"] * 200
    want = [c[1] for c in CASES] * 3 + [None] * 500 + ["coordinate"] * 300 + ["strand"] * 200
    got = pe.checked_lines(spark.createDataFrame(list(enumerate(lines)), "raw_id long, raw_line string"), keep=["raw_id"])
    assert got.columns == ["raw_id", "chrom", "chrom_start", "chrom_end", "score", "strand", "parse_reason"]
    assert {r["raw_id"]: r["parse_reason"] for r in got.collect()} == dict(enumerate(want))


def test_no_hot_key_is_shuffled(spark, monkeypatch):
    """Nine of ten lines bear one strand, a third one invalid score: neither reaches the shuffled join."""
    monkeypatch.setattr(pe, "BROADCAST_ROWS", 0)
    score = F.when(F.col("id") % 3 == 0, "bad").when(F.col("id") % 7 == 0, F.concat(F.lit("s"), F.col("id"))).otherwise("5")
    line = F.concat_ws("\t", F.lit("1"), F.lit("5"), F.lit("9"), F.lit("."), score, F.when(F.col("id") % 10 == 0, "-").otherwise("+"))
    lines = pe.parsed_lines(spark.range(30_000).select(line.alias("raw_line"))).withColumn("_id", F.monotonically_increasing_id())
    values = pe.checked_values(lines)
    met = []
    real = pe.hinted
    monkeypatch.setattr(pe, "hinted", lambda d: met.append(d) or real(d))
    checked = pe._with_large(lines, values, ["score", "strand"], 1000)
    assert checked.where("_reason_score IS NOT NULL").count() == sum(i % 3 == 0 or i % 7 == 0 for i in range(30_000))
    assert {r["value"] for r in met[0].collect()} >= {"bad", "+", "-", "5"}
    assert values.where("reason IS NOT NULL AND n_lines <= 1000").agg(F.max("n_lines")).first()[0] == 1
