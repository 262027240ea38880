import os

import pytest
from pyspark.sql import functions as F

from spliceframe.operators import compaction as cp
from spliceframe.sources.tables import table

DDL = "sample_id string, rec_no long, score int, written_at long, n_copies int"


def test_newest_copy_is_kept(spark, tmp_path):
    rows = [("s", 1, 5, 1, 0), ("s", 1, 6, 2, 0), ("s", 2, 6, 2, 0), (None, 1, None, None, 0), (None, 1, 4, None, 0), ("t", None, 1, 1, 0), ("t", None, 1, 1, 0), ("s", 3, 9, None, 0), ("s", 3, 1, 0, 0)]
    done = cp.compact(spark.createDataFrame(rows, DDL), f"{tmp_path}/out", ["sample_id", "rec_no"], "written_at")
    got = {(r["sample_id"], r["rec_no"]): (r["score"], r["n_copies"]) for r in spark.read.parquet(done.path).collect()}
    assert got == {("s", 1): (6, 2), ("s", 2): (6, 1), (None, 1): (4, 2), ("t", None): (1, 2), ("s", 3): (1, 2)}
    assert (done.rows_in, done.records, done.files) == (9, 5, 1)


def test_empty(spark, tmp_path):
    done = cp.compact(spark.createDataFrame([], DDL), f"{tmp_path}/out", ["sample_id", "rec_no"], "written_at")
    assert done.records == 0 and spark.read.parquet(done.path).count() == 0


def test_in_place_and_well_sized(spark, tmp_path):
    path = f"{tmp_path}/store"
    spark.range(20_000).select(F.lit("hot").alias("sample_id"), F.col("id").alias("rec_no"), F.lit(1).alias("score"), F.col("id").alias("written_at")).repartition(60).write.parquet(path)
    done = cp.compact(spark.read.parquet(path), path, ["sample_id", "rec_no"], "written_at", target_bytes=100_000)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert done.files == len(files) and 2 <= len(files) <= 6
    counts = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(counts) == 20_000 and max(counts) < 2.5 * min(counts)


def test_a_mismatch_leaves_the_old_folder(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    spark.createDataFrame([("s", 1, 5, 1)], "sample_id string, rec_no long, score int, written_at long").write.parquet(path)
    real = cp.newest_records
    monkeypatch.setattr(cp, "newest_records", lambda *a: real(*a).limit(0))
    with pytest.raises(RuntimeError):
        cp.compact(spark.read.parquet(path), path, ["sample_id", "rec_no"], "written_at")
    assert spark.read.parquet(path).count() == 1


ONE = "sample_id string, rec_no long, score int, written_at long"


@pytest.mark.parametrize("crash", ["reconciled", "moved away", "moved in"])
def test_a_crash_during_the_swap(spark, tmp_path, crash):
    path = f"{tmp_path}/store"
    spark.createDataFrame([("s", 1, 5, 1), ("s", 1, 6, 2)], ONE).write.parquet(path)
    done = cp.compact(spark.read.parquet(path), f"{tmp_path}/other", ["sample_id", "rec_no"], "written_at")
    os.rename(done.path, f"{path}.staging")
    if crash != "reconciled":
        os.rename(path, f"{path}.old")
    if crash == "moved in":
        os.rename(f"{path}.staging", path)
    assert cp.recovered(spark, path) == ("finished" if crash == "moved away" else "cleared")
    assert sorted(os.listdir(tmp_path)) == ["store"] and spark.read.parquet(path).count() == (2 if crash == "reconciled" else 1)


def test_a_crash_before_the_new_folder_is_whole(spark, tmp_path):
    path = f"{tmp_path}/store"
    spark.createDataFrame([("s", 1, 5, 1)], ONE).write.parquet(f"{path}.old")
    spark.createDataFrame([], ONE).write.parquet(f"{path}.staging")
    assert cp.recovered(spark, path) == "undone" and os.listdir(tmp_path) == ["store"]
    assert spark.read.parquet(path).count() == 1 and cp.recovered(spark, path) == "nothing"


@pytest.mark.parametrize("column", ["score", "written_at", "sample_id"])
def test_a_changed_value_is_noticed(spark, tmp_path, monkeypatch, column):
    real = cp.reconciled

    def changed(spark, staging, *a):
        rows = spark.read.parquet(staging).collect()
        kinds = spark.read.parquet(staging).schema
        wrong = [tuple((x if c != column else None) for c, x in zip(kinds.names, r)) for r in rows]
        spark.createDataFrame(wrong, kinds).write.mode("overwrite").parquet(staging)
        return real(spark, staging, *a)

    monkeypatch.setattr(cp, "reconciled", changed)
    with pytest.raises(RuntimeError):
        cp.compact(spark.createDataFrame([("s", 1, 5, 1), ("t", 2, 5, 1)], ONE), f"{tmp_path}/store", ["sample_id", "rec_no"], "written_at")
    assert not os.path.exists(f"{tmp_path}/store")


def test_tiny_junc_files(spark, tmp_path):
    parts = table(spark, "/root/testdata/sf0.001", "junc_parts").where("sample_id = 'SMP0001'").limit(400)
    lines = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sample_id", "rec_no", "chrom", "chrom_start", "chrom_end", "score", "strand", "written_at")))
    parts.select("file_name", lines.alias("value")).write.partitionBy("file_name").text(f"{tmp_path}/tiny")
    ddl = "sample_id string, rec_no long, chrom string, chrom_start int, chrom_end int, score int, strand string, written_at timestamp"
    read = spark.read.schema(ddl).option("sep", "\t").option("recursiveFileLookup", True).csv(f"{tmp_path}/tiny")
    done = cp.compact(read, f"{tmp_path}/store", ["sample_id", "rec_no"], "written_at")
    assert len(read.inputFiles()) > 20 and done.files == 1
    assert done.records == parts.select("sample_id", "rec_no").distinct().count() and done.rows_in == parts.count()
