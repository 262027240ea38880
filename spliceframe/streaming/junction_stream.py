"""Incremental counts of junction rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceframe.session import new_path


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream over the Parquet files of a table (a folder, or one file)."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def windowed_counts(rows: DataFrame, keys: list[str], time: str, window: str, lateness: str) -> DataFrame:
    """(keys, window_start, n_rows, score) per tumbling window of ``time``; rows later than ``lateness`` behind the newest are dropped by a stream
    (a batch keeps all)."""
    rows = rows.withWatermark(time, lateness) if rows.isStreaming else rows
    out = rows.groupBy(*keys, F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("score"), F.lit(0)).alias("score"))
    return out.select(*keys, F.col("w.start").alias("window_start"), "n_rows", "score")


def once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, writes Parquet and gives the written table; restarts go on from the checkpoint."""
    spark = stream.sparkSession
    base = new_path(spark, "stream")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def totals_of(stream: DataFrame) -> DataFrame:
    """Runs an aggregating stream over all that is there and gives its final table (each batch replaces the table as a whole)."""
    spark = stream.sparkSession
    base = new_path(spark, "stream")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    query = stream.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
