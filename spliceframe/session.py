"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def local_session(cpus: int = 8, name: str = "spliceframe") -> SparkSession:
    """A session on this machine, for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; a new one of our own only where it is unset and all tasks run in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = f"file://{folder}"
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, under the application's name."""
    return f"{shared_folder(spark)}/spliceframe-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that still read them must have been written before."""
    delete_path(spark, new_path(spark, "").rsplit("/", 1)[0])


def staged(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, is computed once.

    folders: columns by whose values the files lie in folders of their own, so that a filter on them reads no others."""
    path = new_path(df.sparkSession, label)
    df.write.partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`staged`."""
    for df in tables:
        for path in {re.match(r".*/spliceframe-[^/]+/[^/]+", f)[0] for f in df.inputFiles()}:
            delete_path(df.sparkSession, path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measures a (staged) table: whether it may be broadcast or collected."""
    text = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, _ in df.dtypes]
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(text, F.lit(0)).cast("long")), F.lit(0))).first()
    return n <= rows and b + 16 * n <= size


def hinted(df: DataFrame) -> DataFrame:
    """``df`` (staged) with a broadcast hint if its measured size is within the bound, else as it is, for a shuffled join."""
    return F.broadcast(df) if small_enough(df) else df
