"""Many tiny files into few well-sized ones that hold every record exactly once.

Rows are range-partitioned by the identity of a record (boundaries sampled by Spark, number of ranges from the target bytes), so that
a range holds all copies of its records and equal work whatever the keys' skew; the newest copy is kept; each range is
written as one sorted file into a staging folder. Before the folders are swapped the written files are read again and reconciled: the number of rows and a
checksum of the identities with the source, the number of records and a checksum of all their columns with what was kept. A mismatch leaves the
old folder in place and raises. A swap that ends half-way is finished or undone by :func:`recovered`. The file system must rename folders at once, as HDFS does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spliceframe.session import delete_path, hadoop_path

TARGET_BYTES = 128 << 20
#: a file in a folder whose contents were reconciled; Spark doesn't read names that begin so
COMPLETE = "_COMPLETE"


@dataclass(frozen=True)
class Compacted:
    """What a compaction did."""

    path: str
    rows_in: int
    records: int
    files: int


def _hash(columns: list[str]) -> Column:
    """Of the values and of which of them are null."""
    return F.xxhash64(*(x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`")))).cast("decimal(38,0)")


def measured(df: DataFrame, identity: list[str]) -> tuple[int, int, int]:
    """(rows, bytes of the rows as text, order-free checksum of the identities), over all rows in one pass."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    none = F.lit(0)
    rows, size, checksum = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), none), F.coalesce(F.sum(_hash(identity)), none)).first()
    return rows, size, int(checksum)


def newest_records(df: DataFrame, identity: list[str], version: str, ranges: int) -> DataFrame:
    """One row per record, the one with the greatest ``version`` (null versions lose; ties go to the greatest row by all columns), with
    ``n_copies``. Null identities equal each other. Sorted by identity within ranges of the identity."""
    rest = [c for c in df.columns if c not in identity and c != version]
    ranged = df.repartitionByRange(ranges, *(F.col(f"`{c}`") for c in identity))
    order = F.struct(*(F.col(f"`{c}`") for c in [version, *rest]))
    kept = ranged.groupBy(*(F.col(f"`{c}`") for c in identity)).agg(F.max(order).alias("_row"), F.count(F.lit(1)).alias("n_copies"))
    columns = [F.col(f"`{c}`") if c in identity else F.col("_row").getField(c).alias(c) for c in df.columns]
    return kept.select(*columns, "n_copies").sortWithinPartitions(*(F.col(f"`{c}`") for c in identity))


def compact(df: DataFrame, path: str, identity: list[str], version: str, target_bytes: int = TARGET_BYTES) -> Compacted:
    """Writes the records of ``df`` to ``path`` (a folder of Parquet files, swapped in whole) with the column ``n_copies``, the number of
    rows a record came in. target_bytes: of a file's rows as text (Parquet takes a part of it).

    A column of ``df`` called n_copies is replaced. An empty table gives a folder without records. Nulls are kept as values. ``path``
    may be the folder that ``df`` reads: it is replaced only after the new files are complete.
    """
    spark = df.sparkSession
    df = df.drop("n_copies")
    path = path.rstrip("/")
    recovered(spark, path)
    rows, size, checksum = measured(df, identity)
    kept = Observation()
    records = newest_records(df, identity, version, max(1, -(-size // target_bytes)))
    staging = f"{path}.staging"
    records.observe(kept, F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(_hash(records.columns)), F.lit(0)).alias("checksum")).write.parquet(staging)
    found = reconciled(spark, staging, identity, rows, checksum, kept.get["records"], int(kept.get["checksum"]))
    swap(spark, staging, path)
    return Compacted(path, rows, *found)


def reconciled(spark: SparkSession, staging: str, identity: list[str], rows: int, checksum: int, records: int, whole: int) -> tuple[int, int]:
    """(records, files) of the written folder, which is marked as complete; raises unless every source row is accounted for in it and every record is as it was kept."""
    none = F.lit(0)
    read = spark.read.parquet(staging)
    written = read.withColumn("_file", F.input_file_name())
    found = written.agg(F.coalesce(F.sum("n_copies"), none), F.coalesce(F.sum(_hash(identity) * F.col("n_copies")), none), F.count(F.lit(1)), F.coalesce(F.sum(_hash(read.columns)), none), F.count_distinct("_file")).first()
    if (rows, checksum) != (found[0], int(found[1])):
        raise RuntimeError(f"{staging} holds {found[0]} of {rows} rows, checksum {found[1]} for {checksum}; the old folder is left as it was")
    if (records, whole) != (found[2], int(found[3])):
        raise RuntimeError(f"{staging} holds {found[2]} of {records} records, checksum {found[3]} for {whole}; the old folder is left as it was")
    fs, mark = hadoop_path(spark, f"{staging}/{COMPLETE}")
    fs.create(mark, True).close()
    return found[2], found[4]


def swap(spark: SparkSession, staging: str, path: str) -> None:
    """Puts a complete staging folder in the place of path; the old folder goes only after the new one is there."""
    fs, new = hadoop_path(spark, staging)
    at, old = hadoop_path(spark, path)[1], hadoop_path(spark, f"{path}.old")[1]
    if fs.exists(at) and not fs.rename(at, old):
        raise RuntimeError(f"{path} can't be moved away")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise RuntimeError(f"{staging} can't be moved to {path}")
    fs.delete(old, True)


def recovered(spark: SparkSession, path: str) -> str:
    """Finishes or undoes a swap that ended half-way, so that ``path`` holds the whole old or the whole new folder; does nothing else. Returns what was done.

    path is there: a folder beside it is what a compaction left, before (staging, dropped) or after (old, dropped) its swap. It is not: staging takes its
    place if it is complete, else old.
    """
    path = path.rstrip("/")
    fs, at = hadoop_path(spark, path)
    staging, old = (hadoop_path(spark, path + x)[1] for x in (".staging", ".old"))
    complete = fs.exists(hadoop_path(spark, f"{path}.staging/{COMPLETE}")[1])
    done = "nothing"
    if not fs.exists(at) and (complete or fs.exists(old)):
        done = "finished" if complete else "undone"
        if not fs.rename(staging if complete else old, at):
            raise RuntimeError(f"{path} can't be put in its place")
    for left in (staging, old):
        if fs.exists(left):
            fs.delete(left, True)
            done = done if done != "nothing" else "cleared"
    return done


def duplicated(records: DataFrame) -> DataFrame:
    """Records of a compacted table that came in more than one row."""
    return records.where(F.col("n_copies") > 1)
