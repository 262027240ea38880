"""Stores of very many tiny text files. Tasks list, read and write them in bulk, so that the driver never holds an index of the files and a file costs no task of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: subfolders of a store, so that no folder holds more than a part of the files
FOLDERS = 256
#: bytes of files that a task reads before it hands them on
BATCH_BYTES = 4 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_small_files(rows: DataFrame, path: str) -> None:
    """Writes (file_name, value): one file per file_name (which may name folders) under ``path``, in a subfolder by a hash of the name, of its lines ``value``.

    The lines of a file are brought to one task and written in order; a repeated task writes the same file again. Null names or values are left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(path.rstrip("/"))
        name, lines, n = None, [], 0

        def flush() -> None:
            if name is not None:
                at = f"{root}/{name[0]:03d}/{name[1]}"
                parent = at.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(at) as out:
                    out.write("".join(f"{x}\n" for x in lines).encode("utf-8", "surrogatepass"))

        made: set[str] = set()
        for batch in batches:
            for folder, file, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (folder, file) != name:
                    flush()
                    name, lines, n = (folder, file), [], n + 1
                lines.append(value)
        flush()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    rows = rows.where(F.col("file_name").isNotNull() & F.col("value").isNotNull())
    dealt = rows.select(F.pmod(F.xxhash64("file_name"), F.lit(FOLDERS)).cast("int").alias("folder"), "file_name", "value")
    dealt.repartition("file_name").sortWithinPartitions("folder", "file_name", "value").mapInArrow(write, "files long").agg(F.sum("files")).collect()


def read_small_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, value): every line of every file in the subfolders of ``path``. Each file is opened once; an empty file gives no row."""
    system, root = _opened(path.rstrip("/"))
    folders = [x.path for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.Directory]  # at most FOLDERS

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [x.path for x in system.get_file_info(fs.FileSelector(folder, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
                for i in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pydict({"path": pa.array(found[i : i + 10_000], pa.string())})

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(path.rstrip("/"))

        def read() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file_name": pa.array(files, pa.string()), "text": pa.array(texts, pa.string())})

        files, texts, size = [], [], 0
        for batch in batches:
            for at in batch.column(0).to_pylist():
                with system.open_input_stream(at) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
                files.append(at[len(root) + 5 :])
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield read()
                    files, texts, size = [], [], 0
        yield read()

    listed = spark.createDataFrame([(x,) for x in folders], "path string").repartition(max(1, len(folders))).mapInArrow(names, "path string")
    spread = listed.repartition(F.xxhash64("path"))
    lines = spread.mapInArrow(contents, "file_name string, text string").select("file_name", F.explode(F.split("text", "\n")).alias("value"))
    return lines.where(F.col("value") != "")
