"""Totals per key when a few keys hold most rows.

Rows are never shuffled by key. Every equal input split encodes its keys by a dictionary of its own, adds its rows into dense arrays indexed
by the code (numpy bincount / scatter-add), and emits them cut into blocks by a hash of the key, each with its piece of the dictionary. The arrays of a
block are added up after their codes are mapped to the block's dictionary, in two levels (first within lanes of splits, then over the lanes). The
table is read once, no dictionary reaches the driver, and a task's work depends on the bytes of its split and the number of keys, never on how often a key occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gene_key(c: str) -> Column:
    """Upper case without surrounding spaces; null where the name is null, empty or ``.``."""
    key = F.upper(F.trim(F.col(c)))
    return F.when((key != "") & (key != "."), key)


def keyed_totals(df: DataFrame, key: Column, sums: dict[str, Column], max_keys: int = 100_000) -> DataFrame:
    """One row per key: ``key``, ``n_rows``, and for each of ``sums`` its total ``name`` and the count ``n_name`` of values.

    key: string column; rows with a null key are left out. sums: integer (exact 64-bit totals) or double columns; null values
    count as none, a key without any value has a null total. NaN and infinities follow IEEE. max_keys: keys at which a split's
    arrays are emitted and begun anew, with the same result. The number of blocks is spark.sql.shuffle.partitions. An empty table gives no rows.
    Repeated rows count each; other columns of ``df`` are ignored, whatever their names.
    """
    names = list(sums)
    flat = df.select(key.cast("string").alias("k"), *(sums[n].alias(f"v{i}") for i, n in enumerate(names)))
    flat = flat.select("k", *(F.col(f"v{i}").cast("double" if _is_double(flat, f"v{i}") else "long").alias(f"v{i}") for i in range(len(names))))
    flat = flat.where(F.col("k").isNotNull())
    doubles = [_is_double(flat, f"v{i}") for i in range(len(names))]
    out = _blocks(flat, doubles, max(1, max_keys))
    cols = [F.col("k").alias("key"), F.col("n").alias("n_rows")]
    for i, name in enumerate(names):
        cols += [F.when(F.col(f"n{i}") > 0, F.col(f"s{i}")).alias(name), F.col(f"n{i}").alias(f"n_{name}")]
    return out.select(*cols)


def _is_double(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType, T.DecimalType))


def _scatter(arrays: list[np.ndarray], codes: np.ndarray, columns: list[pa.Array], doubles: list[bool]) -> None:
    """Adds a batch into [rows, count 0, sum 0, count 1, sum 1, ...]."""
    k = len(arrays[0])
    arrays[0] += np.bincount(codes, minlength=k)
    for i, col in enumerate(columns):
        there = np.asarray(col.is_valid())
        at = codes[there]
        arrays[1 + 2 * i] += np.bincount(at, minlength=k)
        values = np.asarray(col.drop_null())
        if doubles[i]:
            arrays[2 + 2 * i] += np.bincount(at, weights=values, minlength=k)
        else:
            np.add.at(arrays[2 + 2 * i], at, values)


def _zeros(k: int, doubles: list[bool]) -> list[np.ndarray]:
    return [np.zeros(k, np.int64)] + [x for d in doubles for x in (np.zeros(k, np.int64), np.zeros(k, np.float64 if d else np.int64))]


def _fields(doubles: list[bool]) -> list[tuple[str, str]]:
    return [("n", "long")] + [x for i, d in enumerate(doubles) for x in ((f"n{i}", "long"), (f"s{i}", "double" if d else "long"))]


def _blocks(flat: DataFrame, doubles: list[bool], max_keys: int) -> DataFrame:
    """(k, n, n0, s0, ...): one row per key."""
    splits = max(1, flat.rdd.getNumPartitions())
    lanes = max(1, int(splits**0.5)) if splits > 64 else 1
    blocks = int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = _fields(doubles)
    ddl = "ks array<string>, " + ", ".join(f"{n} array<{t}>" for n, t in fields)

    def lists(keys: pa.Array, arrays: list[np.ndarray], cuts: np.ndarray) -> dict[str, pa.Array]:
        offsets = pa.array(cuts, pa.int32())
        return {"ks": pa.ListArray.from_arrays(offsets, keys)} | {n: pa.ListArray.from_arrays(offsets, pa.array(a)) for (n, _), a in zip(fields, arrays)}

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId() % lanes

        def emit() -> pa.RecordBatch:
            keys, arrays = totals.result()
            block = (hash_array(np.array(keys, dtype=object), categorize=False) % blocks).astype(np.int64)
            order = np.argsort(block, kind="stable")
            block = block[order]
            cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            head = {"block": pa.array(block[cut], pa.int32()), "lane": pa.array(np.full(len(cut), lane), pa.int32())}
            return pa.RecordBatch.from_pydict(head | lists(pa.array([keys[i] for i in order], pa.string()), [a[order] for a in arrays], np.append(cut, len(keys))))

        totals = _Dense(doubles)
        for batch in batches:
            totals.add_rows(batch.column(0), batch.columns[1:])
            if len(totals.codes) >= max_keys:
                yield emit()
                totals = _Dense(doubles)
        if totals.codes:
            yield emit()

    def summed(batches: Iterator[pa.RecordBatch]) -> _Dense:
        totals = _Dense(doubles)
        for batch in batches:
            totals.add_arrays(batch.column("ks").flatten(), [np.asarray(batch.column(n).flatten()) for n, _ in fields])
        return totals

    def within_lane(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, arrays = summed(batches).result()
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32())} | lists(pa.array(keys, pa.string()), arrays, np.array([0, len(keys)])))

    def to_rows(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, arrays = summed(batches).result()
        yield pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.string())} | {n: pa.array(a) for (n, _), a in zip(fields, arrays)})

    _typed(within_lane), _typed(to_rows)
    parts = flat.mapInArrow(accumulate, f"block int, lane int, {ddl}")
    if lanes > 1:
        parts = parts.groupBy("block", "lane").applyInArrow(within_lane, f"block int, {ddl}")
    return parts.groupBy("block").applyInArrow(to_rows, "k string, " + ", ".join(f"{n} {t}" for n, t in fields))


class _Dense:
    """Accumulators [rows, count 0, sum 0, count 1, sum 1, ...], dense by the codes of a dictionary that grows with the keys."""

    def __init__(self, doubles: list[bool]):
        self.doubles = doubles
        self.codes: dict[str, int] = {}
        self.arrays = _zeros(1024, doubles)

    def _coded(self, keys: pa.Array) -> np.ndarray:
        local = keys.dictionary_encode()
        to_code = np.array([self.codes.setdefault(k, len(self.codes)) for k in local.dictionary.to_pylist()], np.int64)
        short = len(self.codes) - len(self.arrays[0])
        if short > 0:
            self.arrays = [np.concatenate([a, np.zeros(max(len(a), short), a.dtype)]) for a in self.arrays]
        return to_code[np.asarray(local.indices)]

    def add_rows(self, keys: pa.Array, columns: list[pa.Array]) -> None:
        if len(keys):
            codes = self._coded(keys)  # before the arrays are named: it may grow them
            _scatter(self.arrays, codes, columns, self.doubles)

    def add_arrays(self, keys: pa.Array, arrays: list[np.ndarray]) -> None:
        if len(keys):
            codes = self._coded(keys)
            for own, more in zip(self.arrays, arrays):
                np.add.at(own, codes, more)

    def result(self) -> tuple[list[str], list[np.ndarray]]:
        return list(self.codes), [a[: len(self.codes)] for a in self.arrays]


def _typed(f) -> None:
    """Real types as annotations: Spark reads them to pick the iterator form of applyInArrow."""
    f.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


def frequent_keys(totals: DataFrame, per_mille: int) -> DataFrame:
    """Keys of a (staged) result of :func:`keyed_totals` that hold at least ``per_mille`` / 1000 of all rows with a key."""
    total = totals.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    return totals.where(F.col("n_rows") * 1000 >= F.lit(total * per_mille))
