"""Documents into containers of a fixed number of tokens, with a certified number of containers.

Documents are dealt to partitions, as many as run at once but of at most about ``PART_ITEMS`` pieces; each partition runs best-fit decreasing and is certified if
its number of containers equals a lower bound from dual feasible functions. Partitions with a gap give the pieces of their containers
that aren't full (certified ones those of their emptiest container) to an exchange, where they are dealt anew to fewer partitions and
packed again; a result is taken if it needs no more containers. This repeats until the total equals the bound over all pieces, or ``PATIENCE`` deals in a row
save no container; the gap that is left then is in the result. Only a table of sizes (at most capacity + 1 rows) and totals reach the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceframe.session import staged

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer of that file cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: pieces of a partition at most, and at least where there are enough
PART_ITEMS = 25_000
LEAST_ITEMS = 500
#: deals in a row without a gain after which the exchange ends
PATIENCE = 3


@cache
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, size): tokens of each text, special tokens' strings as ordinary text; a null or empty text has 0. Null ids are left out."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, pattern)
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            each = pa.array([len(encoder.encode_ordinary(t)) for t in coded.dictionary.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), each.take(coded.indices)], ["doc_id", "size"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
    return rows.mapInArrow(sizes, "doc_id long, size long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container, from 0, of each size (0 .. capacity), largest first, into the fullest container that has room."""
    out = np.zeros(len(sizes), np.int32)
    room: dict[int, list[int]] = {}
    rooms = 0  # bit f: a container with room f exists
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        if s == 0:
            n = max(n, 1)  # takes no room: the first container
            continue
        fits = rooms >> s
        if fits:
            f = s + (fits & -fits).bit_length() - 1
            b = room[f].pop()
            if not room[f]:
                rooms ^= 1 << f
        else:
            f, b, n = capacity, n, n + 1
        out[i] = b
        if f > s:
            left = room.setdefault(f - s, [])
            left.append(b)
            rooms |= 1 << (f - s)
    return out


def containers_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """A lower bound of the containers that ``counts`` items of each of ``sizes`` need: the best of the dual feasible functions that
    raise large items to the capacity and drop small ones, and of those that round sizes to multiples of capacity / k."""
    hist = np.zeros(capacity + 1, np.int64)
    np.add.at(hist, sizes, counts)
    if not hist.any():
        return 0
    x = np.arange(capacity + 1)
    n, total = np.cumsum(hist), np.cumsum(hist * x)
    best = 1
    cut = np.arange(capacity // 2 + 1)  # items above capacity - cut count whole, items below cut not at all
    below = np.where(cut > 0, total[cut - 1], 0)
    whole = n[-1] - n[capacity - cut]
    best = max(best, int((whole + -(-(total[capacity - cut] - below) // capacity)).max()))
    for k in range(1, 31):
        scaled = (k + 1) * x  # of an item x: x itself where (k + 1) x / capacity is whole, else floor((k + 1) x / capacity) capacity / k
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, -(-int((hist * value).sum()) // (k * capacity)))
    return best


@dataclass(frozen=True)
class Packing:
    """rows: doc_id, part_no, parts, size, container_id; containers used and the lower bound over all pieces, equal unless the exchange ended without
    a gain; certificates: (round, part, pieces, containers, bound) of every partition packed in any round."""

    rows: DataFrame
    containers: int
    bound: int
    rounds: int
    certificates: DataFrame

    @property
    def gap(self) -> int:
        return self.containers - self.bound


def pieces_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part_no, parts, size): a document above the capacity is cut into full pieces and a rest, others are one piece."""
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("size") / capacity))
    cut = sizes.select("doc_id", "size", parts.alias("parts")).withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return cut.select("doc_id", "part_no", "parts", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("part_no") * capacity).alias("size"))


def _histogram(pieces: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = pieces.groupBy("size").count().collect()  # at most capacity + 1 rows
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _packed(pieces: DataFrame, capacity: int, parts: int, round_no: int) -> DataFrame:
    """Each piece with its partition, container in it, room left in that container, and the partition's containers and bound."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["size"].to_numpy()
        bin_ = best_fit_decreasing(size, capacity)
        fill = np.bincount(bin_, weights=size).astype(np.int64)
        emptiest = int(fill.argmin())
        values, counts = np.unique(size, return_counts=True)
        bound = containers_bound(values, counts, capacity)
        gap = len(fill) > bound
        pdf["bound"] = bound
        pdf["bin"] = bin_
        pdf["gives"] = (fill[bin_] < capacity) & (gap | (bin_ == emptiest))
        return pdf

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("piece", F.lit(round_no)), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInPandas(pack, "piece long, doc_id long, part_no long, parts long, size long, part int, bound int, bin int, gives boolean")


def _container(round_no: int) -> Column:
    return F.shiftleft(F.lit(round_no).cast("long"), 56) + F.shiftleft(F.col("part").cast("long"), 24) + F.col("bin")


def _bins(packed: DataFrame) -> int:
    return packed.select("part", "bin").distinct().count()


def _certificates(packed: DataFrame, round_no: int) -> DataFrame:
    """A row per partition; containers are numbered from 0 without gaps."""
    return packed.groupBy("part").agg(F.count(F.lit(1)).alias("pieces"), (F.max("bin") + 1).alias("containers"), F.max("bound").alias("bound")).select(F.lit(round_no).alias("round"), "*")


def _parts(pieces: int, cores: int) -> int:
    return max(1, -(-pieces // PART_ITEMS), min(cores, pieces // LEAST_ITEMS))


def pack(sizes: DataFrame, capacity: int = 2048) -> Packing:
    """Assigns every document of (doc_id, size) to containers: only one above the capacity is split. Repeated rows are documents of their own;
    empty documents lie in some container; an empty table needs none."""
    pieces = staged(pieces_of(sizes, capacity).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    values, counts = _histogram(pieces)
    n, bound = int(counts.sum()), containers_bound(values, counts, capacity)
    columns = ("doc_id", "part_no", "parts", "size")
    cores = sizes.sparkSession.sparkContext.defaultParallelism
    current = staged(_packed(pieces, capacity, _parts(n, cores), 0), "packed")
    total = _bins(current)
    certificates = _certificates(current, 0)
    settled, rounds, last, idle = [], 0, 0, 0
    while total > bound and idle < PATIENCE:
        given = current.where("gives")
        released, before = given.count(), _bins(given)
        rounds += 1
        again = staged(_packed(given.select("piece", *columns), capacity, max(1, -(-released // PART_ITEMS)), rounds), "packed")
        after = _bins(again)
        certificates = certificates.unionByName(_certificates(again, rounds))
        idle = 0 if after < before else idle + 1
        if after <= before:
            settled.append(current.where(~F.col("gives")).select(*columns, _container(last).alias("container_id")))
            current, total, last = again, total - before + after, rounds
    rows = current.select(*columns, _container(last).alias("container_id"))
    for part in settled:
        rows = rows.unionByName(part)
    return Packing(rows, total, bound, rounds, certificates)
