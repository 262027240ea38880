"""Exact percentiles per group by distributed multi-select, and mergeable summaries of separate days.

The values of every input split become sorted runs where they are; no value is shuffled before the selection. Every run proposes, for each open range of a group, the median of its values in the range; the weighted median of the proposals
becomes the pivot. In a round the runs count their values below and at the pivot and propose medians of both sides; the side that can't hold the wanted rank is discarded, and
the other one's proposals give the next pivot. Percentiles of a group share a range until a pivot parts them. A percentile is found when the pivot has its rank, or when at most ``LEAST`` values remain, which
are then gathered. Every group takes part in the first round, whatever its size. Groups are dealt to blocks of at most about ``ASKS``
percentiles by a hash, and a block's ranges, proposals and counts travel as arrays; sums and medians are taken within lanes of splits, then over the lanes.

A quantile p of n values is the smallest value with at least p x n values at or below it, always one of the values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceframe.session import BROADCAST_BYTES, discard, hinted, new_path, staged

#: values that a task sorts at a time
RUN = 1 << 20
#: remaining values of a range that are gathered
LEAST = 16
#: percentiles of a block of groups
ASKS = 16_384
#: splits of a lane
LANE = 256
#: bytes of an asked percentile with its group, range and pivot
ASK_BYTES = 64
#: summaries of a group that one task merges
FAN = 64
SCALE = 10_000


def usable(value: Column) -> Column:
    """Not null, finite and above 0."""
    return value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))


def rank_of(n: Column, per_scale: int | Column) -> Column:
    """The rank, from 1, of the quantile per_scale / SCALE among n values; exact (the parts stay within whole doubles)."""
    p = F.lit(per_scale).cast("long") if isinstance(per_scale, int) else per_scale.cast("long")
    return F.greatest(F.lit(1).cast("long"), F.floor(n / SCALE).cast("long") * p + F.ceil((n % SCALE) * p / SCALE).cast("long"))


def _own_names(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, list[Column], list[str]]:
    """(the rows with a value under names that clash with none of ours, the keys as first named, our names of them)."""
    own = [f"_k{i}" for i in range(len(keys))]
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*(F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)), v.alias("_v"))
    return rows.where(F.col("_v").isNotNull() & ~F.isnan("_v")), [F.col(o).alias(k) for k, o in zip(keys, own)], own


def _hash(keys: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *(x for k in keys for x in (F.col(k).isNull(), F.col(k))))


def _groups(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int, int]:
    """(staged (keys, n, g), number of groups, seed): g is a hash of the keys that no two groups share under this seed."""
    sizes = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "sizes")
    seed = 0
    while True:
        groups = sizes.withColumn("g", _hash(keys, seed))
        total, different = groups.agg(F.count(F.lit(1)), F.count_distinct("g")).first()
        if total == different:
            return groups, total, seed
        seed += 1


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, int], keep: str | None = None) -> DataFrame:
    """One row per group: keys, n and a column for each of ``wanted`` (name: quantile in 1 / 10,000); ``keep`` names a column for the rounds a group took part in.

    Null and NaN values are left out (filter with :func:`usable` for more); infinities are values like others. Null keys form groups. Equal
    values and repeated rows count each. A group without values gives no row; an empty table none.
    """
    df, named, keys = _own_names(df, keys, value)
    groups, total, seed = _groups(df, keys)
    ranks = list(dict.fromkeys(wanted.values()))
    found = select_ranks(df.select(_hash(keys, seed).alias("g"), "_v"), groups, total, ranks)
    values = [F.col("found")[ranks.index(p)].alias(c) for c, p in wanted.items()]
    return groups.join(found, "g").select(*named, "n", *values, *([F.col("rounds").alias(keep)] if keep else []))


# ---- runs


def _list(column: pa.Array, r: int) -> np.ndarray:
    """The list in row r."""
    return np.asarray(column[r].values)


def _runs(blocks: int, visits: int) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId() // LANE
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            g, v = (np.concatenate(x) for x in zip(*held))
            block = g % blocks
            order = np.lexsort((v, g, block))
            g, v, block = g[order], v[order], block[order]
            at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            sizes = np.diff(np.append(at, len(g)))
            cut = np.flatnonzero(np.concatenate([[True], block[at][1:] != block[at][:-1]]))
            begins = np.append(cut, len(at))
            values = np.append(at, len(g))[begins]
            lists = lambda x, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x))
            own = block[at][cut]
            columns = [pa.array(own % visits, pa.int32()), pa.array(own, pa.int64()), pa.array(np.full(len(own), lane), pa.int32()), lists(g[at], begins), lists(sizes, begins), lists(v, values)]
            return pa.RecordBatch.from_arrays(columns, ["visit", "block", "lane", "gs", "sizes", "run"])

        for batch in batches:
            for i in range(0, batch.num_rows, RUN):
                part = batch.slice(i, RUN)
                held.append((np.asarray(part.column(0)), np.asarray(part.column(1))))
                size += part.num_rows
                if size >= RUN:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return build


# ---- ranges of a block of groups; lo and hi are bounds that don't belong to a range, NaN where there is none


_STATE = "visit int, block long, open boolean, rounds int, gs array<long>, n array<long>, k array<long>, m array<long>, lo array<double>, hi array<double>, found array<double>, done array<boolean>, pivot array<double>, took array<int>"
_KINDS = {"gs": pa.int64(), "n": pa.int64(), "k": pa.int64(), "m": pa.int64(), "lo": pa.float64(), "hi": pa.float64(), "found": pa.float64(), "done": pa.bool_(), "pivot": pa.float64(), "took": pa.int32()}


def _state_row(visit: int, block: int, rounds: int, s: dict[str, np.ndarray]) -> pa.RecordBatch:
    still = bool((~s["done"] & (s["m"] > LEAST)).any()) or rounds == 0
    head = {"visit": pa.array([visit], pa.int32()), "block": pa.array([block], pa.int64()), "open": pa.array([still]), "rounds": pa.array([rounds], pa.int32())}
    return pa.RecordBatch.from_pydict(head | {c: pa.array([s[c]], pa.list_(t)) for c, t in _KINDS.items()})


def _first_state(wanted: list[int], visits: int) -> Callable:
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ps = np.array(wanted, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.column("block")[r].as_py()
                of = batch.column("of")[r].values
                g, n = np.asarray(of.field(0)), np.asarray(of.field(1))
                k = np.maximum(1, (n // SCALE)[:, None] * ps + -(-(n % SCALE)[:, None] * ps // SCALE)).ravel()
                m = np.repeat(n, len(ps))
                none = np.full(len(m), np.nan)
                s = {"gs": g, "n": n, "k": k, "m": m, "lo": none, "hi": none, "found": none, "done": np.zeros(len(m), bool), "pivot": none, "took": np.zeros(len(g), np.int32)}
                yield _state_row(block % visits, block, 0, s)

    return first


def _read_state(batch: pa.RecordBatch, r: int) -> dict[str, np.ndarray]:
    return {c: _list(batch.column(c), r) for c in _KINDS}


def _ranges(s: dict[str, np.ndarray], rounds: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the first percentile of each distinct open range, number of the range of every percentile, -1 where it isn't open); last: the ranges to gather."""
    wanted = len(s["k"]) // max(1, len(s["gs"]))
    g = np.repeat(s["gs"], wanted)
    open_ = ~s["done"] if last else ~s["done"] & ((s["m"] > LEAST) | (rounds == 0))
    at = np.flatnonzero(open_)
    # percentiles are open ranges in any order, so ranges that are alike are brought together first
    order = at[np.lexsort((s["hi"][at], s["lo"][at], g[at]))]
    alike = lambda x: (x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1]))
    same = (g[order][1:] == g[order][:-1]) & alike(s["lo"][order]) & alike(s["hi"][order]) if len(order) else np.zeros(0, bool)
    fresh = np.concatenate([[True], ~same])[: len(order)]
    number = np.full(len(g), -1, np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


def _asks(last: bool) -> Callable:
    """The distinct open ranges of each block, by group."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s = _read_state(batch, r)
                first, _ = _ranges(s, batch.column("rounds")[r].as_py(), last)
                if len(first):
                    g = np.repeat(s["gs"], len(s["k"]) // len(s["gs"]))[first]
                    lists = [pa.array([x], pa.list_(t)) for x, t in ((g, pa.int64()), *((s[c][first], pa.float64()) for c in ("lo", "hi", "pivot")))]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("block")[r].as_py()], pa.int64()), *lists], ["block", "ag", "alo", "ahi", "apivot"])

    return ask


def _bisect(run: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """In each part i .. j of a run the place of x, before (or behind, ``right``) values equal to it."""
    i, j = i.copy(), j.copy()
    open_ = np.flatnonzero(i < j)
    while len(open_):
        mid = (i[open_] + j[open_]) >> 1
        up = run[mid] <= x[open_] if right else run[mid] < x[open_]
        i[open_[up]] = mid[up] + 1
        j[open_[~up]] = mid[~up]
        open_ = open_[i[open_] < j[open_]]
    return i


def _parts(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, from, to): the part of the run in row r that lies in each asked range."""
    gs, sizes, run, ag, lo, hi = (_list(batch.column(c), r) for c in ("gs", "sizes", "run", "ag", "alo", "ahi"))
    ends = np.cumsum(sizes)
    at = np.minimum(np.searchsorted(gs, ag), len(gs) - 1)
    there = gs[at] == ag
    i, j = np.where(there, ends[at] - sizes[at], 0), np.where(there, ends[at], 0)
    low, high = np.isnan(lo), np.isnan(hi)
    begin = np.where(low, i, _bisect(run, i, np.where(low, i, j), lo, True))
    end = np.where(high, j, _bisect(run, begin, np.where(high, begin, j), hi, False))
    return run, begin, np.maximum(begin, end)


_FIELDS = ("at", "a", "b", "c", "d", "e")
_MESSAGE = "block long, lane int, " + ", ".join(f"{c} binary" for c in _FIELDS)
_ASKS = "block long, ag array<long>, alo array<double>, ahi array<double>, apivot array<double>"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs, or doubles, with the kind in front."""
    x = x if x.dtype == np.float64 else x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return f"{x.dtype.kind}{x.dtype.itemsize}".encode() + x.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    values = np.frombuffer(x, x[:2].decode(), offset=2)
    return values if values.dtype == np.float64 else values.astype(np.int64)


def _message(block: int, lane: int, at: np.ndarray, *said: np.ndarray) -> pa.RecordBatch:
    """What a run says of the ranges ``at`` (ascending), which travel as their distances."""
    lists = dict(zip(_FIELDS, (np.diff(at, prepend=0), *said)))
    head = {"block": pa.array([block], pa.int64()), "lane": pa.array([lane], pa.int32())}
    return pa.RecordBatch.from_pydict(head | {c: pa.array([_packed(lists[c]) if c in lists else None], pa.binary()) for c in _FIELDS})


def _place(batch: pa.RecordBatch, r: int) -> tuple[int, int]:
    return batch.column("block")[r].as_py(), batch.column("lane")[r].as_py()


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each open range the median of the run's values in it, and their number."""
    for batch in batches:
        for r in range(batch.num_rows):
            run, i, j = _parts(batch, r)
            at = np.flatnonzero(j > i)
            if len(at):
                yield _message(*_place(batch, r), at, run[(i[at] + j[at] - 1) >> 1], (j - i)[at])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each open range the run's values below, at and above the pivot, and the medians of those below and above (NaN for none)."""
    for batch in batches:
        for r in range(batch.num_rows):
            run, i, j = _parts(batch, r)
            at = np.flatnonzero(j > i)
            if len(at):
                pivot, i, j = _list(batch.column("apivot"), r)[at], i[at], j[at]
                lower = _bisect(run, i, j, pivot, False)
                upper = _bisect(run, lower, j, pivot, True)
                low, high = (np.where(b > a, run[np.minimum((a + b - 1) >> 1, len(run) - 1)], np.nan) for a, b in ((i, lower), (upper, j)))
                yield _message(*_place(batch, r), at, lower - i, upper - lower, j - upper, low, high)


def _remain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The run's values in each range that is gathered."""
    for batch in batches:
        for r in range(batch.num_rows):
            run, i, j = _parts(batch, r)
            size = j - i
            if size.sum():
                at = np.repeat(np.arange(len(i)), size)
                yield _message(*_place(batch, r), at, run[np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + i[at]])


def _joined(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The ranges of all messages of a block, joined, and what is said of them."""
    rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in _FIELDS))]
    lists = [[_unpacked(x) for x in column if x is not None] for column in zip(*rows)]
    return [np.concatenate(x if i else [np.cumsum(y) for y in x]) for i, x in enumerate(lists) if x]


def _pivots(at: np.ndarray, median: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """The weighted median of the proposals for each range, and their weight."""
    order = np.lexsort((median, at))
    at, median, weight = at[order], median[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    upto = np.cumsum(weight)
    before = upto[first] - weight[first]
    total = np.append(before[1:], upto[-1]) - before
    return at[first], median[np.searchsorted(upto, before + (total + 1) // 2)], total


def _sums(at: np.ndarray, below: np.ndarray, equal: np.ndarray, above: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """The counts added up, and the weighted medians of the proposals for both sides."""
    ranges, place = np.unique(at, return_inverse=True)
    counts = [np.bincount(place, weights=x, minlength=len(ranges)).astype(np.int64) for x in (below, equal, above)]
    sides = []
    for median, weight in ((low, below), (high, above)):
        side = np.full(len(ranges), np.nan)
        there = weight > 0
        if there.any():
            of, pivot, _ = _pivots(place[there], median[there], weight[there])
            side[of] = pivot
        sides.append(side)
    return ranges, *counts, *sides


def _values(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((value, at))
    return at[order], value[order]


def _reduced(messages: DataFrame, lanes: int, merge: Callable, fields: dict[str, str]) -> DataFrame:
    """(block, fields): the messages of a block merged within lanes, then over the lanes; every open range holds a value, so every range is in the result, in order."""
    kinds = {"array<long>": pa.int64(), "array<double>": pa.float64()}

    def within_lane(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _message(key[0].as_py(), key[1].as_py(), *merge(*_joined(batches)))

    def whole(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = merge(*_joined(batches))
        named = {"at": done[0]} | dict(zip([n for n in fields if n != "at"], done[1:]))
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int64())} | {n: pa.array([named[n]], pa.list_(kinds[t])) for n, t in fields.items()})

    for f in (within_lane, whole):  # real types: Spark reads them to pick the iterator form of applyInArrow
        f.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    if lanes > 1:
        messages = messages.groupBy("block", "lane").applyInArrow(within_lane, _MESSAGE)
    return messages.groupBy("block").applyInArrow(whole, "block long, " + ", ".join(f"{n} {t}" for n, t in fields.items()))


def _aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state with its first pivots."""
    for batch in batches:
        for r in range(batch.num_rows):
            s = {c: x.copy() for c, x in _read_state(batch, r).items()}
            _, number = _ranges(s, 0, False)
            at = np.flatnonzero(number >= 0)
            s["pivot"][at] = _list(batch.column("median"), r)[number[at]]
            yield _state_row(batch.column("visit")[r].as_py(), batch.column("block")[r].as_py(), 0, s)


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a round: the side of the pivot that can't hold the rank is discarded, the other one's proposals give the next pivot."""
    for batch in batches:
        for r in range(batch.num_rows):
            s, rounds = {c: x.copy() for c, x in _read_state(batch, r).items()}, batch.column("rounds")[r].as_py()
            _, number = _ranges(s, rounds, False)
            at = np.flatnonzero(number >= 0)
            below, equal, above, low, high = (_list(batch.column(c), r)[number[at]] for c in ("below", "equal", "above", "low", "high"))
            k, pivot = s["k"][at], s["pivot"][at]
            left, here = k <= below, (k > below) & (k <= below + equal)
            right = ~left & ~here
            s["done"][at[here]], s["found"][at[here]] = True, pivot[here]
            s["hi"][at[left]], s["m"][at[left]], s["pivot"][at[left]] = pivot[left], below[left], low[left]
            s["lo"][at[right]], s["m"][at[right]], s["pivot"][at[right]] = pivot[right], above[right], high[right]
            s["k"][at[right]] = (k - below - equal)[right]
            s["took"][np.unique(at // (len(s["k"]) // len(s["gs"])))] += 1
            yield _state_row(batch.column("visit")[r].as_py(), batch.column("block")[r].as_py(), rounds + 1, s)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, found, rounds): the rank among the gathered values where the rounds left more than one."""
    for batch in batches:
        for r in range(batch.num_rows):
            s = {c: x.copy() for c, x in _read_state(batch, r).items()}
            _, number = _ranges(s, batch.column("rounds")[r].as_py(), True)
            at = np.flatnonzero(number >= 0)
            if len(at):
                of, value = _list(batch.column("at"), r), _list(batch.column("value"), r)
                s["found"][at] = value[np.searchsorted(of, number[at]) + s["k"][at] - 1]
            wanted = len(s["k"]) // len(s["gs"])
            found = pa.ListArray.from_arrays(pa.array(np.arange(0, len(s["k"]) + 1, wanted), pa.int32()), pa.array(s["found"]))
            yield pa.RecordBatch.from_arrays([pa.array(s["gs"]), found, pa.array(s["took"], pa.int32())], ["g", "found", "rounds"])


_FOUND = "g long, found array<double>, rounds int"


def select_ranks(rows: DataFrame, groups: DataFrame, total: int, wanted: list[int]) -> DataFrame:
    """(g, found, rounds): for each of the ``total`` groups (g, n) the values of (g, _v) at the quantiles ``wanted``, in that order, and the rounds it took part in.

    The asked ranges are broadcast to the runs, at most ``BROADCAST_BYTES`` of them at a time; more groups are gone through in visits, each of which
    reads its own runs only.
    """
    spark = rows.sparkSession
    blocks = max(1, -(-total * len(wanted) // ASKS))
    visits = max(1, min(blocks, -(-total * len(wanted) * ASK_BYTES // BROADCAST_BYTES)))
    runs = staged(rows.mapInArrow(_runs(blocks, visits), "visit int, block long, lane int, gs array<long>, sizes array<long>, run array<double>"), "runs", *(["visit"] if visits > 1 else []))
    lanes = 1 + (runs.agg(F.max("lane")).first()[0] or 0)
    dealt = groups.groupBy(F.pmod("g", F.lit(blocks).cast("long")).alias("block")).agg(F.sort_array(F.collect_list(F.struct("g", "n"))).alias("of"))
    start = staged(dealt.mapInArrow(_first_state(wanted, visits), _STATE), "state")
    results = new_path(spark, "found")
    for visit in range(visits):
        own, state = (runs.where(F.col("visit") == visit), start.where(F.col("visit") == visit)) if visits > 1 else (runs, start)
        _selected(own.drop("visit"), state, lanes).write.mode("append").parquet(results)
    discard(runs, start)
    return spark.read.schema(_FOUND).parquet(results)


def _selected(runs: DataFrame, state: DataFrame, lanes: int) -> DataFrame:
    asks = state.mapInArrow(_asks(False), _ASKS)
    proposals = runs.join(F.broadcast(asks), "block").mapInArrow(_propose, _MESSAGE)
    pivots = _reduced(proposals, lanes, _pivots, {"median": "array<double>", "weight": "array<long>"})
    state = staged(state.join(F.broadcast(pivots), "block").mapInArrow(_aim, _STATE), "state")
    while not state.where("open").isEmpty():
        asks = state.where("open").mapInArrow(_asks(False), _ASKS)
        counted = runs.join(F.broadcast(asks), "block").mapInArrow(_count, _MESSAGE)
        counts = _reduced(counted, lanes, _sums, {"below": "array<long>", "equal": "array<long>", "above": "array<long>", "low": "array<double>", "high": "array<double>"})
        moved = state.where("open").join(F.broadcast(counts), "block").mapInArrow(_advance, _STATE)
        after = staged(state.where(~F.col("open")).unionByName(moved), "state")
        discard(state)
        state = after
    asks = state.mapInArrow(_asks(True), _ASKS)
    parts = runs.join(F.broadcast(asks), "block").mapInArrow(_remain, _MESSAGE)
    left = _reduced(parts, 1, _values, {"at": "array<long>", "value": "array<double>"})
    return state.join(left, "block", "left").mapInArrow(_finish, _FOUND)


# ---- summaries


def summaries(df: DataFrame, keys: list[str], value: str, steps: int = 400) -> DataFrame:
    """A mergeable summary per group: keys, n, err and ``points`` (value v, weight w: it stands for the w ranks up to its own).

    The points are the values at the ranks ceil(i x n / steps), i = 1 .. steps, all values where n <= steps. err bounds the error of a rank read from it, in rows:
    0 for n <= steps, else n / steps. Add the day to ``keys`` to get one per day; :func:`merged_summaries` combines any of them.
    """
    if SCALE % steps:
        raise ValueError(f"steps must divide {SCALE}")
    df, named, keys = _own_names(df, keys, value)
    groups, _, seed = _groups(df, keys)
    rows = df.select(_hash(keys, seed).alias("g"), "_v")
    large = staged(groups.where(F.col("n") > steps), "large-groups")
    small = rows.join(hinted(large.select("g")), "g", "left_anti").groupBy("g").agg(F.sort_array(F.collect_list("_v")).alias("all"))  # at most ``steps`` values each
    points = F.transform("all", lambda v: F.struct(v.alias("v"), F.lit(1).cast("long").alias("w")))
    out = groups.where(F.col("n") <= steps).join(small, "g").select(*named, "n", F.lit(0).cast("long").alias("err"), points.alias("points"))
    total = large.count()
    if total:
        ranks = [i * (SCALE // steps) for i in range(1, steps + 1)]
        own = rows.join(hinted(large.select("g")), "g", "left_semi")
        found = select_ranks(own, large, total, ranks)
        rank = lambda i: F.when(i > 0, rank_of(F.col("n"), i * (SCALE // steps))).otherwise(0)
        at = F.transform("found", lambda v, i: F.struct(v.alias("v"), (rank(i + 1) - rank(i)).alias("w")))
        out = out.unionByName(large.join(found, "g").select(*named, "n", F.ceil(F.col("n") / steps).cast("long").alias("err"), at.alias("points")))
    return out


def _levelled(parts: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """``parts`` until no group has more than ``FAN`` of them; FAN at a time become one, cut to 4 x steps points."""
    own = [f"_k{i}" for i in range(len(keys))]
    parts = parts.select(*(F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)), "n", "err", "points")
    while True:
        parts = staged(parts, "summaries")
        most = parts.groupBy(*own).count().agg(F.max("count")).first()[0] or 0
        if most <= FAN:
            return parts.select(*(F.col(o).alias(k) for k, o in zip(keys, own)), "n", "err", "points")
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(-(-most // FAN)))
        parts = _cut(_concatenated(parts.withColumn("_salt", salt), [*own, "_salt"]).drop("_salt"), 4 * steps)


def _concatenated(parts: DataFrame, keys: list[str]) -> DataFrame:
    points = F.sort_array(F.flatten(F.collect_list("points")))
    return parts.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.sum("n").alias("n"), F.sum("err").alias("err"), points.alias("points"))


def _cut(summary: DataFrame, most: int) -> DataFrame:
    """Summaries of more than ``most`` points cut to ``most``, at the ranks i x n / most, which adds n / most to err."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, n, err = batch.column("points"), batch.column("n").to_pylist(), batch.column("err").to_pylist()
            out = []
            for r in range(batch.num_rows):
                v, w = (np.asarray(points[r].values.field(i)) for i in (0, 1))
                if len(v) > most:
                    targets = -(-np.arange(1, most + 1) * n[r] // most)
                    v, w = v[np.searchsorted(np.cumsum(w), targets)], np.diff(targets, prepend=0)
                    err[r] += -(-n[r] // most)
                out.append(pa.StructArray.from_arrays([pa.array(v), pa.array(w, pa.int64())], ["v", "w"]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.concat_arrays(out))
            columns = {"points": lists, "err": pa.array(err, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return summary.mapInArrow(cut, summary.schema)


def merged_summaries(parts: DataFrame, keys: list[str], steps: int = 400) -> DataFrame:
    """Summaries (keys, n, err, points) of the union of what the summaries ``parts`` stand for, which merge again like any others.

    At most 4 x steps points each; err is the sum of the parts' bounds and n / (4 x steps) for each cut (one, and one more for every FAN-fold number of parts).
    """
    return _cut(_concatenated(_levelled(parts, keys, steps), keys), 4 * steps)


def read_quantiles(summary: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """``summary`` with a column for each of ``wanted`` in place of its points."""

    def at(p: int) -> Column:
        k = rank_of(F.col("n"), p)
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("double").alias("v"))
        return F.aggregate("points", start, lambda a, x: F.struct((a["sum"] + x["w"]).alias("sum"), F.coalesce(a["v"], F.when(a["sum"] + x["w"] >= k, x["v"])).alias("v")))["v"]

    return summary.select("*", *(at(p).alias(c) for c, p in wanted.items())).drop("points")


def merged(parts: DataFrame, keys: list[str], wanted: dict[str, int]) -> DataFrame:
    """Quantiles of the union of what the summaries ``parts`` stand for: keys, n, and a column for each of ``wanted``; the rank error is below the sum of the
    parts' err (and n / 1,600 for every FAN-fold number of parts)."""
    return read_quantiles(_concatenated(_levelled(parts, keys, 400), keys), wanted).drop("err")
