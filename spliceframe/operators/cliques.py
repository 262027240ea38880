"""Exact cliques and covers of conflict graphs whose nodes may have several segments (paths of long reads)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceframe.session import staged

STEPS = 1_000_000


class Conflicts:
    """Neighbours of each node as a bit set, made when they are asked for: some segment of one overlaps some of the other (touching ends don't)."""

    def __init__(self, segments: list[np.ndarray]) -> None:
        n = len(segments)
        owner = np.repeat(np.arange(n), [len(s) for s in segments])
        rows = np.concatenate([np.zeros((0, 2), np.int64), *segments])
        owner, rows = owner[some := rows[:, 1] > rows[:, 0]], rows[some]
        each, at = np.unique(rows, axis=0, return_inverse=True)
        at = at.ravel()
        order = np.argsort(at, kind="stable")
        holders = []
        for own in np.split(owner[order], np.cumsum(np.bincount(at, minlength=len(each)))[:-1]) if len(each) else []:
            bits = np.zeros(n, bool)
            bits[own] = True
            holders.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"))
        self.over = []
        for a, b in each:
            bits = 0
            for u in np.flatnonzero((each[:, 1] > a) & (each[:, 0] < b)):
                bits |= holders[u]
            self.over.append(bits)
        self.at = np.split(at, np.searchsorted(owner, np.arange(1, n)))[:n]

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, v: int) -> int:
        bits = 1 << v
        for i in self.at[v].tolist():
            bits |= self.over[i]
        return bits ^ 1 << v

    def __iter__(self) -> Iterator[int]:
        return (self[v] for v in range(len(self)))


def conflicts(segments: list[np.ndarray]) -> list[int]:
    """Neighbours of each node as a bit set."""
    return list(Conflicts(segments))


def _coloured(candidates: int, neighbours: Sequence[int], least: int = 0) -> tuple[list[int], list[int]]:
    """The candidates by colour of a greedy colouring, and the colours, which bound a clique among a candidate and those before it; only colours above ``least``."""
    order, colours, colour = [], [], 0
    while candidates:
        colour += 1
        free = candidates
        while free:
            low = free & -free
            v = low.bit_length() - 1
            if colour > least:
                order.append(v)
                colours.append(colour)
            candidates ^= low
            free = (free ^ low) & ~neighbours[v]
    return order, colours


def deepest(segments: list[np.ndarray]) -> int:
    """The most nodes over one base; they all conflict."""
    events = []
    for own in segments:
        end = None
        for a, b in sorted((int(a), int(b)) for a, b in own if b > a):
            if end is None or a > end:
                if end is not None:
                    events.append((end, -1))
                events.append((a, 1))
                end = b
            end = max(end, b)
        if end is not None:
            events.append((end, -1))
    return int(np.cumsum([0, *(x for _, x in sorted(events))]).max())


def _search(candidates: int, size: int, neighbours: Sequence[int], best: int, steps: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(best, steps left, open branches): the cliques of ``candidates`` beside ``size`` nodes that all neighbour them, if larger than ``best``, by branch and
    bound with the colours of a greedy colouring. After ``steps`` coloured nodes what isn't searched is given as branches (candidates, size)."""
    left = steps
    stack = [[*_coloured(candidates, neighbours, best - size), candidates, size]]
    while stack and left > 0:
        order, colours, candidates, size = stack[-1]
        if not order or size + colours[-1] <= best:
            stack.pop()
            continue
        v = order.pop()
        colours.pop()
        stack[-1][2] = candidates & ~(1 << v)
        best = max(best, size + 1)
        inner = candidates & neighbours[v]
        if inner:
            stack.append([*_coloured(inner, neighbours, best - size - 1), inner, size + 1])
            left -= inner.bit_count()
    return best, left, [(candidates, size) for order, colours, candidates, size in stack if order and size + colours[-1] > best]


def _unbounded(branches: list[tuple[int, int]], best: int) -> list[tuple[int, int]]:
    return [(c, size) for c, size in branches if c.bit_count() + size > best]


def largest_clique(neighbours: list[int], steps: int = STEPS) -> tuple[int, bool]:
    """(size, exact) of a largest clique; after ``steps`` coloured nodes the best so far is given as not exact unless nothing is open."""
    best, _, branches = _search((1 << len(neighbours)) - 1, 0, neighbours, 0, steps)
    return best, not branches


def components(segments: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The nodes by connected component of their conflict graph, largest first; nodes without bases are left out."""
    rows = [(int(a), int(b), v) for v, own in enumerate(segments) for a, b in own if b > a]
    above = list(range(len(segments)))

    def top(v: int) -> int:
        while above[v] != v:
            above[v] = v = above[above[v]]
        return v

    end, last = None, 0
    for a, b, v in sorted(rows):
        if end is not None and a < end:
            above[top(v)] = top(last)
        end, last = b if end is None else max(end, b), v
    out: dict[int, list[np.ndarray]] = {}
    for v in sorted({v for _, _, v in rows}):
        out.setdefault(top(v), []).append(segments[v])
    return sorted(out.values(), key=len, reverse=True)


def _core(segments: list[np.ndarray], best: int) -> tuple[list[np.ndarray], int]:
    """(nodes, edges): the nodes left when those with too few neighbours for a clique above ``best`` are taken out, again until few are, those with most
    neighbours first; and the edges of all nodes."""
    edges = None
    while True:
        degrees = np.array([g.bit_count() for g in Conflicts(segments)], np.int64)
        edges = int(degrees.sum()) // 2 if edges is None else edges
        kept = np.flatnonzero(degrees >= best)
        few = len(segments) - len(kept) <= len(segments) // 100
        kept = kept[np.argsort(-degrees[kept], kind="stable")]
        segments = [segments[v] for v in kept]
        if few:
            return segments, edges


def _ordered(segments: list[np.ndarray], best: int) -> tuple[int, list[np.ndarray]]:
    """(colours, nodes): the nodes in the order, as given or by their last base, whose greedy colouring takes fewer colours; no nodes if ``best`` colours do."""
    least = 0, []
    for own in (segments, sorted(segments, key=lambda s: -s[:, 1].max())):
        colours = _coloured((1 << len(own)) - 1, Conflicts(own), best)[1]
        if not colours:
            return best, []
        if not least[1] or colours[-1] < least[0]:
            least = colours[-1], own
    return least


def extended(segments: list[np.ndarray], neighbours: Sequence[int], best: int, bound: int) -> int:
    """The size of the largest of these cliques if it is above ``best``: the nodes over one base and, one by one, the node with most neighbours among those
    that neighbour all. No clique is above ``bound``."""
    owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
    rows = np.concatenate([np.zeros((0, 2), np.int64), *segments])
    over = [np.unique(owner[(rows[:, 0] <= p) & (rows[:, 1] > p)]).tolist() for p in np.unique(rows[:, 0])]
    for own in sorted(over, key=len, reverse=True):
        common, size = (1 << len(segments)) - 1, len(own)
        for v in own:
            common &= neighbours[v]
        while common and size + common.bit_count() > best:
            common &= neighbours[max(_members(common), key=lambda v: (common & neighbours[v]).bit_count())]
            size += 1
        best = max(best, size)
        if best >= bound:
            break
    return best


def _members(bits: int) -> list[int]:
    own = np.frombuffer(_bytes(bits), np.uint8)
    return np.flatnonzero(np.unpackbits(own, bitorder="little")).tolist()


def _bytes(bits: int) -> bytes:
    return bits.to_bytes((bits.bit_length() + 7) // 8, "little")


_BRANCHES = pa.list_(pa.struct([("candidates", pa.binary()), ("size", pa.int32())]))
_OPEN = pa.list_(pa.struct([("graph", pa.list_(pa.binary())), ("branches", _BRANCHES)]))


def _rows(branches: list[tuple[int, int]]) -> list[dict]:
    return [{"candidates": _bytes(c), "size": n} for c, n in branches]


def path_cliques(nodes: DataFrame, group: str, steps: int = STEPS) -> DataFrame:
    """(group, nodes, edges, clique_number, exact) of nodes (group, chrom, segments array<struct<jx_start, jx_end>>); nodes of different chromosomes never conflict.

    The conflict graph of a group and chromosome is built by one task. By connected component, it is cut to the nodes with neighbours enough for a clique
    above the best known, and left if as few colours do; else cliques are sought around each base, then it is searched for ``steps`` coloured nodes. What is
    open then is searched by tasks of their own, in rounds, until nothing is. exact is always true.
    """

    def solve(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: list[np.ndarray] = []
        for batch in batches:
            column = batch.column("segments")
            ends = np.column_stack([column.flatten().field(x).cast(pa.int64()).to_numpy() for x in ("jx_start", "jx_end")])
            segments += np.split(ends, np.cumsum(column.value_lengths().to_numpy())[:-1])[: len(column)]
        segments.sort(key=lambda x: x.tolist())
        best, edges, left = max(1, deepest(segments)), 0, []
        for part in components(segments):
            kept, n = _core(part, best)
            edges += n
            bound, own = _ordered(kept, best)
            if own:
                best = extended(own, graph := conflicts(own), best, bound)
                best, _, branches = _search((1 << len(own)) - 1, 0, graph, best, steps)
                left.append((own, branches))
        left = [(own, some) for own, branches in left if (some := _unbounded(branches, best))]
        still = [{"graph": [x.tobytes() for x in own], "branches": _rows(branches)} for own, branches in left]
        yield pa.RecordBatch.from_pydict({"g": pa.array([key[0].as_py()], pa.string()), "chrom": pa.array([key[1].as_py()], pa.string()), "nodes": pa.array([len(segments)], pa.int64()), "edges": pa.array([edges], pa.int64()), "clique_number": pa.array([best], pa.int64()), "open": pa.array([still], _OPEN)})

    solve.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    tasks = 4 * nodes.sparkSession.sparkContext.defaultParallelism
    rows = nodes.select(F.col(group).alias("g"), "chrom", "segments").repartition(tasks, "g", "chrom")
    out = staged(rows.groupBy("g", "chrom").applyInArrow(solve, "g string, chrom string, nodes long, edges long, clique_number long, open array<struct<graph:array<binary>,branches:array<struct<candidates:binary,size:int>>>>"), "cliques")
    graphs = out.select("g", "clique_number", F.posexplode("open").alias("at", "x"), "chrom").select("g", "clique_number", F.concat_ws(":", "at", "chrom").alias("part"), "x")
    branches = graphs.select("g", "part", "clique_number", F.explode("x.branches").alias("b"))
    found = out.select("g", "clique_number")
    if not branches.isEmpty():
        graphs = staged(graphs.select("g", "part", "x.graph"), "graphs")
        found = _finished(graphs, branches, found, tasks, steps)
    best = found.groupBy(F.col("g").alias("_g")).agg(F.max("clique_number").alias("clique_number"))
    sums = out.groupBy("g").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))
    done = sums.join(best, F.col("g").eqNullSafe(F.col("_g")))
    return done.select(F.col("g").alias(group), "nodes", "edges", "clique_number", F.lit(True).alias("exact"))


def _finished(graphs: DataFrame, branches: DataFrame, found: DataFrame, tasks: int, steps: int) -> DataFrame:
    """``found`` (g, clique_number) with the sizes that the open branches (g, part, clique_number: best so far, b) of the graphs (g, part, graph) lead to.

    In a round the branches of a graph are dealt to ``tasks`` bundles, each of which is searched for ``steps`` coloured nodes.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                graph = conflicts([np.frombuffer(x, np.int64).reshape(-1, 2) for x in row["graph"]])
                best, left, still = row["clique_number"], steps, []
                for b in row["of"]:
                    c, size = int.from_bytes(b["candidates"], "little"), b["size"]
                    if left > 0:
                        best, left, more = _search(c, size, graph, best, left)
                        still += more
                    else:
                        still.append((c, size))
                still = _unbounded(still, best)
                yield pa.RecordBatch.from_pydict({"g": pa.array([row["g"]], pa.string()), "part": pa.array([row["part"]], pa.string()), "clique_number": pa.array([best], pa.int64()), "branches": pa.array([_rows(still)], _BRANCHES)})

    while not branches.isEmpty():
        dealt = branches.withColumn("_bundle", F.pmod(F.xxhash64("b.candidates", "b.size"), F.lit(tasks)))
        bundles = dealt.groupBy("g", "part", "_bundle").agg(F.max("clique_number").alias("clique_number"), F.collect_list("b").alias("of"))
        own = graphs.select(F.col("g").alias("_g"), F.col("part").alias("_part"), "graph")
        met = bundles.join(own, F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part"))).select("g", "part", "clique_number", "of", "graph")
        after = staged(met.repartition(tasks).mapInArrow(search, "g string, part string, clique_number long, branches array<struct<candidates:binary,size:int>>"), "searched")
        found = found.unionByName(after.select("g", "clique_number"))
        best = found.groupBy(F.col("g").alias("_g")).agg(F.max("clique_number").alias("clique_number"))
        branches = after.select("g", "part", F.explode("branches").alias("b")).join(best, F.col("g").eqNullSafe(F.col("_g"))).select("g", "part", "clique_number", "b")
    return found


def path_nodes(chains: DataFrame, group: str, least: int = 1) -> DataFrame:
    """(group, chrom, segments): the junctions of the reads' chains as nodes of one segment, and each chain of two junctions or more that
    ``least`` reads show as a node of several."""
    paths = chains.groupBy(group, "chrom", "j").agg(F.count(F.lit(1)).alias("n"))
    several = F.array_repeat("j", F.when((F.size("j") >= 2) & (F.col("n") >= least), 1).otherwise(0))
    return paths.select(group, "chrom", F.explode(F.concat(F.transform("j", lambda x: F.array(x)), several)).alias("segments")).distinct()
