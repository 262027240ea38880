"""Transcript clusters of a gene: a Bayesian mixture over junction counts whose clusters are sets of junctions without conflicts.

All genes are fitted together, by coordinate ascent in rounds of Spark jobs. The counts lie in blocks of a gene's samples, at most about ``ENTRIES`` counts each. In a
round every block gets its gene's cluster weights and settles the mixtures of its samples by itself; the expected counts of the blocks are added up by gene; and the
masks and weights of the gene's clusters follow from the sums. Only sums and weights (clusters x junctions of a gene) move in a round. A gene that lies whole in one
block needs no other's sums, so it goes through up to ``ALONE`` sweeps in a round. Genes that have settled leave the rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceframe.functions.special import digamma, gammaln
from spliceframe.session import discard, small_enough, staged

EPS = 1e-10
#: rounds at most
SWEEPS = 10_000
#: a gene has settled when its bound moves by less than this share of itself in a round
TOLERANCE = 1e-6
#: counts of a block
ENTRIES = 20_000
#: sweeps a round of a gene in one block
ALONE = 250
LOCAL_SWEEPS = 50
#: the same from mixtures that settled in the sweep before
WARM_SWEEPS = 3
LOCAL_TOLERANCE = 1e-4
ALPHA, ETA, R, S = 1.0, 0.01, 1.0, 1.0
BY_SAMPLE = "gene_id string, sample_id string, k int, node_id int, member boolean, expected_count double"
RESULT = "gene_id string, k int, node_id int, member boolean, share double, expected_count double, iterations int, converged boolean, elbo double"


def heaviest_sets(weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row of weights the mask of the independent set of intervals with the greatest sum of positive weights (touching ends may
    both be in). Walks the intervals by end, all rows at once."""
    order = np.argsort(ends, kind="stable")
    w, s, e = weights[:, order], starts[order], ends[order]
    before = np.minimum(np.searchsorted(e, s, "right"), np.arange(len(s)))
    rows, n = w.shape
    best = np.zeros((rows, n + 1))
    for i in range(n):
        best[:, i + 1] = np.maximum(best[:, i], best[:, before[i]] + np.maximum(w[:, i], 0))
    mask = np.zeros(w.shape, bool)
    at = np.full(rows, n)
    for i in range(n, 0, -1):
        taken = (at == i) & (best[:, i] > best[:, i - 1])
        mask[taken, order[i - 1]] = True
        at = np.where(taken, before[i - 1], np.where(at == i, i - 1, at))
    return mask


def initial_sets(starts: np.ndarray, ends: np.ndarray, k: int, rng: np.random.Generator, anchors: int = 3) -> np.ndarray:
    """k independent sets as masks: a largest one, then for each other one a largest one that holds up to ``anchors`` random nodes of the first."""
    first = heaviest_sets(np.ones((1, len(starts))), starts, ends)[0]
    inside = np.flatnonzero(first)
    weights = rng.random((k, len(starts))) * 0.5 + 0.75
    for row in weights[1:]:
        chosen = rng.choice(inside, min(len(inside), int(rng.integers(1, anchors + 1))), replace=False)
        barred = ((ends[None] > starts[chosen][:, None]) & (starts[None] < ends[chosen][:, None])).any(0)
        row[barred] = -1
        row[chosen] = 1
    out = heaviest_sets(weights, starts, ends)
    out[0] = first
    return out


_STATE = "gene_id string, k int, ids array<int>, starts array<int>, ends array<int>, zeta array<double>, logits array<double>, b array<double>, stats array<double>, elbo double, iterations int, converged boolean"
_ARRAYS = {"ids": pa.int32(), "starts": pa.int32(), "ends": pa.int32(), "zeta": pa.float64(), "logits": pa.float64(), "b": pa.float64(), "stats": pa.float64()}


def _list(batch: pa.RecordBatch, name: str, r: int) -> np.ndarray:
    return np.asarray(batch.column(name)[r].values)


def _state_row(gene: str, k: int, elbo: float | None, iterations: int, converged: bool, **arrays: np.ndarray) -> pa.RecordBatch:
    head = {"gene_id": pa.array([gene], pa.string()), "k": pa.array([k], pa.int32())}
    tail = {"elbo": pa.array([elbo], pa.float64()), "iterations": pa.array([iterations], pa.int32()), "converged": pa.array([converged])}
    return pa.RecordBatch.from_pydict(head | {c: pa.array([np.ravel(arrays[c])], pa.list_(t)) for c, t in _ARRAYS.items()} | tail)


def _log_beta(zeta: np.ndarray) -> np.ndarray:
    return digamma(zeta) - digamma(zeta.sum(1, keepdims=True))


def _begin(seed: int):
    """The clusters before the first round: independent sets, and weights by chance that favour them."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                gene, k = batch.column("gene_id")[r].as_py(), batch.column("clique_number")[r].as_py()
                ids, starts, ends = (np.asarray(batch.column("of")[r].values.field(i)) for i in range(3))
                rng = np.random.default_rng(zlib.crc32(f"{seed}/{gene}".encode()))
                b = initial_sets(starts, ends, k, rng).astype(float)
                none = np.zeros((k, len(ids)))
                yield _state_row(gene, k, None, 0, False, ids=ids, starts=starts, ends=ends, zeta=rng.gamma(1.0, 1.0, b.shape) + b, logits=none, b=b, stats=none)

    return begin


def _block(batch: pa.RecordBatch, r: int) -> dict:
    """The block in row r with the state of its gene."""
    k, ids, d = batch.column("k")[r].as_py(), _list(batch, "ids", r), _list(batch, "d", r)
    count = _list(batch, "count", r)
    totals = np.bincount(d, weights=count)
    own = {c: _list(batch, c, r).reshape(k, -1) for c in ("zeta", "logits", "b") if c in batch.schema.names}
    return own | {"k": k, "ids": ids, "d": d, "v": np.searchsorted(ids, _list(batch, "v", r)), "count": count, "totals": totals, "gamma": np.repeat(ALPHA + totals / k, k)}


class _Blocks:
    """Blocks as one ragged problem: a cell for each (sample, cluster) and (cluster, node) of a block, a pair for each (count, cluster)."""

    def __init__(self, blocks: list[dict]):
        self.blocks = blocks
        theta, beta, of_count, of_sample, row_of_pair, row_of_sample = ([] for _ in range(6))
        t = b = 0
        for r, x in enumerate(blocks):
            k, n, d, samples, each = x["k"], len(x["ids"]), x["d"], len(x["totals"]), np.arange(x["k"])
            theta.append((t + d[:, None] * k + each).ravel())
            beta.append((b + each * n + x["v"][:, None]).ravel())
            of_count.append(np.full(len(d), k))
            of_sample.append(np.full(samples, k))
            row_of_pair.append(np.full(len(d) * k, r))
            row_of_sample.append(np.full(samples, r))
            t, b = t + samples * k, b + k * n
        self.cells = b
        join = np.concatenate
        self.theta, self.beta, self.k_of_count, self.k_of_sample = join(theta), join(beta), join(of_count), join(of_sample)
        self.row_of_pair, self.row_of_sample = join(row_of_pair), join(row_of_sample)
        self.counts, self.totals = (join([x[c] for x in blocks]) for c in ("count", "totals"))
        self.log_beta = join([_log_beta(x["zeta"]).ravel() for x in blocks])
        self.count_at = np.cumsum(self.k_of_count) - self.k_of_count
        self.sample_at = np.cumsum(self.k_of_sample) - self.k_of_sample

    def settle(self, most: int = LOCAL_SWEEPS) -> None:
        """Shares of the pairs and mixtures of the samples, until no sample's mixture moves by more than LOCAL_TOLERANCE of its reads, ``most`` times at most."""
        weight = np.repeat(self.counts, self.k_of_count)
        gamma = np.concatenate([x["gamma"] for x in self.blocks])
        for _ in range(most):
            log_theta = digamma(gamma) - np.repeat(digamma(np.add.reduceat(gamma, self.sample_at)), self.k_of_sample)
            logp = log_theta[self.theta] + self.log_beta[self.beta]
            top = np.maximum.reduceat(logp, self.count_at)
            p = np.exp(logp - np.repeat(top, self.k_of_count))
            total = np.add.reduceat(p, self.count_at)
            self.expected = weight * p / np.repeat(total, self.k_of_count)
            after = ALPHA + np.bincount(self.theta, weights=self.expected, minlength=len(gamma))
            moved = np.add.reduceat(np.abs(after - gamma), self.sample_at) / self.totals
            gamma = after
            if moved.max() < LOCAL_TOLERANCE:
                break
        for x, own in zip(self.blocks, np.split(gamma, np.cumsum([len(x["gamma"]) for x in self.blocks])[:-1])):
            x["gamma"] = own  # where the next sweep goes on
        n = len(self.blocks)
        by_count = self.counts * (np.log(total) + top)
        row_of_count = self.row_of_pair[self.count_at]
        fit = np.bincount(row_of_count, weights=by_count, minlength=n) - np.bincount(self.row_of_pair, weights=self.expected * log_theta[self.theta], minlength=n)
        mixture = np.add.reduceat(gammaln(gamma), self.sample_at) - gammaln(np.add.reduceat(gamma, self.sample_at))
        self.fit = fit + np.bincount(self.row_of_sample, weights=mixture, minlength=n)

    def sums(self) -> list[np.ndarray]:
        """Expected counts of each block's clusters at its gene's nodes."""
        cells = np.bincount(self.beta, weights=self.expected, minlength=self.cells)
        ends = np.cumsum([x["zeta"].size for x in self.blocks])
        return [c.reshape(x["zeta"].shape) for x, c in zip(self.blocks, np.split(cells, ends[:-1]))]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            blocks = _Blocks([_block(batch, r) for r in range(batch.num_rows)])
            blocks.settle()
            yield pa.RecordBatch.from_arrays([batch.column("gene_id"), pa.array([x.ravel() for x in blocks.sums()], pa.list_(pa.float64())), pa.array(blocks.fit)], ["gene_id", "sums", "fit"])


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, fit = None, 0.0
    for batch in batches:
        for r in range(batch.num_rows):
            own = _list(batch, "sums", r)
            sums = own.copy() if sums is None else sums + own
            fit += batch.column("fit")[r].as_py()
    yield pa.RecordBatch.from_pydict({"gene_id": pa.array([key[0].as_py()], pa.string()), "sums": pa.array([sums], pa.list_(pa.float64())), "fit": pa.array([fit], pa.float64())})


_added.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


def _global(x: dict, sums: np.ndarray, fit: float, starts: np.ndarray, ends: np.ndarray, last: float | None, tolerance: float) -> tuple[float, bool]:
    """(bound of the sweep, whether the gene has settled); unless it has, the masks, their prior and the node weights in ``x`` move to what follows from the sums."""
    zeta, b = x["zeta"], x["b"]
    log_beta = _log_beta(zeta)
    beta = ((ETA * b - zeta) * log_beta).sum() + (gammaln(zeta).sum(1) - gammaln(zeta.sum(1))).sum()
    p = np.clip(b, EPS, 1 - EPS)
    elbo = fit + float(beta - (p * np.log(p) + (1 - p) * np.log(1 - p)).sum())
    if last is not None and abs(elbo - last) < tolerance * max(1.0, abs(elbo)):
        return elbo, True
    on, off = R + b.sum(1), np.maximum(S + b.shape[1] - b.sum(1), EPS)
    wanted = (digamma(on) - digamma(off))[:, None] + log_beta + np.log(b.shape[1])  # against an even share
    x["logits"] = 0.7 * x["logits"] + 0.3 * np.clip(wanted, -50, 50)
    x["b"] = np.where(heaviest_sets(x["logits"], starts, ends), 1 / (1 + np.exp(-x["logits"])), EPS)
    x["zeta"] = np.maximum(ETA * x["b"] + sums, EPS)
    return elbo, False


def _moved(tolerance: float):
    """The state of genes in several blocks after a sweep."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                k, ids, starts, ends = batch.column("k")[r].as_py(), *(_list(batch, c, r) for c in ("ids", "starts", "ends"))
                x = {c: _list(batch, c, r).reshape(k, -1) for c in ("zeta", "logits", "b")}
                sums = _list(batch, "sums", r).reshape(k, -1)
                elbo, done = _global(x, sums, batch.column("fit")[r].as_py(), starts, ends, batch.column("elbo")[r].as_py(), tolerance)
                yield _state_row(batch.column("gene_id")[r].as_py(), k, elbo, batch.column("iterations")[r].as_py() + 1, done, ids=ids, starts=starts, ends=ends, stats=sums, **x)

    return step


def _alone(tolerance: float, iterations: int):
    """The state of genes in one block after up to ALONE sweeps."""

    def sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            blocks = [_block(batch, r) for r in range(n)]
            spans = [[_list(batch, c, r) for c in ("starts", "ends")] for r in range(n)]
            elbo, made = batch.column("elbo").to_pylist(), batch.column("iterations").to_pylist()
            done, sums = [False] * n, [None] * n
            for sweep in range(ALONE):
                open_ = [r for r in range(n) if not done[r] and made[r] < iterations]
                if not open_:
                    break
                together = _Blocks([blocks[r] for r in open_])
                together.settle(WARM_SWEEPS if sweep else LOCAL_SWEEPS)
                for r, own, fit in zip(open_, together.sums(), together.fit.tolist()):
                    sums[r], made[r] = own, made[r] + 1
                    elbo[r], done[r] = _global(blocks[r], own, fit, *spans[r], elbo[r], tolerance)
            for r, x in enumerate(blocks):
                yield _state_row(batch.column("gene_id")[r].as_py(), x["k"], elbo[r], made[r], done[r], ids=x["ids"], starts=spans[r][0], ends=spans[r][1], stats=sums[r], **{c: x[c] for c in ("zeta", "logits", "b")})

    return sweeps


def _entries(rows: DataFrame) -> DataFrame:
    """Staged blocks (gene_id, block, blocks, samples, d, v, count): d numbers the samples of a block, v is the node, blocks are those of the gene."""
    sizes = rows.groupBy("gene_id").agg(F.ceil(F.count(F.lit(1)) / ENTRIES).alias("blocks"))
    block = F.pmod(F.xxhash64("sample_id"), F.col("blocks"))
    of = F.sort_array(F.collect_list(F.struct("sample_id", "node_id", F.col("count").cast("double").alias("count"))))
    packed = rows.join(sizes, "gene_id").groupBy("gene_id", block.alias("block"), "blocks").agg(of.alias("of"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                of = batch.column("of")[r].values
                coded = of.field(0).dictionary_encode()
                lists = [pa.array([x], pa.list_(t)) for x, t in ((coded.dictionary.to_pylist(), pa.string()), (coded.indices, pa.int32()), (of.field(1), pa.int32()), (of.field(2), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1) for c in ("gene_id", "block", "blocks")), *lists], ["gene_id", "block", "blocks", "samples", "d", "v", "count"])

    return staged(packed.mapInArrow(numbered, "gene_id string, block long, blocks long, samples array<string>, d array<int>, v array<int>, count array<double>"), "entries")


def inferred(matrix: DataFrame, nodes: DataFrame, cliques: DataFrame, iterations: int = SWEEPS, seed: int = 2021, by_sample: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """A row per gene, cluster and node (see RESULT) for the genes with a conflict (clique number 2 or more) and counts; as many clusters as the clique number.

    member: the node is in the cluster's transcript, whose nodes never conflict. The seed and the gene fix the result. Rows with a null sample or without a positive count are
    left out. ``iterations`` is a bound: converged says whether the gene settled before it. Settled: the bound moved by less than ``tolerance`` of itself; an absolute
    measure would get stricter with every read and end below the rounding of the sum.
    by_sample: the expected reads of each sample, cluster and node with counts in its place (see BY_SAMPLE).
    """
    genes = cliques.where(F.col("clique_number") >= 2).select("gene_id", F.col("clique_number").cast("int").alias("clique_number"))
    rows = matrix.where(F.col("sample_id").isNotNull() & (F.col("count") > 0)).join(nodes.select("gene_id", "node_id", "jx_start", "jx_end"), ["gene_id", "node_id"]).join(genes, "gene_id")
    rows = staged(rows.select("gene_id", "clique_number", "sample_id", F.col("node_id").cast("int").alias("node_id"), F.col("jx_start").cast("int").alias("s"), F.col("jx_end").cast("int").alias("e"), "count"), "counts")
    entries = _entries(rows)
    of = rows.groupBy("gene_id", "clique_number").agg(F.sort_array(F.collect_set(F.struct("node_id", "s", "e"))).alias("of"))
    # spread by a set number: the rows are few, so they would be coalesced, but the work on each gene is long
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    state = staged(of.repartition(tasks, "gene_id").mapInArrow(_begin(seed), _STATE), "state")
    hint = F.broadcast if small_enough(state.select("gene_id", "ids", "zeta", "logits", "b")) else (lambda df: df)
    one, many = entries.where(F.col("blocks") == 1), entries.where(F.col("blocks") > 1)
    several = not many.isEmpty()
    open_ = ~F.col("converged") & (F.col("iterations") < iterations)
    while not state.where(open_).isEmpty():
        active = state.where(open_)
        after = one.join(hint(active), "gene_id").repartition(tasks, "gene_id").mapInArrow(_alone(tolerance, iterations), _STATE)
        if several:
            sums = many.join(hint(active.select("gene_id", "k", "ids", "zeta")), "gene_id").repartition(tasks, "gene_id", "block").mapInArrow(_local, "gene_id string, sums array<double>, fit double")
            sums = sums.groupBy("gene_id").applyInArrow(_added, "gene_id string, sums array<double>, fit double")
            after = after.unionByName(sums.join(hint(active), "gene_id").mapInArrow(_moved(tolerance), _STATE))
        after = staged(state.where(~open_).unionByName(after), "state")
        discard(state)
        state = after
    discard(rows)
    return _by_sample(entries, state) if by_sample else _by_node(state)


def _by_node(state: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                k, ids = batch.column("k")[r].as_py(), _list(batch, "ids", r)
                zeta, b, sums = (_list(batch, c, r).reshape(k, -1) for c in ("zeta", "b", "stats"))
                n = k * len(ids)
                one = lambda c: np.full(n, batch.column(c)[r].as_py())
                columns = {"gene_id": pa.array([batch.column("gene_id")[r].as_py()] * n, pa.string()), "k": pa.array(np.repeat(np.arange(k, dtype=np.int32), len(ids))), "node_id": pa.array(np.tile(ids, k)), "member": pa.array((b > 0.5).ravel())}
                columns |= {"share": pa.array((zeta / zeta.sum(1, keepdims=True)).ravel()), "expected_count": pa.array(sums.ravel()), "iterations": pa.array(one("iterations"), pa.int32()), "converged": pa.array(one("converged"), pa.bool_()), "elbo": pa.array(one("elbo").astype(float))}
                yield pa.RecordBatch.from_pydict(columns)

    return state.mapInArrow(rows, RESULT)


def _by_sample(entries: DataFrame, state: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = _Blocks([_block(batch, r) for r in range(batch.num_rows)])
            blocks.settle()
            for r, x in enumerate(blocks.blocks):
                k, d, v = x["k"], x["d"], x["v"]
                ids, member, samples = _list(batch, "ids", r), _list(batch, "b", r).reshape(k, -1) > 0.5, batch.column("samples")[r].values
                expected = blocks.expected[blocks.row_of_pair == r].reshape(-1, k)
                i, c = np.nonzero(expected > EPS)
                columns = [pa.array([batch.column("gene_id")[r].as_py()] * len(i), pa.string()), samples.take(pa.array(d[i])), pa.array(c.astype(np.int32)), pa.array(ids[v[i]]), pa.array(member[c, v[i]]), pa.array(expected[i, c])]
                yield pa.RecordBatch.from_arrays(columns, ["gene_id", "sample_id", "k", "node_id", "member", "expected_count"])

    return entries.join(state.select("gene_id", "k", "ids", "zeta", "b"), "gene_id").mapInArrow(rows, BY_SAMPLE)


def sample_counts(by_sample: DataFrame) -> DataFrame:
    """(gene_id, k, sample_id, member_count, all_count): expected reads of each transcript and sample, at its members and at all nodes."""
    members = F.sum(F.when(F.col("member"), F.col("expected_count")).otherwise(0))
    return by_sample.groupBy("gene_id", "k", "sample_id").agg(members.alias("member_count"), F.sum("expected_count").alias("all_count"))


def merged_clusters(result: DataFrame) -> DataFrame:
    """(gene_id, members, clusters, expected_count): clusters of a gene with the same members as one, their expected counts summed."""
    sets = result.groupBy("gene_id", "k").agg(F.sort_array(F.collect_set(F.when(F.col("member"), F.col("node_id")))).alias("members"), F.sum("expected_count").alias("c"))
    return sets.groupBy("gene_id", "members").agg(F.count(F.lit(1)).alias("clusters"), F.sum("c").alias("expected_count"))
