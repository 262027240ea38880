"""Joins and sweeps over intervals of integer coordinates.

Range conditions get a bin as an equality key, so that they run as hash joins; each operator counts a pair in one bin only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(c: Column, width: int) -> Column:
    return F.floor(c / width).cast("int")


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(_bin(start, width), _bin(end, width))


def containment_join(items: DataFrame, genes: DataFrame, width: int = 1_000_000, chrom: str = "chrom", start: str = "jx_start", end: str = "jx_end") -> DataFrame:
    """Every item with each gene of its chromosome that contains it: columns of ``items`` and gene_id. An item in no gene gives no row."""
    g = genes.select("gene_id", F.col("chrom").alias("_chrom"), "g_start", "g_end", F.explode(_bins(F.col("g_start"), F.col("g_end"), width)).alias("_gbin"))
    i = items.withColumn("_bin", _bin(F.col(start), width))  # a gene that contains the item spans the item's first bin
    j = i.join(g, (i[chrom] == g["_chrom"]) & (i["_bin"] == g["_gbin"]) & (F.col("g_start") <= F.col(start)) & (F.col(end) <= F.col("g_end")))
    return j.select(*(F.col(c) for c in items.columns), "gene_id")


def overlapping_pairs(df: DataFrame, keys: list[str], ident: str, start: str, end: str, width: int = 100_000) -> DataFrame:
    """(keys, u, v, u_start, u_end, v_start, v_end), u < v: pairs of a group with ``u_end > v_start and u_start < v_end`` (touching ends don't overlap).

    Intervals with end <= start overlap nothing. ``ident`` is unique in a group.
    """
    df = df.where(F.col(end) > F.col(start))

    def side(name: str) -> DataFrame:
        return df.select(*(F.col(k).alias(f"_{name}{k}") for k in keys), F.col(ident).alias(name), F.col(start).alias(f"{name}_start"), F.col(end).alias(f"{name}_end"), F.explode(_bins(F.col(start), F.col(end), width)).alias(f"_{name}bin"))

    on = [F.col(f"_u{k}").eqNullSafe(F.col(f"_v{k}")) for k in keys]
    on += [F.col("_ubin") == F.col("_vbin"), F.col("u") < F.col("v"), F.col("u_end") > F.col("v_start"), F.col("u_start") < F.col("v_end")]
    on += [F.col("_ubin") == F.greatest(_bin(F.col("u_start"), width), _bin(F.col("v_start"), width))]  # the first bin both have
    j = side("u").join(side("v"), on)
    return j.select(*(F.col(f"_u{k}").alias(k) for k in keys), "u", "v", "u_start", "u_end", "v_start", "v_end")


def depth_runs(df: DataFrame, keys: list[str], start: str, end: str, tile: int = 1_000_000, weight: Column | None = None) -> DataFrame:
    """(keys, start, end, depth): runs of equal depth under half-open intervals, inner runs of depth 0 included.

    The running sum is split by tiles: each tile sums its own events and adds the sum of the tiles before it, so that no task sorts a whole
    chromosome. Intervals with end <= start count as none. weight: what an interval adds (1 if not given).
    """
    df = df.where(F.col(end) > F.col(start))
    w = F.lit(1) if weight is None else weight
    ends = F.explode(F.array(F.struct(F.col(start).alias("pos"), w.alias("d")), F.struct(F.col(end).alias("pos"), (-w).alias("d"))))
    events = df.select(*keys, ends.alias("e")).groupBy(*keys, "e.pos").agg(F.sum("e.d").alias("d")).where(F.col("d") != 0)
    events = events.withColumn("_tile", _bin(F.col("pos"), tile))
    by_keys = Window.partitionBy(*keys).orderBy("_tile")
    tiles = events.groupBy(*keys, "_tile").agg(F.sum("d").alias("_all"), F.min("pos").alias("_first"))
    tiles = tiles.select(*keys, "_tile", F.coalesce(F.sum("_all").over(by_keys.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(by_keys).alias("_next"))
    t = tiles.select(*(F.col(k).alias(f"_t{k}") for k in keys), F.col("_tile").alias("_ttile"), "_before", "_next")
    events = events.join(t, [F.col(k).eqNullSafe(F.col(f"_t{k}")) for k in keys] + [F.col("_tile") == F.col("_ttile")])
    within = Window.partitionBy(*keys, "_tile").orderBy("pos")
    depth = F.col("_before") + F.sum("d").over(within.rowsBetween(Window.unboundedPreceding, 0))
    runs = events.select(*keys, F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(within), F.col("_next")).alias("end"), depth.cast("long").alias("depth"))
    return runs.where(F.col("end").isNotNull())


def max_depth(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, depth): the most intervals over one point, ends before starts where they meet: the clique number of their overlap graph."""
    return depth_runs(df, keys, start, end).groupBy(*keys).agg(F.max("depth").alias("depth"))


def merged_nearby(df: DataFrame, keys: list[str], start: str, end: str, gap: int, tile: int = 10_000_000) -> DataFrame:
    """(keys, start, end, n): intervals whose start lies less than ``gap`` behind the furthest end before them become one.

    The running furthest end and the count of islands are split by tiles of starts, each of which carries on those of the tiles before it, so that no task sorts a chromosome.
    """
    upto = (Window.unboundedPreceding, -1)
    rows = df.withColumn("_tile", _bin(F.col(start), tile))
    by_keys = Window.partitionBy(*keys).orderBy("_tile")
    within = Window.partitionBy(*keys, "_tile").orderBy(start, end)
    on = [F.col(k).eqNullSafe(F.col(f"_t{k}")) for k in keys] + [F.col("_tile") == F.col("_ttile")]
    named = [F.col(k).alias(f"_t{k}") for k in keys] + [F.col("_tile").alias("_ttile")]
    reach = rows.groupBy(*keys, "_tile").agg(F.max(end).alias("_far")).select(*named, F.max("_far").over(by_keys.rowsBetween(*upto)).alias("_carried"))
    rows = rows.join(reach, on).drop(*(f"_t{k}" for k in keys), "_ttile").withColumn("_reach", F.greatest("_carried", F.max(end).over(within.rowsBetween(*upto))))
    rows = rows.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) - F.col("_reach") >= gap), 1).otherwise(0))
    begun = rows.groupBy(*keys, "_tile").agg(F.sum("_new").alias("_count")).select(*named, F.coalesce(F.sum("_count").over(by_keys.rowsBetween(*upto)), F.lit(0)).alias("_begun"))
    island = F.col("_begun") + F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.join(begun, on).drop(*(f"_t{k}" for k in keys), "_ttile").withColumn("_island", island)
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def covered_by(df: DataFrame, other: DataFrame, chrom: str, start: str, end: str, percent: int, width: int = 100_000) -> DataFrame:
    """Rows of ``df`` of which some interval of ``other`` (chrom, start, end) covers at least ``percent`` of end - start, and more than none; each distinct row once."""
    o = other.select(F.col(chrom).alias("_c"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(_bins(F.col(start), F.col(end), width)).alias("_obin")).distinct()
    keyed = df.select("*", F.explode(_bins(F.col(start), F.col(end), width)).alias("_bin"))
    shared = F.least(F.col(end), F.col("_e")) - F.greatest(F.col(start), F.col("_s"))
    on = (F.col(chrom) == F.col("_c")) & (F.col("_bin") == F.col("_obin")) & (shared > 0) & (shared * 100 >= (F.col(end) - F.col(start)) * percent)
    return keyed.join(o, on, "left_semi").select(*df.columns).distinct()


def tiled(runs: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, tile, bases): depth x bases of runs (start, end, depth) in tiles of ``width``, split where a run crosses a tile's end."""
    parts = runs.where(F.col("depth") != 0).select("*", F.explode(_bins(F.col("start"), F.col("end") - 1, width)).alias("tile"))
    inside = F.least(F.col("end"), (F.col("tile") + 1) * width) - F.greatest(F.col("start"), F.col("tile") * width)
    return parts.groupBy(*keys, "tile").agg(F.sum(F.col("depth") * inside).cast("long").alias("bases"))


def region_stats(runs: DataFrame, regions: DataFrame, width: int = 1_000_000) -> DataFrame:
    """(gene_id, bases, covered, min_depth, max_depth) of regions (gene_id, chrom, g_start, g_end; half-open) under runs (chrom, start, end, depth).

    Regions without data get zeros.
    """
    r = regions.select("gene_id", F.col("chrom").alias("_c"), "g_start", "g_end", F.explode(_bins(F.col("g_start"), F.col("g_end") - 1, width)).alias("_rbin"))
    d = runs.where(F.col("depth") > 0).select("*", F.explode(_bins(F.col("start"), F.col("end") - 1, width)).alias("_bin"))
    lo, hi = F.greatest("start", "g_start"), F.least("end", "g_end")
    j = d.join(r, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_rbin")) & (lo < hi) & (F.col("_bin") == _bin(lo, width)))
    sums = j.groupBy("gene_id").agg(F.sum(F.col("depth") * (hi - lo)).alias("b"), F.sum(hi - lo).alias("c"), F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    out = regions.select("gene_id").join(sums, "gene_id", "left")
    return out.select("gene_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n) for c, n in (("b", "bases"), ("c", "covered"), ("lo", "min_depth"), ("hi", "max_depth"))))


def signal_stats(signal: DataFrame, regions: DataFrame, width: int = 1_000_000) -> DataFrame:
    """(gene_id, sum, mean, min, max) of regions (gene_id, chrom, g_start, g_end; half-open) under signal intervals (chrom, start, end, value, of any numeric type).

    sum: value x shared bases; mean: sum over the bases of the region; min, max: of the values that touch it. Regions without data get zeros; null values and
    regions or intervals without bases count as none.
    """
    regions = regions.where(F.col("g_end") > F.col("g_start"))
    r = regions.select("gene_id", F.col("chrom").alias("_c"), "g_start", "g_end", F.explode(_bins(F.col("g_start"), F.col("g_end") - 1, width)).alias("_rbin"))
    d = signal.where((F.col("end") > F.col("start")) & F.col("value").isNotNull()).select("chrom", "start", "end", F.col("value").cast("double").alias("value"))
    d = d.withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end") - 1, width)))
    lo, hi = F.greatest("start", "g_start"), F.least("end", "g_end")
    j = d.join(r, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_rbin")) & (lo < hi) & (F.col("_bin") == _bin(lo, width)))
    stats = j.groupBy("gene_id").agg(F.sum(F.col("value") * (hi - lo)).alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
    of = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    out = regions.select("gene_id", (F.col("g_end") - F.col("g_start")).alias("_bases")).join(stats, "gene_id", "left")
    return out.select("gene_id", of("sum"), (F.coalesce("sum", F.lit(0.0)) / F.col("_bases")).alias("mean"), of("min"), of("max"))


def region_value(signal: DataFrame, regions: DataFrame, op: str = "sum") -> DataFrame:
    """(gene_id, value) of :func:`signal_stats` for one of sum, mean, min, max; any other ``op`` is sum."""
    return signal_stats(signal, regions).select("gene_id", F.col(op if op in ("mean", "min", "max") else "sum").alias("value"))


def shared_bases(blocks: DataFrame, regions: DataFrame, width: int = 1_000_000) -> DataFrame:
    """(chrom, bases): bases of half-open blocks (chrom, start, end) inside regions (chrom, start, end); a base counts once for each block and region that hold it."""
    r = regions.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(_bins(F.col("start"), F.col("end") - 1, width)).alias("_rbin"))
    d = blocks.where(F.col("end") > F.col("start")).select("*", F.explode(_bins(F.col("start"), F.col("end") - 1, width)).alias("_bin"))
    lo, hi = F.greatest("start", "_s"), F.least("end", "_e")
    j = d.join(r, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_rbin")) & (lo < hi) & (F.col("_bin") == _bin(lo, width)))
    return j.groupBy("chrom").agg(F.sum((hi - lo).cast("long")).alias("bases"))
