"""How often two items occur in one basket, and how much more often than chance.

Baskets are deduplicated to sorted item arrays; identical arrays of a source collapse into one with a weight, so that pairs are
enumerated once per distinct basket; weights of equal pairs are summed with map-side combine. Baskets above ``LARGE`` items
are first cut to the items frequent enough to be in any reported pair (exact: a pair is never more frequent than its items), then split
into blocks of items whose pairs of blocks are enumerated by separate tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceframe.session import hinted, staged

LARGE = 256
_HALF = 2147483648


def packed(low: Column, high: Column) -> Column:
    """(low, high) of type int as one long, in the same order."""
    return F.shiftleft(low.cast("long"), 32) + high.cast("long") + F.lit(_HALF)


def unpacked(item: Column) -> tuple[Column, Column]:
    return F.shiftright(item, 32).cast("int"), (item.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(_HALF)).cast("int")


def collapsed(rows: DataFrame, source: str, basket: str, item: str) -> DataFrame:
    """(source, items, weight): distinct sorted item arrays of a source and the number of its baskets that equal them.

    Rows with a null basket or item are left out; repeated rows count once; a null source is a source.
    """
    rows = rows.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
    baskets = rows.groupBy(source, basket).agg(F.sort_array(F.collect_set(item)).alias("items"))
    return baskets.groupBy(source, "items").agg(F.count(F.lit(1)).alias("weight"))


def _pairs_within(items: Column) -> Column:
    return F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _pairs_between(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))


def _large_pairs(large: DataFrame, counts: DataFrame, source: str, least: int) -> DataFrame:
    """(source, weight, pair) of baskets above LARGE items, spread over tasks by pairs of item blocks."""
    rows = large.select(source, "weight", "_b", F.explode("items").alias("item"))
    frequent = counts.where(F.col("n_item") >= least).select(F.col(source).alias("_s"), F.col("item").alias("_i"))
    rows = rows.join(frequent, rows[source].eqNullSafe(F.col("_s")) & (rows["item"] == F.col("_i")), "left_semi")
    sizes = rows.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / LARGE).cast("int").alias("_blocks"))
    rows = rows.join(sizes, "_b").withColumn("_block", F.pmod(F.xxhash64("item"), F.col("_blocks")).cast("int"))
    blocks = rows.groupBy(source, "weight", "_b", "_blocks", "_block").agg(F.sort_array(F.collect_list("item")).alias("items"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, F.col("_block")).alias("i"), F.greatest(o, F.col("_block")).alias("j")))
    spread = blocks.select(source, "weight", "_b", "_block", "items", F.explode(cells).alias("c"))
    met = spread.groupBy(source, "weight", "_b", "c").agg(F.max(F.when(F.col("_block") == F.col("c.i"), F.col("items"))).alias("x"), F.max(F.when(F.col("_block") == F.col("c.j"), F.col("items"))).alias("y"))
    pairs = F.when(F.col("c.i") == F.col("c.j"), _pairs_within(F.col("x"))).otherwise(_pairs_between(F.col("x"), F.col("y")))
    return met.select(source, "weight", F.explode(pairs).alias("pair"))


def together(rows: DataFrame, source: str, basket: str, item: str, least: int) -> DataFrame:
    """Pairs of items (long) that at least ``least`` baskets of a source hold both: source, a, b (a < b), n_ab, n_a, n_b, n (baskets of the source).

    Names of ``rows`` other than the three given don't matter. An empty table gives no pairs.
    """
    name, source = source, "_source"
    rows = rows.select(F.col(name).alias(source), F.col(basket).alias("_basket"), F.col(item).cast("long").alias("_item"))
    baskets = staged(collapsed(rows, source, "_basket", "_item"), "baskets")
    counts = baskets.select(source, "weight", F.explode("items").alias("item")).groupBy(source, "item").agg(F.sum("weight").alias("n_item"))
    totals = staged(baskets.groupBy(source).agg(F.sum("weight").alias("n")), "sources")
    size = F.size("items")
    pairs = baskets.where(size.between(2, LARGE)).select(source, "weight", F.explode(_pairs_within(F.col("items"))).alias("pair"))
    large = staged(baskets.where(size > LARGE).withColumn("_b", F.monotonically_increasing_id()), "large-baskets")
    if not large.isEmpty():
        pairs = pairs.unionByName(_large_pairs(large, counts, source, least))
    summed = pairs.groupBy(source, "pair.a", "pair.b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= least)

    def one(side: str) -> DataFrame:
        return counts.select(F.col(source).alias(f"_s{side}"), F.col("item").alias(f"_i{side}"), F.col("n_item").alias(f"n_{side}"))

    out = summed
    for side in "ab":
        out = out.join(one(side), out[source].eqNullSafe(F.col(f"_s{side}")) & (F.col(side) == F.col(f"_i{side}")))
    totals = hinted(totals.select(F.col(source).alias("_s"), "n"))
    return out.join(totals, F.col(source).eqNullSafe(F.col("_s"))).select(F.col(source).alias(name), "a", "b", "n_ab", "n_a", "n_b", "n")


def lift_at_least(pairs: DataFrame, times: int) -> DataFrame:
    """Pairs ``times`` as frequent as chance or more; in whole numbers, so exact."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(wide("n_ab") * wide("n") >= wide("n_a") * wide("n_b").cast("decimal(18,0)") * times)


def scored(pairs: DataFrame) -> DataFrame:
    """Adds ``lift`` and the ``conviction`` of a -> b (null where b is in all baskets that hold a)."""
    d = lambda c: F.col(c).cast("double")
    lift = d("n_ab") * d("n") / (d("n_a") * d("n_b"))
    conviction = F.when(F.col("n_a") > F.col("n_ab"), (1 - d("n_b") / d("n")) / (1 - d("n_ab") / d("n_a")))
    return pairs.select("*", lift.alias("lift"), conviction.alias("conviction"))
