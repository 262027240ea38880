"""CIGAR strings as arrays and folds over them, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = r"([0-9]+)([MIDNSHP=X])"


def operations(cigar: Column) -> Column:
    """array<struct<n int, op string>>; empty for ``*``."""
    ops = F.regexp_extract_all(cigar, F.lit(_STEP), F.lit(2))
    return F.transform(F.regexp_extract_all(cigar, F.lit(_STEP), F.lit(1)), lambda n, i: F.struct(n.cast("int").alias("n"), ops[i].alias("op")))


def consumes_reference(op: Column) -> Column:
    return op.isin("M", "D", "N", "=", "X")


def matches(op: Column) -> Column:
    return op.isin("M", "=", "X")


def reference_end(pos: Column, cigar: Column) -> Column:
    """The last reference position of an alignment that begins at ``pos``."""
    return pos + F.aggregate(operations(cigar), F.lit(0), lambda a, x: a + F.when(consumes_reference(x["op"]), x["n"]).otherwise(0)) - 1


def aligned_bases(cigar: Column) -> Column:
    return F.aggregate(operations(cigar), F.lit(0), lambda a, x: a + F.when(matches(x["op"]), x["n"]).otherwise(0))


def soft_clipped(cigar: Column) -> Column:
    return F.aggregate(operations(cigar), F.lit(0), lambda a, x: a + F.when(x["op"] == "S", x["n"]).otherwise(0))


def _spans(pos: Column, cigar: Column, wanted) -> Column:
    empty = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(pos.cast("int").alias("at"), empty.alias("out"))

    def step(a: Column, x: Column) -> Column:
        after = a["at"] + F.when(consumes_reference(x["op"]), x["n"]).otherwise(0)
        span = F.array(F.struct(a["at"].alias("s"), (after - 1).alias("e")))
        return F.struct(after.alias("at"), F.when(wanted(x["op"]), F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(operations(cigar), start, step, lambda a: a["out"])


def introns(pos: Column, cigar: Column) -> Column:
    """array<struct<s, e>> of all N steps, inclusive."""
    return _spans(pos, cigar, lambda op: op == "N")


def blocks(pos: Column, cigar: Column) -> Column:
    """array<struct<s, e>> of the steps that align bases, inclusive."""
    return _spans(pos, cigar, matches)


def anchored_introns(pos: Column, cigar: Column, anchor: int = 6, shortest: int = 50, longest: int = 500_000) -> Column:
    """Introns of shortest .. longest bases with at least ``anchor`` aligned bases right before and right after.

    The fold carries the length of the run of aligned steps and the intron that waits for its right anchor.
    """
    span = "struct<s:int,e:int>"
    none = F.lit(None).cast(span)
    start = F.struct(pos.cast("int").alias("at"), F.lit(0).alias("run"), none.alias("waits"), F.array().cast(f"array<{span}>").alias("out"))

    def kept(a: Column) -> Column:
        return F.when(a["waits"].isNotNull() & (a["run"] >= anchor), F.concat(a["out"], F.array(a["waits"]))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        n, op = x["n"], x["op"]
        new = F.when((op == "N") & (a["run"] >= anchor) & n.between(shortest, longest), F.struct(a["at"].alias("s"), (a["at"] + n - 1).alias("e")))
        return F.struct(
            (a["at"] + F.when(consumes_reference(op), n).otherwise(0)).alias("at"),
            F.when(matches(op), a["run"] + n).otherwise(0).alias("run"),
            F.when(matches(op), a["waits"]).otherwise(new).alias("waits"),
            F.when(matches(op), a["out"]).otherwise(kept(a)).alias("out"),
        )

    return F.aggregate(operations(cigar), start, step, kept)
