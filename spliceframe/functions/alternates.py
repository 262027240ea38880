"""Bases of a read that differ from the reference, from its CIGAR and its MD tag, in built-in expressions. Positions are 0-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spliceframe.functions.cigar import matches, operations

_RECORD = "array<struct<pos:int,op:string,payload:string>>"


def _record(pos: Column, op: str, payload: Column) -> Column:
    return F.array(F.struct(pos.cast("int").alias("pos"), F.lit(op).alias("op"), payload.cast("string").alias("payload")))


def cigar_alternates(pos: Column, cigar: Column, seq: Column, soft_clips: bool = False) -> Column:
    """array<pos, op, payload>: I with the inserted bases, D with the number of deleted ones, S (if asked for) with the clipped ones."""
    start = F.struct((pos - 1).cast("int").alias("r"), F.lit(0).alias("q"), F.array().cast(_RECORD).alias("out"))

    def step(a: Column, x: Column) -> Column:
        n, op = x["n"], x["op"]
        bases = F.substring(seq, a["q"] + 1, n)
        new = F.when(op == "I", _record(a["r"], "I", bases)).when(op == "D", _record(a["r"], "D", n))
        if soft_clips:
            new = new.when(op == "S", _record(a["r"], "S", bases))
        return F.struct(
            (a["r"] + F.when(op.isin("M", "D", "N", "=", "X"), n).otherwise(0)).alias("r"),
            (a["q"] + F.when(op.isin("M", "I", "S", "=", "X"), n).otherwise(0)).alias("q"),
            F.concat(a["out"], F.coalesce(new, F.array().cast(_RECORD))).alias("out"),
        )

    return F.aggregate(operations(cigar), start, step, lambda a: a["out"])


def _mismatch_places(md: Column) -> Column:
    """Places of the mismatches of an MD tag, counted over its aligned and deleted bases."""
    tokens = F.regexp_extract_all(md, F.lit(r"[0-9]+|\^[A-Za-z]+|[A-Za-z]"), F.lit(0))
    start = F.struct(F.lit(0).alias("m"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        number, deleted = t.rlike(r"\A[0-9]+\z"), t.startswith("^")
        length = F.when(number, t.try_cast("int")).when(deleted, F.length(t) - 1).otherwise(1)
        return F.struct((a["m"] + length).alias("m"), F.when(number | deleted, a["out"]).otherwise(F.concat(a["out"], F.array(a["m"]))).alias("out"))

    return F.aggregate(tokens, start, step, lambda a: a["out"])


def md_mismatches(pos: Column, cigar: Column, md: Column, seq: Column, include_n: bool = False) -> Column:
    """array<pos, op, payload> of the mismatches (op X, payload the read's base); those of base N only if ``include_n``."""
    block = "struct<ms:int,me:int,r:int,q:int>"
    start = F.struct(F.lit(0).alias("m"), (pos - 1).cast("int").alias("r"), F.lit(0).alias("q"), F.array().cast(f"array<{block}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        n, op = x["n"], x["op"]
        own = F.array(F.struct(a["m"].alias("ms"), (a["m"] + n).alias("me"), a["r"].alias("r"), a["q"].alias("q")))
        return F.struct(
            (a["m"] + F.when(matches(op) | (op == "D"), n).otherwise(0)).alias("m"),
            (a["r"] + F.when(matches(op) | op.isin("D", "N"), n).otherwise(0)).alias("r"),
            (a["q"] + F.when(matches(op) | op.isin("I", "S"), n).otherwise(0)).alias("q"),
            F.when(matches(op), F.concat(a["out"], own)).otherwise(a["out"]).alias("out"),
        )

    blocks = F.aggregate(operations(cigar), start, step, lambda a: a["out"])
    placed = F.transform(_mismatch_places(md), lambda m: F.transform(F.filter(blocks, lambda b: (b["ms"] <= m) & (m < b["me"])), lambda b: F.struct((b["r"] + m - b["ms"]).alias("pos"), F.lit("X").alias("op"), F.substring(seq, b["q"] + m - b["ms"] + 1, F.lit(1)).alias("payload"))))
    found = F.flatten(placed)
    return found if include_n else F.filter(found, lambda x: F.upper(x["payload"]) != "N")


def poly_a(bases: Column, least: int = 3, percent: int = 80) -> Column:
    """``A`` or ``T`` if that base makes up ``percent`` of at least ``least`` bases, else null."""

    def mostly(b: str) -> Column:
        return (F.length(bases) - F.length(F.replace(bases, F.lit(b), F.lit("")))) * 100 >= F.length(bases) * percent

    return F.when(F.length(bases) >= least, F.when(mostly("A"), "A").when(mostly("T"), "T"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))
