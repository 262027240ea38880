"""Names of junctions as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_label(chrom: Column, start: Column, end: Column) -> Column:
    """``chrom:start-end``."""
    return F.concat(chrom, F.lit(":"), F.concat_ws("-", start, end))


def parsed_label(text: Column) -> Column:
    """struct<chrom, jx_start, jx_end> of ``[chrom:]start-end``; null for other texts, a null chrom where there is none."""
    part = lambda i: F.regexp_extract(text, r"\A(?:(.*):)?([0-9]{1,9})-([0-9]{1,9})\z", i)
    parsed = F.struct(F.nullif(part(1), F.lit("")).alias("chrom"), part(2).try_cast("int").alias("jx_start"), part(3).try_cast("int").alias("jx_end"))
    return F.when(part(2) != "", parsed)


def clamped(value: Column, least: float) -> Column:
    return F.greatest(value, F.lit(least))
