"""Delimited ``.junc`` lines: valid records on one side, broken lines with the reason on the other.

Structure (quoting, number of columns) is checked per line with built-in expressions. The values of a column are checked
once per distinct value: the distinct values of the five columns are validated, the invalid ones form a dictionary
(column, value, reason), which is joined back to the lines. The part of a column is broadcast if its measured size is within the bound. Beyond it only
lines with a value that isn't plainly valid are joined, as pairs of line number and value: frequent values, of which there are few, by a broadcast, so that
the rest, joined by a shuffle, has no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceframe.session import BROADCAST_BYTES, BROADCAST_ROWS, hinted, staged

HEADER = "chrom\tchromStart\tchromEnd\t.\tscore\tstrand"
WIDTHS = (6, 12)
MAX_INT = 2147483647
#: a value is frequent if it is in more than this many lines, or in a ten-thousandth of them if that is more
FREQUENT = 1_000
#: (field number, column, reason), in the order of the checks
CHECKED = ((0, "chrom", "chrom"), (1, "chrom_start", "coordinate"), (2, "chrom_end", "coordinate"), (4, "score", "score"), (5, "strand", "strand"))


def _between(c: Column, low: int) -> Column:
    """ASCII digits only, within low .. MAX_INT; leading zeros are allowed."""
    digits = F.ltrim(c, F.lit("0"))
    value = F.when(digits == "", F.lit(0).cast("long")).when(F.length(digits) <= 10, digits.try_cast("long"))
    return c.rlike(r"\A[0-9]+\z") & F.coalesce(value.between(low, MAX_INT), F.lit(False))


def _valid(column: Column, value: Column) -> Column:
    return (
        F.when(column == "chrom", value != "")
        .when(column == "score", _between(value, 0))
        .when(column == "strand", value.isin("+", "-", ".", "0", "1"))
        .otherwise(_between(value, 1))
    )


def _plain(column: str) -> Column:
    """Values that are valid at first sight."""
    c = F.col(f"_{column}")
    return {"chrom": c != "", "score": c.rlike(r"\A(?:0|[1-9][0-9]{0,8})\z"), "strand": c.isin("+", "-", ".", "0", "1")}.get(column, c.rlike(r"\A[1-9][0-9]{0,8}\z"))


def _is_record(line: Column) -> Column:
    return line.isNotNull() & (F.trim(line) != "") & ~line.startswith("#") & (line != HEADER)


def _escaped(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("\\\\"))


def _unescaped(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"\\\\"), lambda x: F.replace(x, F.lit("\\t"), F.lit("\t"))), "\\")


def _fields(line: Column) -> tuple[Column, Column]:
    """(quoting is sound, array of fields). Pieces between quotes alternate outside / inside; an empty piece outside, not at
    an end, is an escaped quote; other pieces outside must begin and end with a tab (but at the ends of the line)."""
    pieces = F.split(line, '"')
    last = F.size(pieces) - 1

    def sound(x: Column, i: Column) -> Column:
        opens, closes = x.endswith("\t"), x.startswith("\t")
        return F.when(i % 2 == 1, F.lit(True)).when(i == 0, (x == "") | opens).when(i == last, (x == "") | closes).otherwise((x == "") | (opens & closes))

    def rebuilt(x: Column, i: Column) -> Column:
        inside = F.replace(_escaped(x), F.lit("\t"), F.lit("\\t"))
        return F.when(i % 2 == 1, inside).when((x == "") & (i > 0) & (i < last), F.lit('"')).otherwise(_escaped(x))

    quoted = line.contains('"')
    whole = (last % 2 == 0) & F.forall(F.transform(pieces, sound), lambda b: b)
    fields = F.when(quoted, F.transform(F.split(F.array_join(F.transform(pieces, rebuilt), ""), "\t"), _unescaped)).otherwise(F.split(line, "\t"))
    return F.coalesce(~quoted | whole, F.lit(True)), fields


def parsed_lines(df: DataFrame, line: str = "raw_line") -> DataFrame:
    """Lines of ``df`` that should hold a record, with ``structure`` (null, ``quoting`` or ``column_count``) and the five checked
    fields as trimmed text (null where the structure fails)."""
    raw = F.col(line)
    text = F.when(raw.endswith("\r"), F.left(raw, F.length(raw) - 1)).otherwise(raw)
    lines = df.withColumn("_line", text).where(_is_record(F.col("_line")))
    sound, fields = _fields(F.col("_line"))
    lines = lines.withColumn("_fields", F.when(sound, fields))
    structure = F.when(F.col("_fields").isNull(), "quoting").when(~F.size("_fields").isin(*WIDTHS), "column_count")
    lines = lines.withColumn("_structure", structure)
    return lines.select("*", *(F.when(F.col("_structure").isNull(), F.trim(F.get("_fields", F.lit(i)))).alias(f"_{c}") for i, c, _ in CHECKED)).drop("_line", "_fields")


def checked_values(lines: DataFrame) -> DataFrame:
    """(column, value, reason, n_lines): every distinct value of a checked column is validated once; reason is null for a valid one."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("value")) for _, c, _ in CHECKED))
    values = lines.where(F.col("_structure").isNull()).select(F.explode(pairs).alias("p")).select("p.*")
    distinct = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_lines"))
    reasons = F.create_map(*(F.lit(x) for _, c, r in CHECKED for x in (c, r)))
    # the count keeps the check behind the aggregation; it would else be pushed down to every line
    return distinct.select("column", "value", F.when((F.col("n_lines") > 0) & ~_valid(F.col("column"), F.col("value")), reasons[F.col("column")]).alias("reason"), "n_lines")


def invalid_values(lines: DataFrame) -> DataFrame:
    """The dictionary (column, value, reason, n_lines) of the invalid values."""
    return checked_values(lines).where(F.col("reason").isNotNull())


def checked_lines(df: DataFrame, line: str = "raw_line", keep: list[str] | None = None) -> DataFrame:
    """``df`` without its non-records, with ``parse_reason`` (null: valid) and the columns chrom, chrom_start, chrom_end, score, strand
    (null where invalid). Non-records: null, blank, ``#`` and header lines; one CR at the end of a line is dropped first. Reasons in
    order: quoting, column_count, chrom, coordinate, score, strand. Equal lines are checked each; an empty table gives none.

    keep: columns of ``df`` in the result (None: all). Columns of ``df`` that bear the name of an added one are replaced; names that begin with an underscore are reserved.
    """
    added = {c for _, c, _ in CHECKED} | {"parse_reason"}
    df = df.drop(*(added - {line}))
    keep = [c for c in (df.columns if keep is None else keep) if c not in added or c == line]
    fields = [f"_{c}" for _, c, _ in CHECKED]
    kept = [F.col(f"`{c}`") for c in keep]
    lines = staged(parsed_lines(df, line).select(*kept, "_structure", *fields, F.monotonically_increasing_id().alias("_id")), "lines")
    frequent = max(FREQUENT, lines.count() // 10_000)
    values = staged(checked_values(lines).where(F.col("reason").isNotNull() | (F.col("n_lines") > frequent)), "values")
    invalid = F.when(F.col("reason").isNotNull(), F.octet_length("value") + 16)
    sizes = {c: (n, b) for c, n, b in values.groupBy("column").agg(F.count(invalid), F.coalesce(F.sum(invalid), F.lit(0))).collect()}  # a row a column
    for _, c, _ in CHECKED:
        n, b = sizes.get(c, (0, 0))
        if n == 0:
            lines = lines.withColumn(f"_reason_{c}", F.lit(None).cast("string"))
        elif n <= BROADCAST_ROWS and b <= BROADCAST_BYTES:
            own = values.where((F.col("column") == c) & F.col("reason").isNotNull()).select(F.col("value").alias(f"_value_{c}"), F.col("reason").alias(f"_reason_{c}"))
            lines = lines.join(F.broadcast(own), F.col(f"_{c}") == F.col(f"_value_{c}"), "left").drop(f"_value_{c}")
    large = [c for _, c, _ in CHECKED if f"_reason_{c}" not in lines.columns]
    if large:
        lines = _with_large(lines, values, large, frequent)
    reason = F.coalesce("_structure", *(f"_reason_{c}" for _, c, _ in CHECKED))
    typed = [F.when(reason.isNull(), F.col(f"_{c}") if c in ("chrom", "strand") else F.col(f"_{c}").try_cast("int")).alias(c) for _, c, _ in CHECKED]
    return lines.select(*kept, *typed, reason.alias("parse_reason"))


def _with_large(lines: DataFrame, values: DataFrame, large: list[str], frequent: int) -> DataFrame:
    """``lines`` with the reasons of the columns ``large``, whose invalid values are too many for a broadcast."""
    doubtful = [F.coalesce(~_plain(c), F.lit(False)) for c in large]
    some = doubtful[0]
    for d in doubtful[1:]:
        some |= d
    found = [F.when(d, F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("value"))) for c, d in zip(large, doubtful)]
    pairs = lines.where(some).select("_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("p")).select("_id", "p.*")
    often = hinted(values.where(F.col("n_lines") > frequent).select("column", "value", "reason"))
    rare = values.where(F.col("n_lines") <= frequent).select("column", "value", "reason")
    hits = pairs.join(often, ["column", "value"]).where(F.col("reason").isNotNull()).unionByName(pairs.join(often, ["column", "value"], "left_anti").join(rare, ["column", "value"]))
    reasons = hits.groupBy("_id").agg(*(F.max(F.when(F.col("column") == c, F.col("reason"))).alias(f"_reason_{c}") for c in large))
    clean = lines.where(~some).select("*", *(F.lit(None).cast("string").alias(f"_reason_{c}") for c in large))
    return clean.unionByName(lines.where(some).join(reasons, "_id", "left"))


def split_valid(df: DataFrame, line: str = "raw_line", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid records, broken lines with ``parse_reason``)."""
    checked = checked_lines(df, line, keep)
    broken = checked.where(F.col("parse_reason").isNotNull()).drop(*(c for _, c, _ in CHECKED))
    return checked.where(F.col("parse_reason").isNull()).drop("parse_reason"), broken
