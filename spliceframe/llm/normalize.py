"""One consistent form for texts that look the same.

Default-ignorable characters are removed, compatibility characters (full-width forms, ligatures, special spaces) are decomposed, Cyrillic and
Greek letters that look like a Latin letter become it, letters and marks are composed, and any run of white space becomes one
space, none at the ends. Case folding on top is a form of its own, as case is visible.

The work is done once per distinct value of a batch, on many values joined into one string.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spliceframe.session import discard, staged

# Letters that look like a Latin letter of their case in upright type, by script. Letters of one script that look like the same Latin letter
# are told apart, as they are different letters, so only the nearest has it (I for both the letters and the palochka).
CYRILLIC = "АВЕЅІЈКМНОРСТУХӀԌԚԜѴаеѕіјорсухһԁԛԝӏѵ"
CYRILLIC_AS = "ABESIJKMHOPCTYXIGQWVaesijopcyxhdqwlv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXaivopucj"
# Default-ignorable characters that aren't format characters (Cf), and format characters that are visible.
IGNORABLE_TOO = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF))
VISIBLE_FORMAT = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0xFFF9, 0xFFFB), (0x110BD, 0x110CD), (0x13430, 0x1343F))

CHUNK = 1_000_000
#: documents of a list, and lists of a block, when documents are paired
LIST = 1_000
BLOCK = 32


def _ignorable() -> str:
    """A character class, as ranges, of the invisible format characters and the other default-ignorable ones."""
    visible = {c for a, b in VISIBLE_FORMAT for c in range(a, b + 1)}
    codes = {c for a, b in IGNORABLE_TOO for c in range(a, b + 1)}
    codes |= {c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf" and c not in visible}
    starts = sorted(c for c in codes if c - 1 not in codes)
    ends = sorted(c for c in codes if c + 1 not in codes)
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]+"


_IGNORABLE = re.compile(_ignorable())
# the look-alikes by code point, over the blocks that hold them
_FROM, _TO = 0x370, 0x530
_ALIKE = np.arange(_FROM, _TO, dtype=np.uint32)
for _letter, _latin in zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS):
    _ALIKE[ord(_letter) - _FROM] = ord(_latin)
_SPACE = re.compile(r"\s+")


def _to_latin(text: str) -> str:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    at = np.flatnonzero((codes >= _FROM) & (codes < _TO))
    if not len(at):
        return text
    codes[at] = _ALIKE[codes[at] - _FROM]
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def consistent(text: str) -> str:
    """The consistent form of one string, or of several joined by NUL; white space at the ends stays as one space."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _IGNORABLE.sub("", text))
        text = unicodedata.normalize("NFC", _to_latin(text))
    return _SPACE.sub(" ", text)


def consistent_forms(values: list[str]) -> list[str]:
    """The consistent form of each value."""
    out: list[str] = []
    chunk: list[str] = []
    size = 0

    def finish() -> None:
        joined = "\0".join(chunk)
        done = consistent(joined).split("\0") if joined.count("\0") == len(chunk) - 1 else [consistent(v) for v in chunk]
        out.extend(x.strip(" ") for x in done)

    for v in values:
        chunk.append(v)
        size += len(v)
        if size > CHUNK:
            finish()
            chunk, size = [], 0
    if chunk:
        finish()
    return out


def folded(form: str) -> str:
    """Full case folding of a consistent form, consistent again."""
    return form.lower() if form.isascii() else consistent(form.casefold()).strip(" ")


def _distinct(column: pa.Array) -> tuple[list[str], pa.Array]:
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices


def _taken(values: list, kind: pa.DataType, indices: pa.Array) -> pa.Array:
    return pa.array(values, kind).take(indices)


def normalized(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``form`` and ``folded`` (columns of these names are replaced). A null text has null forms, an empty or invisible one empty ones."""
    df = df.drop("form", "folded")
    schema = StructType([*df.schema.fields, StructField("form", StringType()), StructField("folded", StringType())])

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = _distinct(batch.column(batch.schema.names.index(text)))
            form = consistent_forms(values)
            both = [_taken(form, pa.string(), at), _taken([folded(f) for f in form], pa.string(), at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], [*batch.schema.names, "form", "folded"])

    return df.mapInArrow(forms, schema)


def _digest(value: str) -> bytes:
    return blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def looks(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, form, stored): 128-bit digests of the consistent form and of the stored text; null texts are left out."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = _distinct(batch.column(1))
            form, stored = ([_digest(v) for v in x] for x in (consistent_forms(values), values))
            yield pa.RecordBatch.from_arrays([batch.column(0), _taken(form, pa.binary(), at), _taken(stored, pa.binary(), at)], ["doc_id", "form", "stored"])

    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return rows.mapInArrow(digests, "doc_id long, form binary, stored binary")


def _lists(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(form, stored, docs): the documents of a stored text in lists of at most ``LIST``, one or more a task, of the forms that several stored texts share."""
    gathered = looks(df, doc, text).withColumn("task", F.spark_partition_id()).groupBy("form", "stored", "task").agg(F.collect_list("doc_id").alias("docs"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("docs") - 1) / LIST).cast("int")), lambda i: F.slice("docs", i * LIST + 1, LIST))
    lists = staged(gathered.select("form", "stored", F.explode(cut).alias("docs")), "lists")
    several = lists.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where(F.col("lo") != F.col("hi"))
    kept = staged(lists.join(several.select("form", "blocks"), "form"), "lists")
    discard(lists)
    return kept


def same_looking_pairs(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents of equal form and different stored text, each pair once.

    Documents of one stored text are first gathered into short lists; only forms with several stored texts go on. The lists of a form are dealt to blocks of about
    ``BLOCK``, and each pair of blocks is a task's work of its own, so that neither the pairs of lists nor those of documents of a frequent form arise in
    one task; copies of one text never meet each other. Rows with a null doc_id or text are left out.
    """
    lists = _lists(df, doc, text).withColumn("block", F.pmod(F.xxhash64("stored", "docs"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    spread = lists.select("form", "stored", "docs", "block", F.explode(cells).alias("c")).select("*", "c.i", "c.j").drop("c")
    a = spread.select("form", "i", "j", F.col("stored").alias("a"), F.col("block").alias("block_a"), F.col("docs").alias("docs_a"))
    b = spread.select("form", "i", "j", F.col("stored").alias("b"), F.col("block").alias("block_b"), F.col("docs").alias("docs_b"))
    met = a.join(b, ["form", "i", "j"]).where((F.col("a") < F.col("b")) & ((F.col("i") == F.col("j")) | (F.col("block_a") != F.col("block_b"))))
    pairs = met.select(F.explode("docs_a").alias("x"), "docs_b").select("x", F.explode("docs_b").alias("y")).where(F.col("x") != F.col("y"))
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
