"""Evaluation texts that leaked into a corpus, found with an FM-index per shard of the corpus.

Documents are read in shards of at most ``SHARD_WORDS`` words (a longer document is cut into overlapping shards of its own). Each shard is indexed once: its
words, the last column of its suffix order and sampled places are a row of the index table. All phrases of a block of items (every run of ``WORDS`` words; the
whole of a shorter item) are searched backward in a shard, their occurrences located, and overlapping ones merged into spans. One block of items is searched as the
index arises; for more the index table is written to the shared folder and read once for each block. Nothing of the corpus is shuffled but the hits.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceframe.llm import fm_index
from spliceframe.llm.normalize import consistent, consistent_forms
from spliceframe.session import discard, hinted, staged

WORDS = 13
SHARD_WORDS = 250_000
#: items of a block, and bytes of their text
ITEM_ROWS = 50_000
ITEM_BYTES = 4 << 20

# Names of BBCode tags that count as markup also where no closing tag follows.
BBCODE = frozenset(
    "abbr acronym align attach audio b blockquote br center code color del email flash font google h1 h2 h3 h4 h5 h6 highlight hr html i img indent ins justify left li list mark media member mention noparse ol "
    "php post pre quote right s size spoiler strike sub sup table td th thread topic tr tt u ul url user video youtube".split()
)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|\[(?P<close>/?)(?P<name>\*|[A-Za-z][A-Za-z0-9]*)(?P<value>=[^\[\]]*)?\]", re.S)
_CLOSED = re.compile(r"\[/([A-Za-z][A-Za-z0-9]*)\]")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")


def _is_markup(closed: set[str]):
    """Of a match of _TAG: HTML tags are; of tags in brackets those that close, have a value, are known or are closed somewhere in the text."""
    return lambda m: m["name"] is None or bool(m["close"] or m["value"]) or m["name"] == "*" or m["name"].lower() in BBCODE or m["name"].lower() in closed


def _closed(text: str) -> set[str]:
    return {x.lower() for x in _CLOSED.findall(text)}


def without_markup(text: str) -> str:
    """HTML and BBCode tags as a space, entities as their character."""
    if "<" in text or "[" in text:
        markup = _is_markup(_closed(text))
        text = _TAG.sub(lambda m: " " if markup(m) else m[0], text)
    return _ENTITY.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


def words_of(texts: list[str]) -> list[list[str]]:
    """The words of each text: consistent form without markup, lower case, runs of letters (with their marks) and digits."""
    return [_WORD.findall(f.lower()) for f in consistent_forms([without_markup(t) for t in texts])]


def _units(text: str) -> list[tuple[str, int, int]]:
    """The text without markup as (characters, from, to): each piece with the place it has in the text."""
    spots = [(m.start(), m.end(), " ") for m in _TAG.finditer(text) if _is_markup(_closed(text))(m)] if "<" in text or "[" in text else []
    out, at = [], 0
    for begin, end, put in [*spots, (len(text), len(text), "")]:
        part = text[at:begin]
        done = 0
        for m in _ENTITY.finditer(part) if "&" in part else ():
            out += [(c, at + done + i, at + done + i + 1) for i, c in enumerate(part[done : m.start()])]
            out += [(c, at + m.start(), at + m.end()) for c in html.unescape(m[0])]
            done = m.end()
        out += [(c, at + done + i, at + done + i + 1) for i, c in enumerate(part[done:])]
        out += [(put, begin, end)] if put else []
        at = end
    return out


def word_places(text: str) -> list[tuple[int, int]]:
    """(from, to) in characters of the text for each of its :func:`words_of`; as many as there are words, or none if a piece can't be told from its neighbours."""
    pieces: list[list] = []
    for c, begin, end in _units(text):
        if pieces and (unicodedata.combining(c) or 0x1160 <= ord(c) <= 0x11FF or not consistent(c)):
            pieces[-1][0] += c
            pieces[-1][2] = end
        else:
            pieces.append([c, begin, end])
    whole, of = [], []
    for i, (c, _, _) in enumerate(pieces):
        form = consistent(c)
        whole.append(form)
        of += [i] * len(form)
    places = [(pieces[of[m.start()]][1], pieces[of[m.end() - 1]][2]) for m in _WORD.finditer("".join(whole))]
    return places if len(places) == len(words_of([text])[0]) else []


class _Phrases:
    """The words of a block of items as numbers; the phrases are made of them where they are searched."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        number: dict[str, int] = {}
        items = [(i, w) for i, w in items if w]
        self.flat = np.array([number.setdefault(w, len(number)) for _, words in items for w in words], np.int32)
        self.lengths = np.array([len(w) for _, w in items], np.int64)
        self.items = np.array([i for i, _ in items], np.int64)
        self.vocabulary = list(number)

    def by_length(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of phrases: matrix of their word numbers, each once; where the items of each begin in the list of items; that list."""
        begins = np.cumsum(self.lengths) - self.lengths
        sizes = np.minimum(self.lengths, WORDS)
        out = []
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            count = self.lengths[own] - size + 1
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins[own], count)
            matrix, phrase = np.unique(self.flat[at[:, None] + np.arange(size)], axis=0, return_inverse=True)
            held = np.unique(np.stack([phrase.ravel(), np.repeat(self.items[own], count)], 1), axis=0)
            out.append((matrix.astype(np.int64), np.searchsorted(held[:, 0], np.arange(len(matrix) + 1)), held[:, 1]))
        return out


@dataclass
class _Shard:
    """Documents under one index: their ids, hashes of their texts, the places where they begin, and the words of the index."""

    docs: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    vocabulary: pa.Array
    index: fm_index.FMIndex


def _hits(vocabulary: list[str], phrases: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shard: _Shard) -> tuple[np.ndarray, ...]:
    """(document number, item, first word, last word) of every occurrence of a phrase in a shard."""
    in_shard = pc.index_in(pa.array(vocabulary, pa.string()), value_set=shard.vocabulary)
    own = np.append(np.asarray(pc.fill_null(in_shard, -2)) + 1, -1)  # -1: a word the shard doesn't have
    out = []
    for matrix, begin, items in phrases:
        rows, low, high = fm_index.search(shard.index, own[matrix])
        of, at = fm_index.locate(shard.index, low, high)
        phrase = rows[of]
        count = begin[phrase + 1] - begin[phrase]
        each = np.repeat(np.arange(len(at)), count)
        item = items[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[phrase], count)]
        doc = np.searchsorted(shard.starts, at, "right") - 1
        word = at - shard.starts[doc]
        out.append((doc[each], item, word[each], word[each] + matrix.shape[1] - 1))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else [()] * 4))


def _merged(doc: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Overlapping or adjacent spans of a (document, item) as one."""
    order = np.lexsort((first, item, doc))
    doc, item, first, last = (x[order] for x in (doc, item, first, last))
    if not len(doc):
        return [doc, item, first, last]
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    step = np.cumsum(other) * (int(last.max()) + 2)  # lets one running maximum serve all groups
    reach = np.maximum.accumulate(last + step)
    begins = other | np.concatenate([[True], first[1:] + step[1:] > reach[:-1] + 1])
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], len(doc)) - 1
    return [doc[at], item[at], first[at], (reach - step)[ends]]


_INDEX = "docs array<long>, hashes array<long>, starts array<long>, skipped long, vocabulary array<string>, last binary, bits binary, places binary"
_SPANS = "doc_id long, hash long, item_id long, first_word int, last_word int"


def shard_indexes(docs: DataFrame) -> DataFrame:
    """The index table of (doc_id, text, hash): a row per shard, with ``skipped``, the words of a long document before its shard."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(ids: list[int], hashes: list[int], words: list[list[str]], skipped: int = 0) -> pa.RecordBatch:
            flat = pa.array([w for d in words for w in d], pa.string()).dictionary_encode()
            starts = np.concatenate([[0], np.cumsum(np.array([len(d) for d in words], np.int64) + 1)])
            symbols = np.zeros(int(starts[-1]), np.int32)
            inside = np.ones(len(symbols), bool)
            inside[starts[1:] - 1] = False
            symbols[inside] = np.asarray(flat.indices) + 1
            last, bits, places = fm_index.kept(symbols)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, hashes, starts)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([skipped], pa.int64()), pa.array([flat.dictionary.to_pylist()], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in (last, bits, places))], ["docs", "hashes", "starts", "skipped", "vocabulary", "last", "bits", "places"])

        ids, hashes, words, size = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for i, h, w in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), words_of(part.column(1).to_pylist())):
                    if len(w) > SHARD_WORDS:  # shards overlap by a phrase less a word, so that each place of a phrase lies whole in one
                        for begin in range(0, len(w), SHARD_WORDS):
                            yield row([i], [h], [w[begin : begin + SHARD_WORDS + WORDS - 1]], begin)
                        continue
                    if words and size + len(w) > SHARD_WORDS:
                        yield row(ids, hashes, words)
                        ids, hashes, words, size = [], [], [], 0
                    ids.append(i)
                    hashes.append(h)
                    words.append(w)
                    size += len(w)
        if words:
            yield row(ids, hashes, words)

    return docs.mapInArrow(index, _INDEX)


def _searched(indexes: DataFrame, items: list[tuple[int, list[str]]]) -> DataFrame:
    block = indexes.sparkSession.sparkContext.broadcast(_Phrases(items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, made = block.value, None
        for batch in batches:
            for r in range(batch.num_rows):
                made = phrases.by_length() if made is None else made
                lists = [np.asarray(batch.column(c)[r].values) for c in ("docs", "hashes", "starts")]
                words = batch.column("vocabulary")[r].values
                last, bits, places = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("last", np.int32), ("bits", np.uint8), ("places", np.int32)))
                shard = _Shard(*lists, words, fm_index.opened(last, bits, places, len(words) + 1))
                doc, item, first, end = _merged(*_hits(phrases.vocabulary, made, shard))
                skipped = batch.column("skipped")[r].as_py()
                columns = [pa.array(shard.docs[doc]), pa.array(shard.hashes[doc]), pa.array(item), pa.array((first + skipped).astype(np.int32)), pa.array((end + skipped).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "item_id", "first_word", "last_word"])

    return indexes.mapInArrow(search, _SPANS)


def _own(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, text, hash) of the documents with an id and a text; the hash tells texts under one id apart."""
    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.withColumn("hash", F.xxhash64("text"))


def _pieces(docs: DataFrame, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(doc_id, hash, item_id, first_word, last_word), merged within shards."""
    items = items.select(F.col(f"`{item}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = staged(items, "items")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = 1 if n <= ITEM_ROWS and size <= ITEM_BYTES else max(-(-2 * n // ITEM_ROWS), -(-2 * size // ITEM_BYTES))
    indexes = shard_indexes(docs)
    if blocks > 1:
        indexes = staged(indexes, "indexes")
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # at most about half the bound
        part = _searched(indexes, [(r["item_id"], w) for r, w in zip(own, words_of([r["text"] for r in own]))])
        out = part if out is None else out.unionByName(part)
    discard(items)
    return out


def _whole(pieces: DataFrame) -> DataFrame:
    """Pieces of a span that lie in different shards of a long document as one span."""
    group = Window.partitionBy("doc_id", "hash", "item_id")
    order = group.orderBy("first_word", "last_word")
    fresh = F.col("first_word") > F.coalesce(F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    marked = pieces.withColumn("_fresh", fresh.cast("int")).withColumn("_span", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "hash", "item_id", "_span").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word")).drop("_span")


def leaked_spans(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(doc_id, item_id, first_word, last_word): the spans of words, from 0, of a document that it shares with an item.

    Shared: ``WORDS`` or more consecutive words, or all words of a shorter item. Items without words match nothing. Rows with a null id or text are
    left out; repeated rows of a document give its spans once, different texts under one id each their own. Item tables of any size are searched, in blocks.
    """
    return _whole(_pieces(_own(docs, doc, text), items, item, item_text)).drop("hash")


def leaked_places(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """:func:`leaked_spans` with begin_char and end_char: the place of the span in the text, in characters from 0, the end excluded; cutting it out removes the span.

    Null where the words can't be told apart in the text (:func:`word_places`). The texts with a hit are read again.
    """
    own = _own(docs, doc, text)
    spans = staged(_whole(_pieces(own, items, item, item_text)), "spans")
    of = spans.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("item_id", "first_word", "last_word")).alias("spans"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                at = word_places(t)
                rows += [(d, x["item_id"], x["first_word"], x["last_word"], at[x["first_word"]][0] if at else None, at[x["last_word"]][1] if at else None) for x in found]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "item_id", "first_word", "last_word", "begin_char", "end_char"])

    met = own.join(hinted(staged(of, "spans-of")), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])
    return met.select("doc_id", "text", "spans").mapInArrow(place, "doc_id long, item_id long, first_word int, last_word int, begin_char int, end_char int")


def leaked(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(doc_id, item_id), each once."""
    return _pieces(_own(docs, doc, text), items, item, item_text).select("doc_id", "item_id").distinct()
