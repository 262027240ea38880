"""An FM-index over a shard of documents, as numpy arrays: suffix order, wavelet matrix of the last column, sampled positions.

The text of a shard is a sequence of symbols (words) 1 .. sigma-1; symbol 0 ends each document. Ends are ordered by document, so
suffixes of different documents never tie. Searches run for all phrases of one length at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SAMPLE = 16


@dataclass
class FMIndex:
    first: np.ndarray  # per symbol: suffixes that begin with a smaller one
    last: np.ndarray  # the symbol before each suffix, in suffix order
    ranks: list[np.ndarray]  # per level of the wavelet matrix: ones before each place
    zeros: list[int]
    marked: np.ndarray  # marked suffixes before each place
    places: np.ndarray  # text positions of the marked suffixes


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling; ends (0) count as different from each other, in text order."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (int(second.max(initial=0)) + 1) + second
        order = np.argsort(key)  # equal keys get one rank, so their order is of no matter
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = fresh
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        width *= 2


def kept(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is stored of the index of a text whose documents each end with 0: the last column, a bit for each marked suffix, and the places of those."""
    order = suffix_order(symbols)
    last = symbols[order - 1].astype(np.int32)  # the first document's start is preceded by the last end
    starts = np.concatenate([[True], symbols[:-1] == 0]) if len(symbols) else np.zeros(0, bool)
    sampled = (order % SAMPLE == 0) | starts[order]
    return last, np.packbits(sampled), order[sampled].astype(np.int32)


def opened(last: np.ndarray, bits: np.ndarray, places: np.ndarray, sigma: int) -> FMIndex:
    """The index with its ranks, from what is stored of it."""
    first = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=sigma))])
    ranks, zeros, level = [], [], last
    for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
        ones = (level >> bit) & 1
        ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.int32))
        zeros.append(len(level) - int(ranks[-1][-1]))
        level = np.concatenate([level[ones == 0], level[ones == 1]])
    sampled = np.unpackbits(bits, count=len(last))
    return FMIndex(first, last, ranks, zeros, np.concatenate([[0], np.cumsum(sampled, dtype=np.int64)]), places)


def build(symbols: np.ndarray, sigma: int) -> FMIndex:
    """The index of a text whose documents each end with 0."""
    return opened(*kept(symbols), sigma)


def _descend(index: FMIndex, symbols: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """Occurrences of each symbol in the last column before each of the places."""
    at = [np.zeros(len(symbols), np.int64), *places]
    levels = len(index.ranks)
    for k, (ones, zeros) in enumerate(zip(index.ranks, index.zeros)):
        one = ((symbols >> (levels - 1 - k)) & 1).astype(bool)
        at = [np.where(one, zeros + ones[p], p - ones[p]) for p in at]
    return [p - at[0] for p in at[1:]]


def search(index: FMIndex, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Backward search of phrases (rows of equally many symbols; -1: not in the shard): (row numbers found, from, to) in suffix order."""
    alive = np.flatnonzero((phrases >= 0).all(axis=1))
    low = index.first[phrases[alive, -1]]
    high = index.first[phrases[alive, -1] + 1]
    for j in range(phrases.shape[1] - 2, -1, -1):
        keep = high > low
        alive, low, high = alive[keep], low[keep], high[keep]
        symbol = phrases[alive, j]
        low, high = (index.first[symbol] + x for x in _descend(index, symbol, low, high))
    keep = high > low
    return alive[keep], low[keep], high[keep]


def locate(index: FMIndex, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, text position) of every suffix in the ranges: walks back to a sampled position."""
    count = high - low
    of = np.repeat(np.arange(len(low)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    found = np.empty(len(at), np.int64)
    open_, steps = np.arange(len(at)), 0
    while len(open_):
        here = index.marked[at + 1] > index.marked[at]
        found[open_[here]] = index.places[index.marked[at[here]]] + steps
        open_, at = open_[~here], at[~here]
        symbol = index.last[at]
        at = index.first[symbol] + _descend(index, symbol, at)[0]
        steps += 1
    return of, found
