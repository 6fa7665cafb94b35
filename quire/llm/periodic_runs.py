"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

Words are what ASCII white space parts. A run is a longest stretch of words with
smallest period q, of ``least`` words or more and of 2q or more. The last square of a
run with period q begins at two suffixes that share exactly q words, so they lie in
different children of one LCP interval of depth q; every such branching square is found
from the arrays alone:

1. Suffixes are sorted by doubling; the ranks of every round are kept, so that the
   common prefix (or suffix) of any two places is a descent over rounds. A word's symbol
   holds its text's number: nothing is shared across texts sorted together.
2. An LCP interval is a boundary with the nearest smaller values around it. Of each
   interval all children but the largest are gone through: the square at suffix i of
   length 2 * depth branches if i + depth is in the interval and not in i's child, and
   likewise the one at i - depth; both are two looks at the inverse suffix array.
3. A square is rotated to the left as far as the words agree; squares with the same
   stretch are one run, with the smallest period.

Texts without two equal stretches of ``least`` / 2 words have no run and are not sorted.
Everything works on one text, or on several short ones together, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8
from .ngram_join import PLACE

LEAST = 12
SLICE = 1 << 19


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places after each round: round k tells places apart by their first 2**k symbols; the last is the inverse suffix array."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    head = np.append(True, symbols[order][1:] != symbols[order][:-1])[:n]
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(head)
    rank[order] = first[np.cumsum(head) - 1]
    size = np.diff(np.append(first, n))
    rounds, active, step = [rank], order[np.repeat(size > 1, size)], 1
    while len(active):
        inside = active + step < n
        after = np.zeros(len(active), np.int64)
        after[inside] = rank[active[inside] + step] + 1
        key = rank[active] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old, index = rank[active], np.arange(len(active))
        slot = old + index - np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), index, 0))
        head = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[active] = np.maximum.accumulate(np.where(head, slot, 0))
        rounds.append(rank)
        size = np.diff(np.append(np.flatnonzero(head), len(active)))
        active = active[np.repeat(size > 1, size)]
        step *= 2
    return rounds


def common_prefix(rounds: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols agree from places ``a`` and ``b`` on."""
    out, n = np.zeros(len(a), np.int64), len(rounds[0])
    for k in reversed(range(len(rounds))):
        i, j = a + out, b + out
        inside = (i < n) & (j < n)
        out += (inside & (rounds[k][np.where(inside, i, 0)] == rounds[k][np.where(inside, j, 0)])).astype(np.int64) << k
    return out


def common_suffix(rounds: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols agree before places ``a`` < ``b``."""
    out = np.zeros(len(a), np.int64)
    for k in reversed(range(len(rounds))):
        i, j = a - out - (1 << k), b - out - (1 << k)
        inside = i >= 0
        out += (inside & (rounds[k][np.where(inside, i, 0)] == rounds[k][np.where(inside, j, 0)])).astype(np.int64) << k
    return out


def _nearest(least: list[np.ndarray], at: np.ndarray, bound: np.ndarray, way: int) -> np.ndarray:
    """The nearest place beyond ``at`` (``way`` 1: after, -1: before) whose value is less than ``bound``; values at both ends are."""
    out, top = at + way, len(least[0]) - 1
    for j in reversed(range(len(least))):
        low = out if way > 0 else out - (1 << j) + 1
        high = low + (1 << j) - 1
        inside = (low >= 0) & (high <= top)
        out = np.where(inside & (least[j][np.where(inside, low, 0)] >= bound), out + way * (1 << j), out)
    return out


def branching_squares(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, period) of every branching square of ``symbols``, and the rounds of ranks."""
    rounds = suffix_ranks(symbols)
    n, inverse = len(symbols), rounds[-1]
    suffixes = np.empty(n, np.int64)
    suffixes[inverse] = np.arange(n)
    shared = np.full(n + 1, -1, np.int64)
    shared[1:n] = 0
    pairs = 1 + np.flatnonzero(rounds[0][suffixes[1:]] == rounds[0][suffixes[:-1]])
    shared[pairs] = common_prefix(rounds, suffixes[pairs - 1], suffixes[pairs])
    pairs = pairs[2 * shared[pairs] <= n]
    least = [shared]  # least[j][i]: the least value of places i to i + 2**j - 1
    while 2 << (len(least) - 1) <= n + 1:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    depth = shared[pairs]
    low, high = _nearest(least, pairs, depth, -1), _nearest(least, pairs, depth, 1) - 1
    # children: the one after every boundary, and the first one of every interval
    before, after = _nearest(least, pairs, depth + 1, -1), _nearest(least, pairs, depth + 1, 1) - 1
    first = before == low
    left = np.concatenate([pairs, low[first]])
    right = np.concatenate([after, pairs[first] - 1])
    of_low, of_high, of_depth = (np.concatenate([x, x[first]]) for x in (low, high, depth))
    if not len(left):
        return left, left, rounds
    order = np.lexsort((left - right, of_depth, of_low))  # an interval is known by its first rank and depth; its largest child comes first
    lead = np.append(True, (of_low[order][1:] != of_low[order][:-1]) | (of_depth[order][1:] != of_depth[order][:-1]))
    small = order[~lead]
    size = right[small] - left[small] + 1
    child = np.repeat(small, size)
    place = suffixes[np.repeat(left[small] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    starts, periods = [], []
    for way in (1, -1):
        to = place + way * of_depth[child]
        inside = (to >= 0) & (to < n)
        rank = inverse[np.where(inside, to, 0)]
        good = inside & (rank >= of_low[child]) & (rank <= of_high[child]) & ((rank < left[child]) | (rank > right[child]))
        starts.append(np.minimum(place, to)[good])
        periods.append(of_depth[child][good])
    return np.concatenate(starts), np.concatenate(periods), rounds


def word_runs(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of ``symbols``, by start, then period."""
    start, period, rounds = branching_squares(symbols)
    end = start + 2 * period
    start = start - common_suffix(rounds, start, start + period)
    long = end - start >= least
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    once = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[once], end[once], period[once]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _repeating(symbols: np.ndarray, of: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the texts (``of`` each symbol) that hold two equal stretches of ``width`` words, or seem to."""
    if len(symbols) <= width:
        return np.zeros(0, np.int64)
    x, n = symbols.astype(np.uint64), len(symbols) - width + 1
    windows = np.zeros(n, np.uint64)
    for j in range(width):
        windows += x[j : j + n] * PLACE[j]
    order = np.argsort(windows)
    return np.unique(of[order[1:][windows[order][1:] == windows[order][:-1]]])


def texts_runs(texts: list[list[bytes]], least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``word_runs`` of every list of words, sorted together."""
    none = (np.zeros(0, np.int64),) * 3
    symbols, base = [], 0
    for words in texts:
        number = {w: base + k for k, w in enumerate(dict.fromkeys(words))}
        symbols.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        base += len(number)
    out = [none] * len(texts)
    sizes = np.array([len(x) for x in symbols], np.int64)
    some = _repeating(np.concatenate(symbols), np.repeat(np.arange(len(texts)), sizes), least // 2) if symbols else ()
    if len(some):
        start, length, period = word_runs(np.concatenate([symbols[k] for k in some]), least)
        begin = np.concatenate([[0], np.cumsum(sizes[some])])
        cuts = np.searchsorted(start, begin)
        for k, b, i, j in zip(some, begin, cuts, cuts[1:]):
            out[k] = start[i:j] - b, length[i:j], period[i:j]
    return out


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_words, runs array<struct<start, length, period>>, collapsed) of every row of ``docs``.

    ``runs`` is in order of start, then period. ``collapsed`` is the text without the
    words that any run contains after that run's first period, joined by one space.
    Null and empty texts, and such of white space alone, have no words, no runs and an
    empty ``collapsed``. Rows that repeat get equal results, null keys are kept, other
    columns are left out whatever their names; an empty table gives none. A text is
    taken whole, in one task: about 300 bytes of memory a word where it has runs.
    ``least`` is even and at least 2.
    """
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE):
                texts = [data[a:b].tobytes().split() for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1])]
                found = texts_runs(texts, least)
                collapsed = []
                for words, (start, length, period) in zip(texts, found):
                    if len(start):
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, start + period, 1)
                        np.add.at(change, start + length, -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                    collapsed.append(b" ".join(words).decode())
                at = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])])
                parts = [pa.array(np.concatenate([f[k] for f in found])) for k in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(span)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()), lists, pa.array(collapsed, pa.string())], names=["k", "n", "r", "c"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(each, f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, ``text``): every row's text without the repetitions of its runs; a text without runs stays as it is, null too."""
    whole = docs.select(F.struct(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("body")).alias("row"), F.col(f"`{text}`").cast("string").alias("body"))
    found = periodic_runs(whole, "row", "body", least)
    return found.select(F.col("row.key").alias(key), F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("row.body")).alias(text))
