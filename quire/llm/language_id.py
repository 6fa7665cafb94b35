"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a context tree of up to ``order`` bytes, kept as sorted n-grams
of every length with their counts. With the statistics frozen after training, the
cost in bits of a byte follows escape method C: in the longest context that the
tree has, ``-log2 c/(n+d)`` if that context has seen the byte, else the escape cost
``-log2 d/(n+d)`` and its cost one byte shorter, down to 8 bits for any byte. The
language with the shortest code for the whole text wins.

Training is one pass over all labelled rows: tasks count n-grams by language, Spark
adds the counts up. The trees keep n-grams of at least a ``nodes``-th of all bytes
(of their language, divided among the languages), so all languages together have
``nodes`` n-grams of a length at most, whatever the input's size and however many
languages there are; this bounds what the driver gets and what is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, utf8

ORDER, NODES = 4, 1 << 20
SLICE, HELD = 1 << 20, 1 << 22
SPACE = 32
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Level:
    """The n-grams of one length of one language, and the contexts they extend."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order; ``levels[k][l]`` has the n-grams of k + 1 bytes of language l."""

    langs: list[str]
    levels: list[list[Level]]


def level_of(grams: np.ndarray, counts: np.ndarray) -> Level:
    """Costs by escape method C of sorted ``grams``, whose last byte is the coded one."""
    contexts, start, kinds = np.unique(grams >> 8, return_index=True, return_counts=True)
    total = np.add.reduceat(counts, start).astype(np.float64) if len(grams) else np.zeros(0)
    return Level(grams, np.log2(np.repeat(total + kinds, kinds)) - np.log2(counts), contexts, np.log2(total + kinds) - np.log2(kinds))


def _codes(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Every byte with the ``order`` bytes before it as one number; texts start after spaces."""
    n = len(offsets) - 1
    wide = np.full(len(data) + n * order, SPACE, np.int64)
    at = np.arange(len(data)) + np.repeat((np.arange(n) + 1) * order, np.diff(offsets))
    wide[at] = data
    out = wide[at]
    for back in range(1, order + 1):
        out |= wide[at - back] << (8 * back)
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray, order: int):
    """(first text, codes, where each text's codes begin and end) in pieces of bounded size; long texts in several."""
    for i, j in slices(offsets, SLICE):
        for p in range(int(offsets[i]), int(offsets[j]), SLICE):
            q = min(int(offsets[j]), p + SLICE)
            lead = min(order, p - int(offsets[i]))  # a later piece of a long text sees the bytes before it
            ends = np.clip(offsets[i : j + 1], p - lead, q) - (p - lead)
            yield i, _codes(data[p - lead : q], ends, order)[lead:], np.maximum(ends - lead, 0)


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Counts of one task's n-grams by language, given out whenever ``HELD`` different ones are held."""
    seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out(lang: str) -> pa.RecordBatch:
        grams, counts = seen.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

    for batch in batches:
        langs = batch.column(1)
        for lang in langs.unique().to_pylist():
            data, offsets = utf8(batch.column(0).filter(pa.compute.equal(langs, lang)))
            for _, codes, _ in _pieces(data, offsets, order):
                grams, counts = np.unique(codes, return_counts=True)
                if lang in seen:
                    grams, counts = np.concatenate([seen[lang][0], grams]), np.concatenate([seen[lang][1], counts])
                    grams, back = np.unique(grams, return_inverse=True)
                    counts = np.bincount(back, counts, len(grams)).astype(np.int64)
                seen[lang] = grams, counts
                if sum(len(g) for g, _ in seen.values()) > HELD:
                    yield out(max(seen, key=lambda k: len(seen[k][0])))
    for lang in [*seen]:
        yield out(lang)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, nodes: int = NODES) -> Model:
    """The context trees of all rows with a language and a text.

    Rows with a null text or language are left out; without any byte of text the
    model has no language.
    """
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = stored(rows.mapInArrow(partial(_count, order=order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngrams")
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs, levels = sorted(total), []
    least = counts.sparkSession.createDataFrame([(k, n * len(langs) / nodes) for k, n in total.items()], "lang string, least double")
    for k in range(order + 1):
        kept = counts.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        kept = kept.join(F.broadcast(least), "lang").where("n >= least").select("lang", "gram", "n").toArrow()
        which, grams, n = (kept.column(c).to_numpy() for c in ("lang", "gram", "n"))
        own = []
        for name in langs:
            mine = which == name
            by = np.argsort(grams[mine])
            own.append(level_of(grams[mine][by], n[mine][by]))
        levels.append(own)
    return Model(langs, levels)


def _find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``asked`` are among the sorted ``known``, and where."""
    if not len(known):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return known[at] == asked, at


def code_lengths(model: Model, codes: np.ndarray, lang: int) -> np.ndarray:
    """Bits of each of ``codes`` (a byte after its context) in language number ``lang``."""
    bits, open_ = np.zeros(len(codes)), np.arange(len(codes))
    for k in reversed(range(len(model.levels))):
        level, grams = model.levels[k][lang], codes[open_] & ((1 << 8 * (k + 1)) - 1)
        hit, at = _find(level.grams, grams)
        bits[open_[hit]] += level.bits[at[hit]]
        open_, grams = open_[~hit], grams[~hit]
        met, at = _find(level.contexts, grams >> 8)
        bits[open_[met]] += level.escapes[at[met]]
    bits[open_] += 8
    return bits


def _score(batches: Iterator[pa.RecordBatch], shared, at: int) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    langs, order = model.langs, len(model.levels) - 1
    for batch in batches:
        column = batch.column(at)
        data, offsets = utf8(column)
        bits = np.zeros((len(column), max(1, len(langs))))
        for i, codes, ends in _pieces(data, offsets, order) if langs else ():
            full = np.flatnonzero(np.diff(ends) > 0)
            kinds, back = np.unique(codes, return_inverse=True)
            for k in range(len(langs)):
                bits[i + full, k] += np.add.reduceat(code_lengths(model, kinds, k)[back], ends[full])
        least = bits.min(axis=1)
        share = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(axis=1)
        known = np.array([bool(t) and bool(langs) and LETTER.search(t) is not None for t in column.to_pylist()], bool)
        size = np.maximum(1, np.diff(offsets))
        out = [pa.array([langs[b] if k else "und" for b, k in zip(bits.argmin(axis=1), known)], pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(np.where(known, least / size, 0.0))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, "lang_pred", "lang_score", "bits_per_byte"])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``lang_score`` and ``bits_per_byte`` to every row.

    ``lang_pred`` is the language with the shortest code for the whole text (of
    equals the alphabetically first), ``und`` where the text is null or holds no
    letter; ``lang_score`` is 2 to the minus of its code length over the sum for
    all languages (0 for ``und``). Rows that repeat get the same answer. Columns of
    the same names are replaced, other columns are kept. The model is broadcast;
    ``train`` bounds its size.
    """
    kept = docs.drop(*({"lang_pred", "lang_score", "bits_per_byte"} & set(docs.columns)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string, lang_score double, bits_per_byte double"])
    return kept.mapInArrow(partial(_score, shared=shared, at=kept.columns.index(text)), schema)
