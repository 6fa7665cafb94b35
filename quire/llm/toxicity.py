"""Toxic passages as maximum-scoring segments, calibrated by extreme-value statistics.

Words of labelled texts give log-odds between the two labels with a Dirichlet
prior (half a text and the word's background share, ``PRIOR`` for a word of all
texts, on either side); a word's score is the lower confidence bound of its log-odds, and so is that
of its beginnings, which stand in for inflected forms not seen. Of near copies with
one label, as told by one MinHash value of their word triples, one trains, so that
copies do not count as independent evidence. Words that score nothing cost ``GAP``. All
maximal scoring segments of a text are found in one pass (Ruzzo and Tompa); the
expected number of chance segments of score S in n words is K n exp(-lambda S)
(Karlin and Altschul), with lambda from the clean texts' score distribution and K
from their maximal segments. The best sum of normalised segment scores is turned
into a probability by logistic calibration on the training rows.

Training takes at most ``SAMPLE`` rows of either label; their counts are added up by
Spark, and the driver receives the scored terms, words of at least three of these
rows, and a histogram of a few hundred bins. Scoring covers every text whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, utf8
from .ngram_join import SLICE, minhash, ngrams

WORD = re.compile(r"\w+")
PRIOR, CONFIDENCE, LEAST_SCORE, GAP = 1.0, 1.64, 2.0, 0.5
PREFIXES = (5, 4, 3)
FLUSH = 300_000
SAMPLE = 30_000
FLOOR, CEILING, BIN = -15.0, 40.0, 0.25


@dataclass
class Model:
    terms: dict[str, float]  # a word, or a beginning followed by "*"
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    slope: float = 0.0
    bias: float = -5.0


class _Scores(dict):
    """word -> score, filled as words come; emptied when it has grown large."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms

    def __missing__(self, word: str) -> float:
        if len(self) > FLUSH:
            self.clear()
        found = self.terms.get(word)
        if found is None:
            found = next((s for n in PREFIXES if len(word) > n and (s := self.terms.get(word[:n] + "*"))), 0.0)
        self[word] = found
        return found


def maximal_segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, sum) of (from, to, score) items in order, in linear time."""
    kept: list[list[float]] = []  # from, to, sum before, sum with
    total = 0.0
    for a, b, s in scores:
        before, total = total, total + s
        if s <= 0:
            continue
        one = [a, b, before, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= one[2]:
                j = int(kept[j][4])
            if j < 0 or kept[j][3] >= one[3]:
                kept.append([*one, j])
                break
            one = [kept[j][0], one[1], kept[j][2], one[3]]
            del kept[j:]
    return [(int(k[0]), int(k[1]), k[3] - k[2]) for k in kept]


def segments_of(words: list[str], scores: _Scores) -> list[tuple[int, int, float]]:
    """Segments as (first word, word after the last, score)."""
    items: list[tuple[int, int, float]] = []
    last = 0
    for i, s in [(i, s) for i, w in enumerate(words) if (s := scores[w])]:
        if items and i > last:
            items.append((last, i, -GAP * (i - last)))
        items.append((i, i + 1, s))
        last = i + 1
    return maximal_segments(items)


def evidence(n_words: int, scores: list[float], rate: float, log_k: float) -> float:
    """The best sum of r normalised segment scores, with ln r! for their order; FLOOR without any."""
    best, total = FLOOR, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += rate * s - log_k - math.log(max(1, n_words)) + math.log(r)
        best = max(best, total)
    return min(best, CEILING)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean) numbers of texts that hold a word or begin one so; partial sums, flushed when large."""
    toxic: Counter[str] = Counter()
    clean: Counter[str] = Counter()

    def flush():
        words = list({**toxic, **clean})
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], names=["word", "toxic", "clean"])
        toxic.clear()
        clean.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own, words = (toxic if label == 1 else clean), {*WORD.findall(text.lower())}
            own.update(words)
            for n in PREFIXES:
                own.update({w[:n] + "*" for w in words if len(w) > n})
            if len(toxic) + len(clean) > FLUSH:
                yield flush()
    if toxic or clean:
        yield flush()


def _solve_rate(shares: list[tuple[float, float]]) -> float:
    """lambda with sum of share * exp(lambda * score) = 1; the mean score must be negative."""
    if not any(s > 0 and p > 0 for s, p in shares) or sum(s * p for s, p in shares) >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    grown = lambda x: sum(p * math.exp(min(500.0, x * s)) for s, p in shares)
    while grown(high) < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if grown(mid) < 1 else (low, mid)
    return low


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(slope, bias) by Newton's method on (x, label, count) with a slight ridge."""
    slope, bias = 0.0, 0.0
    for _ in range(60):
        g0 = g1 = 0.0
        h00 = h11 = 1e-2
        h01 = 0.0
        g1, g0 = -1e-2 * slope, -1e-2 * bias
        for x, y, n in bins:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + bias))))
            g1, g0 = g1 + n * (y - p) * x, g0 + n * (y - p)
            w = n * p * (1 - p)
            h11, h01, h00 = h11 + w * x * x, h01 + w * x, h00 + w
        det = h11 * h00 - h01 * h01
        step1, step0 = (h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det
        slope, bias = slope + max(-1.0, min(1.0, step1)), bias + max(-5.0, min(5.0, step0))
        if abs(step1) + abs(step0) < 1e-8:
            break
    return slope, bias


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, mark): one MinHash value of each text's word triples."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        marks = np.zeros(batch.num_rows, np.int64)
        for i, j in slices(offsets, SLICE):
            grams, at = ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 3)
            marks[i:j] = minhash(grams, at, 1)[:, 0]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(marks)], names=["key", "label", "mark"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", most: int = SAMPLE) -> Model:
    """A model from the texts of at most ``most`` rows of either label, 0 or 1, taken by the order of their keys' hashes.

    The bound keeps the sample's keys small enough to broadcast whatever the input's
    size, so texts are read where they lie. A null text is empty; keys without a text
    and other labels are left out. Without rows of both labels nothing scores.
    """
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null").distinct()
    sample = None
    for value in (0, 1):
        one = marked.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(most)
        sample = one if sample is None else sample.unionByName(one)
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    every = stored(texts.join(F.broadcast(sample), "key").select("key", "text", "label"), "sample")
    kind = every.schema["key"].dataType.simpleString()
    marks = every.select("key", F.lower("text"), "label").mapInArrow(_mark, f"key {kind}, label int, mark long")
    chosen = marks.groupBy("label", "mark").agg(F.min("key").alias("key")).select("key", "label").distinct()
    rows = every.join(F.broadcast(chosen), ["key", "label"], "left_semi").select("text", "label")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model({})
    n1, n0 = sizes[1], sizes[0]
    words = rows.mapInArrow(_count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words = stored(words, "words")
    prior = 0.5 + PRIOR * (F.col("toxic") + F.col("clean")) / float(n1 + n0)
    y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
    rest1, rest0 = F.greatest(n1 - F.col("toxic"), F.lit(0)) + 1.0, F.greatest(n0 - F.col("clean"), F.lit(0)) + 1.0
    odds = F.log(y1 / rest1) - F.log(y0 / rest0)
    scored = words.select("word", "toxic", "clean", (odds - CONFIDENCE * F.sqrt(1 / y1 + 1 / y0)).alias("score"))
    scored = scored.where((F.col("score") >= LEAST_SCORE) & (F.col("toxic") >= 3))
    top = scored.collect()
    model = Model({r["word"]: r["score"] for r in top})
    clean_words = words.where(~F.col("word").endswith("*")).agg(F.sum("clean")).first()[0] or 1
    hit = [(r["score"], (r["clean"] + 0.01) / clean_words) for r in top if not r["word"].endswith("*")]
    model.rate = _solve_rate([*hit, (-GAP, max(0.0, 1 - sum(p for _, p in hit)))])

    terms = rows.sparkSession.sparkContext.broadcast(model.terms)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(terms.value)
        for batch in batches:
            found = [(len(w), [s for _, _, s in segments_of(w, scores)]) for w in (WORD.findall(t.lower()) for t in batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.float64()))], names=["label", "n", "segments"])

    measured = stored(rows.mapInArrow(measure, "label int, n long, segments array<double>"), "segments")
    fit = measured.where("label = 0 and size(segments) > 0").agg(F.avg(model.rate * F.array_max("segments") - F.log("n")).alias("k")).first()["k"]
    model.log_k = (fit if fit is not None else 0.0) - 0.5772
    rate, log_k = model.rate, model.log_k

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [evidence(n, s, rate, log_k) for n, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(x / BIN) for x in xs], pa.int64())], names=["label", "bin"])

    bins = measured.mapInArrow(binned, "label int, bin long").groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    model.slope, model.bias = _logistic([(r["bin"] * BIN, r["label"], r["n"]) for r in bins])
    return model


def detect(docs: DataFrame, model: Model, text: str = "text", passages: bool = True) -> DataFrame:
    """Adds ``toxicity`` (0 to 1) and, if wanted, ``passages`` to every row.

    A passage is (first_word, end_word, score, expected), expected being the number
    of chance passages at least as high in a clean text of that length. Null and
    empty texts score as texts without passages. Columns of these names are
    replaced, others kept.
    """
    kept = docs.drop(*({"toxicity", "passages"} & set(docs.columns)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text)
    kind = "array<struct<first_word:int,end_word:int,score:double,expected:double>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "toxicity double", *([f"passages {kind}"] if passages else [])])
    passage = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scores = _Scores(own.terms)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                out, where = [], []
                for t in part.column(at).to_pylist():
                    words = WORD.findall(t.lower()) if t else []
                    found = segments_of(words, scores)
                    x = evidence(len(words), [s for _, _, s in found], own.rate, own.log_k)
                    out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, own.slope * x + own.bias)))))
                    if passages:
                        where.append([{"first_word": a, "end_word": b, "score": s, "expected": math.exp(min(700.0, own.log_k + math.log(len(words)) - own.rate * s))} for a, b, s in found])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64()), *([pa.array(where, passage)] if passages else [])], names=[*part.schema.names, "toxicity", *(["passages"] if passages else [])])

    return kept.mapInArrow(rows, schema)
