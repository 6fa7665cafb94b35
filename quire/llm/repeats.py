"""Exact removal of repeated byte strings over a whole corpus, by suffix arrays.

A byte goes if a ``length``-byte string that covers it also starts anywhere else,
in another text or in the same one. Every such string ("window") is dealt with
exactly; what is hashed are 64-bit fingerprints of bytes.

1. *Segments.* A window's minimiser is its 32-byte string of least hash. Runs of
   windows with the same minimiser make a segment, about half a window long, so
   equal windows always meet under their minimiser's hash. What has a minimiser of
   its own is done with; of the rest, equal segments are stored once, with how
   often they occur.
2. *Suffix arrays.* Different segments of one minimiser are cut from the texts and
   brought together. A block of such groups becomes one string of content-defined
   phrases, sorted by linear grouping (``suffix_array``). A window is a run of whole
   phrases with some bytes before and after it. The interval of the sorted order
   whose suffixes share that run, read off the common prefixes, says which windows
   hold the same run; of these the few bytes around it are compared.
3. The segments of a minimiser that has more than ``group`` different ones are dealt
   with in bands: windows that start up to ``BAND`` bytes apart before the minimiser
   share all bytes but ``BAND`` at each end. A band whose shared bytes no other has is
   done with. Equal bands are settled whole and go on as one; what is left is halved
   until bands are equal, alone or one window wide (``_halved``). Every window is in
   one band of each width, so the rows never outnumber the windows.

Where texts end in a task does not matter: windows never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mix, random_words, slices, spread_join, stored, utf8
from .suffix_array import Sorted

LENGTH, GRAM, GROUP, BAND = 400, 32, 2048, 32
SLICE = 1 << 18
WINDOWS = 1 << 19
BLOCK = 1 << 18
BYTE, BASE = random_words(11, 256), random_words(12, 1)[0]
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LEAD, CUT = 8, 31


class Rolling:
    """Fingerprints of any substring of ``data``, equal for equal bytes wherever they lie."""

    def __init__(self, data: np.ndarray):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), BASE, np.uint64)]))
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), INVERSE, np.uint64)]))
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * up[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, in two sweeps over blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, minimiser's hash, segment's hash) of all segments of some texts."""
    if len(data) < length:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    roll, places = Rolling(data), np.arange(len(data) - GRAM + 1)
    hashed = roll.of(places, places + GRAM)
    low = np.uint64((1 << 20) - 1)
    least = _sliding_least((hashed & ~low) | places.astype(np.uint64), length - GRAM + 1)
    at = (least & low).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    valid = np.arange(len(at)) + length <= offsets[text + 1]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    ids = np.cumsum(new) - 1
    count = np.bincount(ids[valid], minlength=len(first))
    whole = roll.of(first, first + count - 1 + length)
    return text[first], first - offsets[text[first]], count, hashed[at[first]], mix(whole + (at[first] - first).astype(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first row, its first byte, bytes, offsets) in pieces of bounded size; long texts in overlapping ones."""
    for i, j in slices(offsets, SLICE):
        p, q = int(offsets[i]), int(offsets[j])
        if q - p <= WINDOWS + length:
            yield i, 0, data[p:q], offsets[i : j + 1] - p
        else:
            for w in range(0, q - p - length + 1, WINDOWS):
                part = data[p + w : min(q, p + w + WINDOWS + length - 1)]
                yield i, w, part, np.array([0, len(part)], np.int64)


def _segment_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for row, byte, part, ends in _pieces(data, offsets, length):
                text, first, count, key, whole = segments_of(part, ends, length)
                if len(text):
                    at = pa.array(text + row)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array((first + byte).astype(np.int32)), pa.array(count.astype(np.int32)), _signed(key), _signed(whole)], names=["r1", "r2", "start", "n", "gram", "whole"])

    return rows


def _cut_rows(length: int):
    """Bytes of the wanted segments of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py().encode()
                want = batch.column(3)[k].as_py()
                bodies = [text[w["start"] : w["start"] + w["n"] - 1 + length] for w in want]
                one = pa.array([k] * len(want))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(one), batch.column(1).take(one), *(pa.array([w[f] for w in want], t) for f, t in (("start", pa.int32()), ("n", pa.int32()), ("gram", pa.int64()), ("single", pa.bool_()), ("hot", pa.bool_()))), pa.array(bodies, pa.binary())], names=["r1", "r2", "start", "n", "gram", "single", "hot", "body"])

    return rows


def phrases(roll: Rolling, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, symbols): phrases end where the 8 bytes before hash to a multiple of CUT + 1.

    ``symbols[i]`` stands for the phrase from ``ends[i]`` to ``ends[i + 1]``; one that its
    segment's end cuts short has a symbol of its own and equals no other.
    """
    ends = np.arange(LEAD, size + 1)
    ends = ends[(roll.of(ends - LEAD, ends) & np.uint64(CUT)) == 0]
    holder = np.searchsorted(offsets, ends, side="left") - 1
    inside = ends - LEAD >= offsets[holder]
    ends, holder = ends[inside], holder[inside]
    symbols = np.empty(len(ends), np.int64)
    if len(ends):
        symbols[:-1] = (roll.of(ends[:-1], ends[1:]) >> np.uint64(1)).astype(np.int64)
        last = np.append(holder[1:] != holder[:-1], True)
        symbols[last] = -1 - np.arange(last.sum())
    return ends, symbols


def repeated_windows(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment, first byte in ``data``) of every window of the segments that occurs more than once among them."""
    count = np.diff(offsets) - length + 1
    start = np.repeat(offsets[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner = np.repeat(np.arange(len(count)), count)
    roll = Rolling(data)
    ends, symbols = phrases(roll, offsets, len(data))
    a = np.searchsorted(ends, start + LEAD)
    b = np.searchsorted(ends, start + length, side="right") - 1
    whole = b > a  # others hold no whole phrase: all their bytes are compared
    left, right = start + length, start + length
    left[whole], right[whole] = ends[a[whole]], ends[b[whole]]
    run = np.zeros(len(start), np.uint64)
    able = ~whole
    if whole.any():
        pairs, back = np.unique(a[whole] * len(ends) + b[whole], return_inverse=True)
        first, size = Sorted(symbols).interval(pairs // len(ends), pairs % len(ends) - pairs // len(ends))
        able[whole] = size[back] > 1
        run[whole] = mix(first.astype(np.uint64) * np.uint64(len(ends) + 1) + (pairs % len(ends) - pairs // len(ends)).astype(np.uint64))[back]
    start, owner, left, right, run = start[able], owner[able], left[able], right[able], run[able]
    same = mix(roll.of(start, left) + run) + roll.of(right, start + length)
    _, back, times = np.unique(same, return_inverse=True, return_counts=True)
    hit = times[back] > 1
    return owner[hit], start[hit]


def _runs(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return owner[first], start[first], np.diff(np.append(first, len(start)))


def _block_rows(length: int):
    """Repeated windows of segments that come grouped by minimiser; a block holds whole groups."""

    def settle(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        body = block.column("body")
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
        data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        owner, start, n = _runs(*repeated_windows(data, offsets, length))
        single = np.array(block.column("single").to_pylist(), bool)
        keep = single[owner]
        owner, start, n = owner[keep], start[keep], n[keep]
        if len(owner):
            at = pa.array(owner)
            begin = block.column("start").to_numpy()[owner] + (start - offsets[owner])
            yield pa.RecordBatch.from_arrays([block.column("r1").take(at), block.column("r2").take(at), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32))], names=["r1", "r2", "start", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            edges = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]
            if not len(gram):
                continue
            if held and size >= BLOCK and held[-1].column("gram")[-1].as_py() != int(gram[0]):
                yield from settle(held)
                held, size = [], 0
            for a, b in zip(edges, edges[1:]):
                if a and size >= BLOCK:
                    yield from settle(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += sum(len(x) for x in held[-1].column("body").to_pylist())
        if held:
            yield from settle(held)

    return rows


def _band_rows(length: int):
    """Every band of the segments of very common minimisers.

    Of the ``BAND`` windows that a band may have, its segment holds ``first`` to ``last``,
    from byte ``start`` on. ``shared`` stands for the bytes that all of the band's windows
    hold, ``before`` and ``after`` are what the segment's windows hold before and after them.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = length - GRAM + 1
        low = np.uint64((1 << 20) - 1)
        for batch in batches:
            for k in range(batch.num_rows):
                body = batch.column("body")[k].as_py()
                roll, places = Rolling(np.frombuffer(body, np.uint8)), np.arange(span)
                at = int((((roll.of(places, places + GRAM)) & ~low) | places.astype(np.uint64)).argmin())
                band = (at - np.arange(len(body) - length + 1)) // BAND
                begin = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
                end, band = np.append(begin[1:], len(band)) - 1, band[begin]
                near = at - band * BAND
                far = near - BAND + 1 + length
                shared = mix(roll.of(near, far) + mix(np.uint64(batch.column("gram")[k].as_py() & (1 << 64) - 1) + band.astype(np.uint64)))
                before, after = ([body[i:j] for i, j in zip(x.tolist(), y.tolist())] for x, y in ((begin, near), (far, end + length)))
                one = pa.array(np.zeros(len(begin), np.int64) + k)
                places = (pa.array(x.astype(np.int32)) for x in (begin + batch.column("start")[k].as_py(), begin + length - far, end + length - far))
                yield pa.RecordBatch.from_arrays([batch.column("r1").take(one), batch.column("r2").take(one), *places, batch.column("single").take(one), _signed(shared), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["r1", "r2", "start", "first", "last", "single", "shared", "before", "after"])

    return rows


ROW = "r1 long, r2 int"
BANDS = f"{ROW}, start int, first int, last int, single boolean, shared long, before binary, after binary"


def _halves(bands: DataFrame, half: int) -> DataFrame:
    """The earlier and the later ``half`` windows of bands twice as wide; ``shared`` takes in what each half's windows hold besides."""
    early = f"struct(r1, r2, start, first, least(last, {half - 1}) as last, single, xxhash64(shared, 0, substring(before, octet_length(before) - {half - 1}, {half})) as shared, substring(before, 1, octet_length(before) - {half}) as before, substring(after, 1, least(last, {half - 1})) as after)"
    late = f"struct(r1, r2, start + greatest({half} - first, 0) as start, greatest(first - {half}, 0) as first, last - {half} as last, single, xxhash64(shared, 1, substring(after, 1, {half})) as shared, substring(before, octet_length(before) - least({half - 1}, {2 * half - 1} - first) + 1) as before, substring(after, {half + 1}) as after)"
    return bands.select(F.explode(F.expr(f"array_compact(array(if(first < {half}, {early}, null), if(last >= {half}, {late}, null)))")).alias("half")).select("half.*")


def _halved(bands: DataFrame) -> list[DataFrame]:
    """(r1, r2, start, n), a table each width: windows of ``single`` segments that occur in more than one band. Forgets ``bands``."""
    found, width, same = [], BAND, ["shared", "first", "last", "before", "after"]
    while bands.limit(1).count():
        kinds = stored(bands.groupBy(*same).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("r1", "r2", "start", "single")).alias("one")), "kinds")
        again = spread_join(bands, kinds.where("times > 1").select(*same, "times"), same).where("single")
        found.append(stored(again.select("r1", "r2", "start", F.expr("last - first + 1").alias("n")), "again"))
        unlike = kinds.select("one.r1", "one.r2", "one.start", "first", "last", F.expr("one.single and times = 1").alias("single"), "shared", "before", "after")
        meet = stored(unlike.groupBy("shared").agg(F.count(F.lit(1)).alias("times"), F.max("single").alias("open")).where("times > 1 and open"), "meet")
        width //= 2
        left = stored(_halves(spread_join(unlike, meet.select("shared", "times"), ["shared"]), width), "bands")
        forget(bands, kinds, meet)
        bands = left
    forget(bands)
    return found


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """(r1, r2, body, row): a key from all text and values (rows that repeat whole share it and the same answer), and the other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rest = [F.to_json(F.struct(*(c.cast("string") for c in others)))] if others else []
    kept = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"), F.struct(F.col(f"`{text}`").isNull().alias("null"), F.struct(*(others or [F.lit(0)])).alias("of")).alias("row"), *(r.alias("rest") for r in rest))
    rest = ["rest"] if rest else []
    return kept.select(F.xxhash64("body", *rest).alias("r1"), F.hash(*rest, "body").alias("r2"), "body", "row")


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(r1, r2, spans array<struct<start, n>>) by row key: runs of n windows from byte ``start`` that occur elsewhere too."""
    return _repeats(_rows(docs, text), length, group)


def _repeats(keyed: DataFrame, length: int, group: int) -> DataFrame:
    body = keyed.select("r1", "r2", "body")
    found = stored(body.mapInArrow(_segment_rows(length), f"{ROW}, start int, n int, gram long, whole long"), "segments")
    grams = found.groupBy("gram").agg(F.count(F.lit(1)).alias("times"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("times > 1")
    grams = stored(grams.select("gram", "times", F.expr("low = high").alias("same")), "grams")
    met = stored(spread_join(found, grams, ["gram"]).select("r1", "r2", "start", "n", "gram", "whole", "same"), "met")
    forget(found, grams)
    unlike = met.where("not same")
    kinds = stored(unlike.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("r1", "r2", "start", "n")).alias("one")), "kinds")
    settled = met.where("same").select("r1", "r2", "start", "n")
    settled = settled.unionByName(spread_join(unlike, kinds.where("times > 1").select("gram", "whole", "times"), ["gram", "whole"]).select("r1", "r2", "start", "n"))

    mixed = stored(kinds.groupBy("gram").agg(F.min("times").alias("least"), F.count(F.lit(1)).alias("times")).where("least = 1"), "mixed")
    want = spread_join(kinds.select("gram", "one", (F.col("times") == 1).alias("single")), mixed.select("gram", "times"), ["gram"])
    want = want.select("one.*", "gram", "single", (F.col("times") > group).alias("hot"))
    want = want.groupBy("r1", "r2").agg(F.collect_list(F.struct("start", "n", "gram", "single", "hot")).alias("want"))
    cut = body.join(want, ["r1", "r2"]).select("r1", "r2", "body", "want")
    cut = stored(cut.mapInArrow(_cut_rows(length), f"{ROW}, start int, n int, gram long, single boolean, hot boolean, body binary"), "cut")

    near = cut.where("not hot").select("r1", "r2", "start", "gram", "single", "body").repartition("gram").sortWithinPartitions("gram")
    blocks = near.mapInArrow(_block_rows(length), f"{ROW}, start int, n int")
    halved = _halved(stored(cut.where("hot").select("r1", "r2", "start", "gram", "single", "body").mapInArrow(_band_rows(length), BANDS), "bands"))
    spans = settled.unionByName(blocks)
    for common in halved:
        spans = spans.unionByName(common)
    spans = stored(spans.groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "spans")
    forget(met, kinds, mixed, cut, *halved)
    return spans


def _covered(size: int, spans, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs under the spans' windows."""
    out: list[list[int]] = []
    for s in sorted(spans or (), key=lambda s: s["start"]):
        a, b = s["start"], s["start"] + s["n"] - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, group: int = GROUP, keep_text: bool = True) -> DataFrame:
    """Every row of ``docs`` without its repeated bytes.

    ``text`` becomes what is left (bytes of a character that a run's end cuts in
    two go too) unless ``keep_text`` is false, when the column is dropped. Added:
    ``n_bytes``, ``n_removed``, ``n_spans`` (long, of the UTF-8 bytes),
    ``kept_sha256`` of the exact bytes left and ``removed`` (array of byte runs).
    A null text counts as empty and stays null; texts shorter than ``length`` lose
    nothing; rows that repeat lose everything the repetition covers. Other columns
    are kept whatever their names, those of the names above replaced.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    docs = docs.drop(*(set(added) & set(docs.columns)))
    keyed = _rows(docs, text)
    joined = keyed.join(_repeats(keyed, length, group), ["r1", "r2"], "left").select("row", "body", "spans")
    others = [c for c in docs.columns if c != text]
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for was, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    body = was.encode()
                    gone = _covered(len(body), spans, length)
                    at = [0, *(x for pair in gone for x in pair), len(body)]
                    kept = b"".join(body[a:b] for a, b in zip(at[::2], at[1::2]))
                    left = None if not keep_text else was if not gone else kept.decode("utf-8", "ignore")
                    out.append((left, len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in gone]))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), run])]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["row", "left", *added])

    kind = joined.schema["row"].dataType.simpleString()
    done = joined.mapInArrow(rows, f"row {kind}, left string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")
    kept = [F.when(~F.col("row.null"), F.col("left")).alias(text)] if keep_text else []
    return done.select(*(F.col(f"row.of.`{c}`").alias(c) for c in others), *kept, *added)
