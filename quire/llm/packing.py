"""Best-fit packing of token pieces into sequences, with Martello-Toth reduction.

Only the histogram of piece lengths, at most ``capacity`` counts, reaches the
driver. Equal lengths are interchangeable, so the packing is solved on that
histogram: dominance first fixes the small sets that no other choice beats,
best-fit decreasing packs the rest, both for all bins of one pattern at once.
The result is a short list of patterns with multiplicities. Each piece then
finds its place from its rank among the pieces of its length, which is counted
in salted groups, as many as the pieces need, so that a length that many share is
spread over tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CAPACITY, END_ID, GROUP = 2048, 0, 1 << 18
#: Beyond these characters the two tokenizer libraries may differ in Unicode tables; such texts take the slower one.
PLAIN = regex.compile("[\x00-\x7f¡-ſ–—‘-„•…]*")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of the tokenizer file at ``path``, as the ``tokenizers`` library gives them.

    Where every character is in ``PLAIN`` and no special token is spelt out, the
    same vocabulary's ranks (``.tiktoken`` beside the file) give the same ids at
    five times the speed; all other texts go through ``tokenizers`` itself.
    """
    import base64
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if "<|" not in text and PLAIN.fullmatch(text):
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32, token_ids): every text's ids and the end id, cut only if over ``capacity``.

    Of a longer document the first piece takes what does not fill whole pieces.
    A null text is empty and gives the end id alone.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                at, out = [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*(encode(text) if text else ()), END_ID], "<u4")
                    n, first = len(ids), len(ids) % capacity
                    cuts = [0, n] if n <= capacity else [0, *range(first or capacity, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        at.append(k)
                        out.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32)))
                if out:
                    piece, start, length, crc, ids = zip(*out)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["k", "p", "s", "l", "c", "i"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(rows, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, token_ids array<int>")


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed bins as (lengths, times), what is left): Martello and Toth's dominance on a histogram.

    For the largest length j, in turn: alone if nothing fits beside it; with the
    length that fills the bin exactly; with the largest fitting length k if no two
    lengths fit beside j, or if no three do and no fitting pair exceeds k. Each of
    these bins dominates every other bin that holds j, so all equal ones are fixed
    at once. A length that no rule settles is left over.
    """
    left = Counter({k: v for k, v in counts.items() if v})
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        times = min(left[k] // v for k, v in need.items())
        fixed.append((lengths, times))
        for k, v in need.items():
            left[k] -= v * times
            if not left[k]:
                sizes.remove(k)

    def smallest(n: int, without: int) -> int | None:
        """Sum of the n smallest pieces beside one of ``without``; None if there are fewer."""
        total = 0
        for k in sizes:
            some = min(n, left[k] - (k == without))
            total, n = total + some * k, n - some
            if not n:
                return total
        return None

    def best_pair(room: int, j: int) -> int:
        best = 0
        for a in sizes:
            if 2 * a > room:
                break
            i = bisect.bisect_right(sizes, room - a) - 1
            while i >= 0 and sizes[i] >= a:
                b = sizes[i]
                if all(left[x] - (x == j) >= n for x, n in Counter((a, b)).items()):
                    best = max(best, a + b)
                    break
                i -= 1
        return best

    for j in sorted(sizes, reverse=True):
        while left[j]:
            room = capacity - j
            fit = [k for k in (room,) if left[k] - (k == j) > 0]
            i = bisect.bisect_right(sizes, room) - 1
            while i >= 0 and left[sizes[i]] - (sizes[i] == j) <= 0:
                i -= 1
            k = sizes[i] if i >= 0 else None
            if k is None:
                take((j,))
            elif fit:
                take((j, room))
            else:
                two, three = smallest(2, j), smallest(3, j)
                if two is None or two > room or ((three is None or three > room) and best_pair(room, j) <= k):
                    take((j, k))
                else:
                    break
    return fixed, +left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: bins as (lengths, times)."""
    bins: dict[int, list[list]] = defaultdict(list)  # by room: [lengths, times]
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], times: int, room: int) -> None:
        if times:
            if room not in bins or not bins[room]:
                bisect.insort(rooms, room)
            bins[room].append([lengths, times])

    for j in sorted((k for k, v in counts.items() if v), reverse=True):
        n = counts[j]
        while n:
            i = bisect.bisect_left(rooms, j)
            if i < len(rooms):
                room = rooms[i]
                lengths, times = bins[room].pop()
                if not bins[room]:
                    rooms.pop(i)
            else:
                room, lengths, times = capacity, (), n
            each = min(room // j, n)
            use = min(times, n // each)
            n -= use * each
            if lengths:
                put(lengths, times - use, room)
            put(lengths + (j,) * each, use, room - each * j)
    return [(lengths, times) for group in bins.values() for lengths, times in group]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict]:
    """(bins, report): the reduction's fixed bins, then best fit for the rest, and a lower bound."""
    fixed, left = reduce_dominated(counts, capacity)
    bins = fixed + best_fit(left, capacity)
    total = sum(k * v for k, v in counts.items())
    return bins, {"bins": sum(t for _, t in bins), "fixed": sum(t for _, t in fixed), "lower_bound": -(-total // capacity)}


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored ``pieces`` (unique by their columns key and piece, with ``length``).

    ``pieces`` must give the same rows each time it is read, so pass a stored
    table. Rows that repeat and null keys are packed each on their own. No piece, no
    sequence. Other columns are kept, those of the added names replaced. Pieces of
    one length are ranked in ``salts`` groups, by default as many as keep a group
    near ``GROUP`` pieces even if all have one length.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop(*({"sequence_id", "offset"} & set(pieces.columns)))
    salts = salts or 1 + pieces.count() // GROUP
    whole, key = F.struct(*(F.col(f"`{c}`") for c in pieces.columns)).alias("whole"), F.col(f"`{pieces.columns[0]}`")
    salted = pieces.select(whole, key.alias("key"), "piece", "length", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).alias("salt"))
    groups = stored(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    bins, _ = plan_bins(counts, capacity)
    used, first, rows = Counter(), 0, []
    for lengths, times in bins:
        at = 0
        for length, each in Counter(lengths).items():
            rows.append((length, used[length], used[length] + each * times, first, each, at))
            used[length] += each * times
            at += length * each
        first += times
    spots = spark.createDataFrame(rows, "of long, from long, to long, bin long, each long, at long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("key", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    inside = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    placed = ranked.join(F.broadcast(spots) if len(rows) <= 200_000 else spots, inside)
    nth = F.col("rank") - F.col("from")
    return placed.select("whole.*", (F.col("bin") + F.floor(nth / F.col("each")).cast("long")).alias("sequence_id"), (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"))
