"""N-gram Jaccard join: MinHash banding, candidates verified on full n-gram sets.

Texts are lower-cased; a word is a run of ASCII letters and digits and of all
characters beyond ASCII. The n-gram set of a text holds the 64-bit hashes of its
runs of ``n`` words; one to n - 1 words make one n-gram, a text without a word
has none and equals only the same text.

1. One pass gives each text its set's 128-bit key and its band hashes. Texts with
   equal sets are one class from here on (its smallest id stands for it), however
   many copies there are.
2. Band hashes are grouped with map-side combining; buckets with the same members
   count as one. A bucket's members are dealt out to parts, and every two parts (and
   each part with itself) are a block.
3. A block has the whole sets of its members and verifies all pairs among them whose
   first common bucket it belongs to, so every pair that shares a bucket is verified
   once. A block gives its members' link counts and what they lead to, not its pairs:
   the rows grow with members, the comparisons with pairs.
4. Connected components of the verified links are the groups.

With ``bands`` of ``rows`` hashes a pair of similarity s shares a bucket with
probability 1 - (1 - s**rows)**bands: 0.9996 at 0.8 for 20 bands of 5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, mix, random_words, slices, stored, utf8

N, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 5
SLICE = 1 << 19
#: Sets and n-grams of a part of a bucket; columns of a block's matrix at a time.
MOST, GRAMS, WIDE = 512, 1 << 20, 1 << 12
#: Keys of texts to be fetched that are broadcast; more of them are joined by a shuffle.
BROADCAST = 1 << 22
BYTE = random_words(1, 256)
BYTE[[b for b in range(128) if not chr(b).isalnum()]] = 0
STEP, PLACE = random_words(2, 1)[0], random_words(3, 64)
SCALE, SHIFT = (random_words(s, 1024).astype(np.uint32) | np.uint32(1) for s in (4, 5))


def word_hashes(data: np.ndarray, offsets: np.ndarray, byte: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 places where texts begin among them; ``byte`` is 0 for what parts words."""
    inside = byte[data] != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = inside[begin]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    longest = int(place[inside].max()) + 1
    powers = np.cumprod(np.full(longest, STEP, np.uint64))
    values = byte[data] * powers[np.minimum(place, longest - 1)]
    return mix(np.add.reduceat(values, starts)), np.searchsorted(starts, offsets)


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int = N, byte: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's n-grams in order, and where each text's begin."""
    words, at = word_hashes(data, offsets, byte)
    count = np.diff(at)
    number = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.zeros(len(words) + n, np.uint64)
    for j in range(n):
        out[: len(words)][: len(words) - j] += words[j:] * PLACE[j]
    size = np.repeat(count, count)
    index = np.arange(len(words)) - np.repeat(at[:-1], count)
    for i in np.flatnonzero((count > 0) & (count < n)):
        own = words[at[i] : at[i + 1]]
        out[at[i]] = np.append(own * PLACE[: len(own)], PLACE[n + len(own)]).sum(dtype=np.uint64)
    keep = index < np.where(size >= n, size - n + 1, 1)
    return mix(out[: len(words)][keep]), np.concatenate([[0], np.cumsum(number)])


def sets(data: np.ndarray, offsets: np.ndarray, n: int = N, byte: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Like ngrams, each text's sorted and without repeats."""
    grams, at = ngrams(data, offsets, n, byte)
    each = [np.unique(grams[p:q]) for p, q in zip(at[:-1], at[1:])]
    return np.concatenate(each) if each else grams, np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def minhash(grams: np.ndarray, at: np.ndarray, hashes: int) -> np.ndarray:
    """[texts, hashes] MinHash values; 0 for a text without n-grams."""
    out = np.zeros((len(at) - 1, hashes), np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        x, starts = (grams >> np.uint64(32)).astype(np.uint32), at[:-1][full]
        for k in range(hashes):
            out[full, k] = np.minimum.reduceat(x * SCALE[k] + SHIFT[k], starts)
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[texts, bands] 64-bit hashes, those of different bands apart."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    return mix((parts * PLACE[:rows]).sum(axis=2, dtype=np.uint64) + PLACE[63] * np.arange(1, bands + 1, dtype=np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, set_a, set_b, n_grams, bands array<long>) of every row; a null text is empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE):
                part, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                grams, at = sets(part, ends, n)
                a, b = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    a[full] = np.add.reduceat(mix(grams + PLACE[40]), at[:-1][full])
                    b[full] = np.add.reduceat(mix(grams ^ PLACE[41]), at[:-1][full])
                for k in np.flatnonzero(np.diff(at) == 0):
                    digest = hashlib.blake2b(part[ends[k] : ends[k + 1]].tobytes(), digest_size=16).digest()
                    a[k], b[k] = np.frombuffer(digest, np.uint64)
                keys = band_hashes(minhash(grams, at, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * bands, pa.int32()), _signed(np.ascontiguousarray(keys).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _signed(a), _signed(b), pa.array(np.diff(at), pa.int64()), lists], names=["k", "a", "b", "n", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.lower(F.col(text).cast("string"))).mapInArrow(each, f"`{key}` {kind}, set_a long, set_b long, n_grams long, bands array<long>")


def ngram_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """(key, grams array<long>): every row's whole n-gram set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE):
                grams, at = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), _signed(grams))], names=["k", "g"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.lower(F.col(text).cast("string"))).mapInArrow(each, f"`{key}` {kind}, grams array<long>")


def _blocks(classes: DataFrame, bands: int) -> DataFrame:
    """(band, bucket, part, other, rep, side) of all members of buckets with two sets or more.

    Buckets with the same members are taken once, under their first band. A bucket
    is dealt out to parts of about MOST sets or GRAMS n-grams; a block holds two parts
    (or one, for the pairs inside it), and ``side`` tells which of them a row is in.
    """
    buckets = classes.where("n_grams > 0 and rep is not null").select("rep", "n_grams", F.posexplode("bands").alias("band", "bucket"))
    sizes = buckets.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("n > 1")
    once = sizes.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket", "size")).alias("b"))
    once = once.select("b.band", "b.bucket", F.ceil(F.greatest(F.col("n") / MOST, F.col("b.size") / GRAMS)).cast("int").alias("parts"))
    own = buckets.join(once, ["band", "bucket"]).withColumn("side", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("parts")).cast("int"))
    own = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return own.select("band", "bucket", F.least("side", "with").alias("part"), F.greatest("side", "with").alias("other"), "rep", "side")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block each, from rows sorted by their first four columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
            if held and tuple(marks[:, i]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = tuple(marks[:, i])
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def common_grams(grams: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """[left, right] how many n-grams two sets share; sets lie end to end in ``grams``, ``left`` and ``right`` number them."""
    _, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    row, more = np.repeat(np.arange(len(sizes)), sizes), count > 1
    keep = more[column]
    row, column = row[keep], (np.cumsum(more) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for c in range(0, int(more.sum()), WIDE):
        i, j = np.searchsorted(column, [c, c + WIDE])
        has = np.zeros((len(sizes), WIDE), np.float32)
        has[row[i:j], column[i:j] - c] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def _links(block: pa.Table, bands: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, jaccard) of a block's linked rows whose first common bucket is the block's own."""
    band, side = int(block.column(0)[0].as_py()), block.column(5).to_numpy()
    keys = block.column(6).combine_chunks().flatten().to_numpy().reshape(-1, bands)
    lists = block.column(7).combine_chunks()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    one, two = int(block.column(2)[0].as_py()), int(block.column(3)[0].as_py())
    left, right = np.flatnonzero(side == one), np.flatnonzero(side == two)
    asked = left[:, None] < right[None, :] if one == two else np.ones((len(left), len(right)), bool)
    for k in range(band):
        asked &= keys[left, k][:, None] != keys[right, k][None, :]
    asked &= np.minimum(sizes[left][:, None], sizes[right][None, :]) >= similarity * np.maximum(sizes[left][:, None], sizes[right][None, :]) - 1e-6
    if not asked.any():
        return (np.zeros(0, np.int64),) * 3
    p, q = asked.any(axis=1), asked.any(axis=0)
    left, right, asked = left[p], right[q], asked[p][:, q]
    common = common_grams(lists.flatten().to_numpy(), sizes, left, right)
    jaccard = common / (sizes[left][:, None] + sizes[right][None, :] - common)
    i, j = np.nonzero(asked & (jaccard >= similarity))
    return left[i], right[j], jaccard[i, j]


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, with_links: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(groups, links) of all rows of ``docs``.

    ``groups``: (key, rep, class_id, n_copies, n_links) a row of ``docs``: ``rep``
    is the smallest key with the same n-gram set, ``n_copies`` how many rows have
    that set, ``class_id`` the smallest key that links lead to, ``n_links`` how many
    other sets its set is linked to. ``links``: (a, b, jaccard), a < b, all verified
    pairs of reps that share a bucket; worked out only when it is read, as a group
    of m mutually similar sets has m * (m - 1) / 2 of them, and None without
    ``with_links``, when the tables behind it are deleted. Keys are integers; a null
    key takes part as a text of its own but stands for nothing (class_id null if all
    are null). Repeated rows count as copies. Empty tables give empty results.
    """
    signed = stored(signatures(docs, key, text, n, bands, rows).withColumnRenamed(key, "id"), "signatures")
    classes = stored(signed.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")), "sets")
    members = stored(_blocks(classes, bands), "members")

    wanted = stored(members.select(F.col("rep").alias("id")).distinct(), "wanted")
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id")
    if _repeats(signed):
        texts = texts.dropDuplicates(["id"])
    grams = stored(ngram_sets(texts, "id", "text", n), "grams")
    block = ["band", "bucket", "part", "other"]
    whole = members.join(grams.withColumnRenamed("id", "rep"), "rep").join(classes.select("rep", F.col("bands").alias("keys")), "rep")
    dealt = whole.select(*block, "rep", "side", "keys", "grams").repartition(*block).sortWithinPartitions(*block)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for every linked row of a block: how many links it has there, and a row they lead to."""
        for rows_of in _runs(batches):
            i, j, _ = _links(rows_of, bands, similarity)
            if len(i):
                label = np.arange(rows_of.num_rows)
                while True:
                    before = label.copy()
                    np.minimum.at(label, i, label[j])
                    np.minimum.at(label, j, label[i])
                    label = label[label]
                    if (label == before).all():
                        break
                count = np.bincount(np.concatenate([i, j]), minlength=len(label))
                linked = np.flatnonzero(count)
                ids = rows_of.column(4).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(linked)), ids.take(pa.array(label[linked])), pa.array(count[linked], pa.int64())], names=["id", "to", "n"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_of in _runs(batches):
            i, j, jaccard = _links(rows_of, bands, similarity)
            if len(i):
                ids = rows_of.column(4).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(jaccard, pa.float64())], names=["a", "b", "jaccard"])

    kind = docs.schema[key].dataType.simpleString()
    linked = stored(dealt.mapInArrow(ends, f"id {kind}, to {kind}, n long"), "linked")
    if with_links:
        links = dealt.mapInArrow(pairs, f"a {kind}, b {kind}, jaccard double").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
    else:
        links = None
        forget(members, grams)
    labels = components(linked.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    counts = linked.groupBy("id").agg(F.sum("n").alias("n_links"))
    named = classes.join(labels.join(counts, "id").withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("set_a", "set_b", "rep", F.coalesce("label", "rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    groups = signed.select("id", "set_a", "set_b").join(named, ["set_a", "set_b"])
    return groups.select(F.col("id").alias(key), "rep", "class_id", "n_copies", "n_links"), links


def _repeats(signed: DataFrame) -> bool:
    return signed.groupBy("id").count().where("count > 1").limit(1).count() > 0


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each group: that whose key is the group's class_id (a null key stays only if no other is in its group).

    All columns are kept unchanged, whatever their names.
    """
    groups, _ = ngram_join(docs, key, text, **settings, with_links=False)
    keep = groups.where(F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias("keep")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col(f"`{key}`").alias("key"))
    left = rows.join(keep, F.col("key").eqNullSafe(F.col("keep")), "left_semi")
    if groups.groupBy(key).count().where("count > 1").limit(1).count():
        left = left.dropDuplicates(["key"])
    return left.select("whole.*")
