"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidate edges.

A text's set holds its runs of ``n`` words (A-Z lower-cased, words parted by ASCII
white space); one to n - 1 words make one shingle, a text without a word has an
empty set and is linked with nothing.

1. One permutation: a shingle's 64-bit hash names its bin and its value there, the
   least value of a bin stands for it. An empty bin takes the value of the first
   filled one along its own fixed sequence of probes (optimal densification), so each
   bin of two texts agrees with probability equal to their similarity.
2. Texts with equal sets are one class. Bins are cut into bands; classes with an equal
   band are a bucket, and each bucket gives one edge from its smallest class to every
   other one: edges grow with members, not with pairs.
3. Edges are verified on whole sets, in blocks of one centre and part of its star.
4. A star alone would lose a link between two members that are unlike their centre. A
   bucket of which some members are still apart is therefore verified in whole: its
   classes are dealt out by size and hash to parts, two parts that can hold linked sets
   are a block, and a block gives one row for each member that it joins to another.
5. Connected components of all verified links are the groups.

With ``bands`` of ``rows`` bins a pair of similarity s shares a bucket with
probability 1 - (1 - s**rows)**bands: 0.99999 at 0.85 for 24 bands of 6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, mix, random_words, slices, stored, utf8
from .ngram_join import PLACE, band_hashes, common_grams, sets

N, PERCENT, BANDS, ROWS = 3, 85, 24, 6
SLICE = 1 << 19
#: Members of a star's block; sets and shingles of a part of a bucket.
SPOKES, MOST, GRAMS = 256, 512, 1 << 20
#: Keys of texts to be fetched that are broadcast; more of them are joined by a shuffle.
BROADCAST = 1 << 22
BYTE = random_words(31, 256)
BYTE[[*range(9, 14), 32]] = 0
BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
EMPTY = np.uint64(1 << 32)


def one_permutation(grams: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """[texts, bins] least value of every bin, ``EMPTY`` where no shingle fell; each text's ``grams`` are sorted."""
    out = np.full((len(at) - 1) * bins, EMPTY, np.uint64)
    if len(grams):
        mixed = mix(grams)
        slot = np.repeat(np.arange(len(at) - 1), np.diff(at)) * bins + (((mixed >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, value = slot[order], (mixed & np.uint64(0xFFFFFFFF))[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        out[slot[first]] = np.minimum.reduceat(value, first)
    return out.reshape(-1, bins)


def densify(found: np.ndarray) -> np.ndarray:
    """``found`` with every empty bin filled along its probes; rows without any value stay empty."""
    bins, out = found.shape[1], found.copy()
    row, hole = np.nonzero((found == EMPTY) & (found != EMPTY).any(axis=1, keepdims=True))
    probe = 0
    while len(row):
        probe += 1
        at = (mix(hole.astype(np.uint64) * PLACE[50] + np.full(1, probe, np.uint64) * PLACE[51]) % np.uint64(bins)).astype(np.int64)
        value = found[row, at]
        good = value != EMPTY
        out[row[good], hole[good]] = value[good]
        row, hole = row[~good], hole[~good]
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, set_a, set_b, n_shingles, bands array<long>) of every row; a null text is empty, an empty set has no bands."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE):
                grams, at = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n, BYTE)
                a, b, size = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64), np.diff(at)
                full = np.flatnonzero(size)
                if len(full):
                    a[full] = np.add.reduceat(mix(grams + PLACE[40]), at[:-1][full])
                    b[full] = np.add.reduceat(mix(grams ^ PLACE[41]), at[:-1][full])
                keys = band_hashes(densify(one_permutation(grams, at, bands * rows))[full], bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size > 0)]) * bands, pa.int32()), _signed(np.ascontiguousarray(keys).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _signed(a), _signed(b), pa.array(size, pa.int64()), lists], names=["id", "a", "b", "n", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string")).mapInArrow(each, f"id {kind}, set_a long, set_b long, n_shingles long, bands array<long>")


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """(id, grams array<long>): every row's whole set, sorted as unsigned numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE):
                grams, at = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n, BYTE)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), _signed(grams))], names=["id", "g"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string")).mapInArrow(each, f"id {kind}, grams array<long>")


def _members(classes: DataFrame) -> DataFrame:
    """(bucket, rep, n_shingles, centre) of buckets of two classes or more; those with the same members are taken once.

    Hashes of different bands are apart, so a hash alone is a bucket.
    """
    buckets = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("centre"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("n > 1")
    once = sizes.groupBy("n", "centre", "x").agg(F.min("bucket").alias("bucket")).select("bucket", "centre")
    return buckets.join(once, "bucket").select("bucket", "rep", "n_shingles", "centre")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of one block each, from rows sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
            if held and tuple(marks[:, i]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = tuple(marks[:, i])
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _stars(members: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(a, b): the verified edges from the centre of every bucket to its other members."""
    hubs = members.where("rep = centre").select("centre", F.col("n_shingles").alias("centre_n")).distinct()
    sized = F.least("n_shingles", "centre_n") * 100 >= F.greatest("n_shingles", "centre_n") * percent
    edges = members.where("rep <> centre").select("centre", "rep", "n_shingles").distinct().join(hubs, "centre").where(sized).select("centre", "rep").distinct()
    counts = edges.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / SPOKES).cast("int").alias("parts"))
    dealt = edges.join(counts, "centre").select("centre", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), "rep")
    both = dealt.unionByName(counts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("rep")))
    whole = both.join(grams.withColumnRenamed("id", "rep"), "rep").select("centre", "part", "rep", "grams")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 2):
            ids, lists = block.column(2).combine_chunks(), block.column(3).combine_chunks()
            centre = block.column(0)[0].as_py()
            values, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            hubs = np.flatnonzero(ids.to_numpy() == centre)
            linked = np.zeros(len(sizes), bool)
            for hub in hubs:  # one, unless rows of different texts have the centre's key
                inside = np.isin(values, values[ends[hub] - sizes[hub] : ends[hub]])
                common = np.add.reduceat(inside, ends - sizes, dtype=np.int64)
                linked |= common * 100 >= (sizes + sizes[hub] - common) * percent
            linked[hubs] = False
            if linked.any():
                b = ids.filter(pa.array(linked))
                yield pa.RecordBatch.from_arrays([pa.array([centre] * len(b), b.type), b], names=["a", "b"])

    kind = members.schema["rep"].dataType.simpleString()
    return whole.repartition("centre", "part").sortWithinPartitions("centre", "part").mapInArrow(verified, f"a {kind}, b {kind}")


def _rest(members: DataFrame, grams: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels joined by a verified pair of a bucket that its star left apart.

    Classes of a bucket are dealt out by size class, within which and next to which
    alone two sets can be linked, and by hash to parts of about ``MOST`` sets or
    ``GRAMS`` shingles.
    """
    named = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    apart = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 and low <> high").select("bucket")
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-1.000001 * float(np.log(percent / 100)))).cast("int")
    open_ = named.join(apart, "bucket").select("bucket", "rep", "label", "n_shingles", level.alias("level"))
    parts = open_.groupBy("bucket", "level").agg(F.ceil(F.greatest(F.count(F.lit(1)) / MOST, F.sum("n_shingles") / GRAMS)).cast("int").alias("parts"))
    around = parts.select("bucket", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level"), F.col("level").alias("to"), F.col("parts").alias("others"))
    own = open_.join(parts, ["bucket", "level"]).withColumn("side", F.pmod(F.xxhash64("rep", F.lit(2)), "parts").cast("int"))
    met = own.join(around, ["bucket", "level"]).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    mine, theirs = F.struct("level", "side"), F.struct(F.col("to").alias("level"), F.col("with").alias("side"))
    low, high = F.least(mine, theirs), F.greatest(mine, theirs)
    block = met.select("bucket", low["level"].alias("l1"), low["side"].alias("s1"), high["level"].alias("l2"), high["side"].alias("s2"), "rep", "label", (mine == low).alias("first"))
    # a block that is one part twice holds each class once
    whole = block.join(grams.withColumnRenamed("id", "rep"), "rep").select("bucket", "l1", "s1", "l2", "s2", "label", "first", "grams")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 5):
            labels_of, lists = rows.column(5).combine_chunks(), rows.column(7).combine_chunks()
            label, first = labels_of.to_numpy(), rows.column(6).combine_chunks().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            same = all(rows.column(k)[0].as_py() == rows.column(k + 2)[0].as_py() for k in (1, 2))
            left, right = np.flatnonzero(first), np.arange(len(sizes)) if same else np.flatnonzero(~first)
            asked = label[left][:, None] != label[right][None, :]
            small, large = np.minimum(sizes[left][:, None], sizes[right][None, :]), np.maximum(sizes[left][:, None], sizes[right][None, :])
            asked &= small * 100 >= large * percent
            if not asked.any():
                continue
            p, q = asked.any(axis=1), asked.any(axis=0)
            left, right, asked = left[p], right[q], asked[p][:, q]
            common = common_grams(lists.flatten().to_numpy(), sizes, left, right)
            i, j = np.nonzero(asked & (common * 100 >= (sizes[left][:, None] + sizes[right][None, :] - common) * percent))
            if len(i):
                ends = np.unique(np.sort(np.stack([label[left[i]], label[right[j]]], axis=1), axis=1), axis=0)
                _, of = np.unique(ends[:, 1], return_index=True)  # a label with its smallest partner; the others follow through them
                more = np.setdiff1d(np.arange(len(ends)), of)
                at = np.concatenate([of, _spanning(ends, of, more)])
                yield pa.RecordBatch.from_arrays([pa.array(ends[at, 0], labels_of.type), pa.array(ends[at, 1], labels_of.type)], names=["a", "b"])

    kind = members.schema["rep"].dataType.simpleString()
    keys = ["bucket", "l1", "s1", "l2", "s2"]
    return whole.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(joined, f"a {kind}, b {kind}")


def _spanning(ends: np.ndarray, used: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Which of the edges ``more`` join what the edges ``used`` leave apart: a forest, so edges stay fewer than labels."""
    top: dict = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in ends[used]:
        top[find(a)] = find(b)
    out = []
    for k in more:
        a, b = find(ends[k, 0]), find(ends[k, 1])
        if a != b:
            top[a] = b
            out.append(k)
    return np.array(out, np.int64)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``.

    Two rows are linked if 100 * common shingles >= ``percent`` * shingles of either;
    ``component_id`` is the smallest key that links lead to, ``kept`` whether it is the
    row's own. Keys are integers. Null and empty texts have no shingles, are linked with
    nothing and kept. Rows that repeat get equal results; rows of one key with different
    texts count as linked. A null key takes part but leads nowhere: its row has the
    smallest key of its equals and of what they are linked to, null (and kept) if there
    is none. Other columns are left out, whatever their names; an empty table gives none.
    """
    signed = stored(signatures(docs, key, text, n, bands, rows), "signatures")
    some = signed.where("n_shingles > 0")
    classes = stored(some.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")).where("rep is not null"), "sets")
    members = stored(_members(classes), "members")
    wanted = stored(members.select(F.col("rep").alias("id")).distinct(), "wanted")
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(wanted, "id")
    repeated = signed.groupBy("id").count().where("count > 1 and id is not null").limit(1).count() > 0
    grams = stored(shingle_sets(texts.dropDuplicates(["id", "text"]) if repeated else texts, "id", "text", n), "grams")

    links = stored(_stars(members, grams, percent), "links")
    labels = components(links)
    more = stored(_rest(members, grams, labels, percent), "links")
    if repeated:
        own = some.join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).where("id <> rep").join(signed.groupBy("id").count().where("count > 1"), "id").select("id", "rep").distinct()
        for end in ("id", "rep"):
            own = own.join(labels.select(F.col("id").alias(end), "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
        more = stored(more.unionByName(own.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))), "links")
    further = components(more).select(F.col("id").alias("label"), F.col("label").alias("lowest"))
    forget(members, grams)
    named = classes.select("set_a", "set_b", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = named.join(further, "label", "left").select("set_a", "set_b", F.coalesce("lowest", "label").alias("component_id"))
    found = signed.select("id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
