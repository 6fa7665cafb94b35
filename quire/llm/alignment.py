"""Alignment of two tokenizers' tokens over the bytes of every text, as an Arrow pipeline.

1. A batch's token ids are list columns: flattening them with their parent indices and
   a segmented cumulative sum of token byte lengths gives every token its end in its
   text. A hash join of both tokenizers' ends on (text, end) gives the cuts that both
   have (the groups), and with the ends of one side only, filled backwards, every
   overlapping pair of tokens once: a pair's common range ends where either token does.
2. ``Table.group_by`` counts a batch's pairs by text; each text keeps its different
   pairs and how often it holds them. These rows are stored once.
3. Spark counts the texts of every pair, from counts merged within each Arrow batch
   before the shuffle, and finds each first id's best count.
4. Every text's pairs are joined with the counts and added up. A table of counts of at
   most ``BROADCAST`` rows is broadcast; beyond that the join is a shuffle.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, slices, stored, utf8
from .packing import PLAIN

SLICE = 1 << 19
#: Rows of the pair counts that are broadcast (24 bytes each), words whose ids a task remembers.
BROADCAST, WORDS = 2_000_000, 1 << 18
#: White space on both sides of a space may make one token across words.
ACROSS = re.compile(r"\s \s")


class _Words(dict):
    """word -> ids; forgets all once it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS:
            self.clear()
        ids = self[word] = tuple(self.encode(word))
        return ids


def byte_level(entries: list[str]) -> list[bytes]:
    """Bytes of byte-level entries: printable Latin-1 characters are themselves, the others lie from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    to = {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}
    return [bytes(to[c] for c in entry) if all(c in to for c in entry) else entry.encode() for entry in entries]


def piece_bytes(pieces: list[str]) -> list[bytes]:
    """Bytes of pieces: <0xHH> is a byte, U+2581 a space."""
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]


@lru_cache(maxsize=2)
def first_tokenizer(path: str):
    """(text -> ids, bytes of all ids) of a byte-level BPE file; special tokens' strings are plain text.

    Words are encoded once and remembered where the text's spaces part them for sure.
    Plain characters go through the same vocabulary's ranks beside the file, if any.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    entries = [whole.id_to_token(i) for i in range(whole.get_vocab_size())]
    slow = lambda text: whole.encode(text, add_special_tokens=False).ids
    fast, ranks_path = slow, path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    words = _Words(lambda word: fast(" " + word))

    def encode(text: str) -> list[int]:
        if not PLAIN.fullmatch(text):
            return slow(" " + text)
        parts = text.split(" ")
        if "" in parts or ACROSS.search(text):
            return fast(" " + text)
        return list(itertools.chain.from_iterable(map(words.__getitem__, parts)))

    return encode, byte_level(entries)


@lru_cache(maxsize=2)
def second_tokenizer(path: str):
    """(text -> ids, bytes of all ids) of a piece model that puts a space before the text.

    If no piece of the model goes on after another character with a space, words are encoded once and remembered.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    parted = not any(re.search("[^▁]▁", p) for p in pieces)
    words = _Words(model.encode)

    def encode(text: str) -> list[int]:
        parts = text.split(" ")
        if not parted or "" in parts or "▁" in text:
            return model.encode(text)
        return list(itertools.chain.from_iterable(map(words.__getitem__, parts)))

    return encode, piece_bytes(pieces)


def token_ends(ids: pa.ListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(text, id, end) of every token: parent index, value, and bytes of its text up to its end."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(lengths.take(flat)).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], total])[ids.offsets.to_numpy()[:-1]]
    return parent, flat, total - before[parent.to_numpy()]


def align(a: pa.ListArray, b: pa.ListArray, lengths_a: pa.Array, lengths_b: pa.Array) -> pa.Table:
    """(at, a, b, a_ends, b_ends) of every overlapping token pair, ordered by ``at`` = text << 32 | end; both ends make a group's end.

    Texts whose two token lists differ in their sum of bytes must have been emptied before.
    """
    sides = []
    for ids, lengths in ((a, lengths_a), (b, lengths_b)):
        parent, flat, end = token_ends(ids, lengths)
        sides.append((pa.array((parent.to_numpy().astype(np.int64) << 32) | end), flat))
    left = pa.table({"at": sides[0][0], "a": sides[0][1]})
    right = pa.table({"at": sides[1][0], "b": sides[1][1]})
    both = left.join(right, "at", join_type="full outer", use_threads=False).combine_chunks()
    both = both.take(pa.array(np.argsort(both["at"].to_numpy(), kind="stable")))
    a_ends, b_ends = both["a"].is_valid(), both["b"].is_valid()
    return pa.table({"at": both["at"], "a": pc.fill_null_backward(both["a"]), "b": pc.fill_null_backward(both["b"]), "a_ends": a_ends, "b_ends": b_ends}).combine_chunks()


def _joined(ids: pa.Array, of: np.ndarray, n: int, mark: str, names: pa.Array) -> pa.Array:
    """Decimal ids in order, joined by ``mark`` within each of ``n`` groups (``of`` each id, ascending)."""
    offsets = np.searchsorted(of, np.arange(n + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(ids)), mark)


def group_texts(links: pa.Table, texts: int, names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(`a1,a2|b1;a3|b2,b3` of every text, its number of groups)."""
    a_ends, b_ends = (links[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("a_ends", "b_ends"))
    closed = a_ends & b_ends
    group = np.concatenate([[0], np.cumsum(closed)[:-1]]) if len(closed) else np.zeros(0, np.int64)
    n = int(closed.sum())
    sides = []
    for name, ends in (("a", a_ends), ("b", b_ends)):
        ids = links[name].combine_chunks().filter(pa.array(ends))
        sides.append(_joined(ids, group[ends], n, ",", names))
    each = pc.binary_join_element_wise(*sides, "|")
    of = (links["at"].to_numpy()[closed]) >> 32
    offsets = np.searchsorted(of, np.arange(texts + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each), ";"), np.diff(offsets)


def _same_bytes(ids: pa.ListArray, table: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each list's tokens make up a space and its text."""
    body = table.take(ids.values)
    ends = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
    joined = np.frombuffer(body.buffers()[2], np.uint8) if len(body) else np.zeros(0, np.uint8)
    cuts = ends[ids.offsets.to_numpy()]
    out = np.diff(cuts) == np.diff(offsets) + 1
    for k in np.flatnonzero(out):
        mine = joined[cuts[k] : cuts[k + 1]]
        out[k] = mine[0] == 32 and np.array_equal(mine[1:], data[offsets[k] : offsets[k + 1]])
    return out


def _lists(values: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    flat = np.fromiter(itertools.chain.from_iterable(values), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def aligned(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, n_a, n_b, n_groups, n_links, groups, pairs array<long>, times array<int>) of every row of ``docs``.

    ``first`` is the file of a byte-level BPE, ``second`` of a piece model; both encode a
    space and the text, special tokens' strings are plain text. ``groups`` names the ids
    between two cuts that both tokenizations have; ``pairs`` are the different pairs of
    overlapping tokens, the first's id << 32 | the second's, ``times`` how often each.
    ``row`` is a number of its own for every row. Null and empty texts, and such whose
    tokens do not give the text's bytes back, have no tokens. Texts are taken whole.
    Rows that repeat get equal results but for ``row``; null keys are kept; other
    columns are left out whatever their names.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode_a, bytes_a), (encode_b, bytes_b) = first_tokenizer(first), second_tokenizer(second)
        table_a, table_b = pa.array(bytes_a, pa.binary()), pa.array(bytes_b, pa.binary())
        lengths_a, lengths_b = pc.binary_length(table_a), pc.binary_length(table_b)
        names = pa.array([str(k) for k in range(max(len(bytes_a), len(bytes_b)))])
        number = itertools.count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                part, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                a, b = [encode_a(t) if t else [] for t in texts], [encode_b(t) if t else [] for t in texts]
                good = _same_bytes(_lists(a), table_a, part, ends) & _same_bytes(_lists(b), table_b, part, ends)
                a, b = (_lists([x if ok else [] for x, ok in zip(side, good)]) for side in (a, b))
                links = align(a, b, lengths_a, lengths_b)
                groups, n_groups = group_texts(links, j - i, names)
                of = links["at"].to_numpy() >> 32
                pair = (links["a"].to_numpy().astype(np.int64) << 32) | links["b"].to_numpy()
                counted = pa.table({"of": of, "pair": pair}).group_by(["of", "pair"], use_threads=False).aggregate([([], "count_all")])
                order = np.argsort(counted["of"].to_numpy(), kind="stable")
                counted = counted.take(pa.array(order)).combine_chunks()
                cuts = pa.array(np.searchsorted(counted["of"].to_numpy(), np.arange(j - i + 1)), pa.int32())
                pairs, times = (pa.ListArray.from_arrays(cuts, counted[c].combine_chunks().cast(kind)) for c, kind in (("pair", pa.int64()), ("count_all", pa.int32())))
                n_links = np.diff(np.searchsorted(of, np.arange(j - i + 1)))
                rows = pa.array(list(itertools.islice(number, j - i)), pa.int64())
                counts = [pa.array(np.diff(x.offsets.to_numpy()), pa.int64()) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), rows, *counts, pa.array(n_groups, pa.int64()), pa.array(n_links, pa.int64()), groups, pairs, times], names=["k", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(each, f"`{key}` {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many of ``rows`` each pair is, and whether no pair of its first id is in more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = pa.table({"pair": pc.list_flatten(batch.column(0))}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
            yield from counted.select(["pair", "count_all"]).rename_columns(["pair", "n"]).to_batches()

    merged = rows.select("pairs").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(merged, "pairs")
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    found = counts.withColumn("a", F.shiftright("pair", 32)).join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    out = stored(found, "pairs")
    forget(counts)
    return out


def alignment(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", groups: bool = True) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of every row of ``docs``; see ``aligned``.

    A pair's count is the number of rows that hold it. ``n_best`` counts a row's links
    whose count is the highest of their first id, ties included; ``count_sum`` adds up
    the counts of all its links. Without tokens all numbers are 0 and both texts empty.
    ``groups`` is left out on demand. An empty table gives none.
    """
    found = aligned(docs, first, second, key, text).withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(""))
    rows = stored(found if groups else found.drop("groups"), "aligned")
    counts = pair_counts(rows)
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.times")
    side = F.broadcast(counts) if counts.count() <= BROADCAST else counts
    sums = each.join(side, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    whole = rows.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.select(F.col(f"`{key}`"), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *(["groups"] if groups else []))
