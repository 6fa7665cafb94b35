"""The corpus pipeline and the thin queries against a brute-force version on a small folder of tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quire.llm.queries import QUERIES

WORDS = [a + b + c for a in "bdkmst" for b in "aeiou" for c in ("n", "r", "st", "l")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ITEM = prose(500, 25)


def rows():
    base = {k: prose(k, 150) for k in range(40)}
    shared = prose(300, 140)
    out = []
    for k, t in base.items():
        if k % 8 == 0:
            t = t + " " + shared
        if k % 10 == 3:
            t = t + "\n" + ITEM + "\n" + prose(k + 900, 20)
        out.append((k, t))
    for k in range(0, 40, 4):  # near copies and exact copies
        words = dict(out)[k].split(" ")
        words[3] = "changed"
        out += [(100 + k, " ".join(words)), (200 + k, dict(out)[k])]
    return out + [(900, None), (901, ""), (902, "12 !!"), (903, prose(77, 4000))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "aa", "s", 0 if t is None else len(t)) for i, t in rows()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, prose(501, 25))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def grams(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_groups(docs):
    """Smallest id of each document's group, by all pairs."""
    sets, label = {i: grams(t) for i, t in docs.items()}, {i: i for i in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in docs}


def without_repeats(docs, length=400):
    bodies = {i: t.encode() for i, t in docs.items()}
    count = Counter(b[k : k + length] for b in bodies.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in bodies.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def pieces(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    reader, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, t in docs.items():
        ids = [*reader.encode(t, add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048
        cuts = sorted({0, first, *range(first, len(ids) + 1, 2048)})
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


def test_pipeline_equals_brute_force(spark, folder):
    docs = {i: t for i, t in rows() if t and re.search(r"[^\W\d_]", t)}
    label = near_groups(docs)
    docs = without_repeats({i: t for i, t in docs.items() if label[i] == i}, corpus_pipeline.REPEATED)
    docs = {i: t for i, t in docs.items() if ITEM not in t}
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces(docs)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_all_but_the_last_stage_return_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_query_columns(spark, folder):
    for name, columns in {
        "op1_ngram_join": ["doc_id", "rep", "class_id", "n_copies", "n_links"],
        "op2_media_columns": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        "op5_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    }.items():
        out = QUERIES[name](spark, folder)
        assert out.columns == columns and out.count() == len(rows())
    media = {r["doc_id"]: r for r in QUERIES["op2_media_columns"](spark, folder).collect()}
    assert media[901]["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest() and media[900]["tail_crc32"] == zlib.crc32(bytes(64))
