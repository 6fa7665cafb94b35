"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns; results against brute force."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quire.llm import decontaminate, html_extract, language_id, licenses, media, ngram_join, packing, repeats, toxicity, warc
from quire.llm.queries import ORACLE_SQL, QUERIES
from quire.llm.suffix_array import Sorted, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in "bdkmst" for b in "aeiou" for c in ("n", "r", "st", "l")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [prose(k, 120) for k in range(6)]
    near = base[0].split()
    near[7] = "changed"
    shared = prose(99, 130)
    rows = [
        (1, base[0]),
        (2, " ".join(near)),
        (3, base[0]),
        (3, base[0]),  # a repeated row
        (4, None),
        (5, ""),
        (6, "!!! ??? ..."),
        (7, base[1] + " " + shared + " " + base[2]),
        (8, base[3] + "\n" + shared),
        (9, "two words"),
        (None, base[4]),
        (10, base[5] * 30),  # repeats itself
        (11, "é" * 900 + base[4][:50]),
        (12, "a" * 1500),
    ]
    return spark.createDataFrame([(i, t, "x", None, 0 if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


def table_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- n-gram join -------------------------------------------------------------------------------------------------
def grams(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_join_against_all_pairs(docs):
    groups, links = ngram_join.ngram_join(docs)
    got = groups.collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    classes = {r["doc_id"]: r["class_id"] for r in got}
    for a in texts:
        for b in texts:
            if a is None or b is None:
                continue
            x, y = grams(texts[a]), grams(texts[b])
            alike = (len(x & y) >= 0.8 * len(x | y)) if x and y else (texts[a] or "") == (texts[b] or "")
            assert (classes[a] == classes[b]) == alike, (a, b)
    assert classes[3] == classes[2] == 1 and classes[4] == classes[5] == 4
    assert links.count() == 1
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_copies"] == 3 and by[1]["n_links"] == 1 and by[9]["n_links"] == 0


def test_ngram_join_of_texts_on_one_long_template(spark):
    def own(k, n):
        return [f"w{k}x{i}" for i in range(n)]

    rows = [(2 * k + s, " ".join(own("t", 854) + own(f"f{k}", 45) + own(f"{k}s{s}", 105))) for k in range(150) for s in range(2)]
    groups, _ = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["class_id"] for r in groups.collect()} == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize("most", [512, 2])
def test_ngram_join_counts_every_link(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "MOST", most, raising=False)
    base = prose(7, 150).split()
    texts = {k: " ".join(base[:30] + ([f"new{k}"] if k else []) + base[30:] + [f"end{k}"] * (k > 3)) for k in range(5)}
    texts |= {10 + k: " ".join(base[:20] + base[20 + 12 * k :]) for k in range(1, 4)}  # a chain: its ends are unlike
    rows = [*texts.items(), (20, texts[2]), (21, prose(8, 60))]
    groups, links = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = {a: {b for b in texts if b != a and len(grams(texts[a]) & grams(texts[b])) >= 0.8 * len(grams(texts[a]) | grams(texts[b]))} for a in texts}
    assert all(len(want[k]) >= 4 for k in range(5))
    got = {r["doc_id"]: r["n_links"] for r in groups.collect()}
    assert got == {**{a: len(w) for a, w in want.items()}, 20: len(want[2]), 21: 0}
    assert sorted((r["a"], r["b"]) for r in links.collect()) == sorted((a, b) for a in want for b in want[a] if a < b)


def test_ngram_join_keeps_one_of_each_group(docs):
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] for r in kept.select("doc_id").collect()), key=repr) == sorted([1, 4, 6, 7, 8, 9, 10, 11, 12, None], key=repr)
    assert ngram_join.deduplicate(docs.limit(0)).count() == 0


def test_ngram_join_keeps_columns_of_any_name(docs):
    odd = docs.withColumns({c: F.lit(c) for c in ("_keep", "keep", "key", "whole", "id", "rep", "class_id", "band", "set_a")})
    kept = ngram_join.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == 10
    assert {tuple(r)[-9:] for r in kept.collect()} == {("_keep", "keep", "key", "whole", "id", "rep", "class_id", "band", "set_a")}


def test_band_settings_reach_the_recall():
    r = np.random.default_rng(1)
    found = 0
    for _ in range(200):
        both = r.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = np.unique(both[:360]), np.unique(both[40:])  # similarity 0.8
        s = ngram_join.minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 100)
        keys = ngram_join.band_hashes(s, 20, 5)
        found += bool((keys[0] == keys[1]).any())
    assert found >= 197


# --- repeated strings --------------------------------------------------------------------------------------------
def brute_repeats(rows, length=400):
    count = Counter(b[k : k + length] for _, b in rows for k in range(len(b) - length + 1))
    out = []
    for key, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((key, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [2048, 0])
def test_repeats_against_every_window(docs, group):
    got = repeats.remove_repeats(docs, group=group)
    assert got.columns == [*("doc_id", "lang", "source", "n_chars", "text"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    want = brute_repeats([(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()])
    assert table_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert got.where("doc_id = 4 and text is null").count() == 1


@pytest.mark.parametrize("length", [47, 400])
def test_repeats_of_near_copies_by_halved_bands(spark, length):
    r = random.Random(length)
    base, rows = prose(31, 200), []
    for k in range(50):
        text = list(base[r.randrange(80) :][: 1000 - r.randrange(80)])
        for _ in range(r.randrange(5)):
            text[r.randrange(len(text))] = r.choice("xyz")
        rows.append((k, "".join(text)))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "id long, text string"), length=length, group=0)
    assert table_of(got, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats([(k, t.encode()) for k, t in rows], length)


def test_common_passages_make_fewer_rows_than_windows(spark, monkeypatch):
    made, passage = {}, prose(41, 120)
    rows = [(k, prose(500 + k, 60) + passage + prose(900 + k, 60)) for k in range(60)]
    store = repeats.stored

    def counted(df, tag):
        out = store(df, tag)
        made[tag] = max(made.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(repeats, "stored", counted)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "id long, text string"), group=0)
    assert table_of(got, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats([(k, t.encode()) for k, t in rows])
    windows = 60 * (len(passage) - 399)
    assert made["cut"] and max(made.values()) < windows / 4, made


def test_repeats_on_nothing(docs):
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_are_cut_in_pieces(monkeypatch):
    data = np.frombuffer(prose(5, 3000).encode(), np.uint8)
    monkeypatch.setattr(repeats, "WINDOWS", 1000)
    pieces = list(repeats._pieces(data, np.array([0, len(data)]), 400))
    assert len(pieces) > 5 and {w for _, w, _, _ in pieces} == set(range(0, len(data) - 399, 1000))


def test_linear_grouping_sorts_suffixes():
    r = random.Random(3)
    for _ in range(400):
        s = [r.randint(0, r.choice([1, 3, 8])) for _ in range(r.randint(0, 60))]
        assert suffix_array(np.array(s, np.int64)) == sorted(range(len(s)), key=lambda i: s[i:])
    made = Sorted(np.array([1, 2, 3, 9, 1, 2, 3, 4]))
    first, number = made.interval(np.array([0, 4, 0, 2, 3]), np.array([3, 3, 4, 1, 1]))
    assert first[0] == first[1] and number.tolist() == [2, 2, 1, 2, 1]


def test_repeated_windows_come_from_the_sorted_order(monkeypatch):
    texts = [prose(k, 60) + " " + prose(900 + k // 3, 90) + " " + prose(50 + k, 60) for k in range(9)]
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    count = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    want = [(i, int(ends[i]) + k) for i, t in enumerate(texts) for k in range(len(t) - 199) if count[t[k : k + 200]] > 1]
    find = lambda: sorted(zip(*(x.tolist() for x in repeats.repeated_windows(data, ends, 200))))
    assert want and find() == want
    monkeypatch.setattr("quire.llm.suffix_array.suffix_array", lambda symbols: list(range(len(symbols))))
    assert find() != want


def test_repeats_keep_columns_of_any_name(docs):
    odd = docs.withColumns({"spans": F.lit("mine"), "_r1": F.lit("mine too"), "row": F.lit(1), "null": F.lit(2), "of": F.lit(3), "body": F.lit("b"), "r1": F.lit(4)})
    got = repeats.remove_repeats(odd)
    assert got.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "text"]
    assert {tuple(r) for r in got.select("spans", "_r1", "row", "null", "of", "body", "r1").collect()} == {("mine", "mine too", 1, 2, 3, "b", 4)}
    assert table_of(got, "doc_id", "kept_sha256") == table_of(repeats.remove_repeats(docs), "doc_id", "kept_sha256")


# --- language ----------------------------------------------------------------------------------------------------
def brute_bits(model_text, text, order, nodes):
    """Escape method C, byte by byte, from dictionaries."""
    seen = {k: Counter() for k in range(order + 1)}
    for body in model_text:
        wide = b" " * order + body.encode()
        for i in range(order, len(wide)):
            for k in range(order + 1):
                seen[k][wide[i - k : i + 1]] += 1
    total = sum(seen[0].values())
    seen = {k: {g: n for g, n in c.items() if n >= total / nodes} for k, c in seen.items()}
    wide, bits = b" " * order + text.encode(), 0.0
    for i in range(order, len(wide)):
        for k in range(order, -1, -1):
            own = {g: n for g, n in seen[k].items() if g[:-1] == wide[i - k : i]}
            n, d = sum(own.values()), len(own)
            gram = wide[i - k : i + 1]
            if gram in own:
                bits += np.log2((n + d) / own[gram])
                break
            bits += np.log2((n + d) / d) if d else 0
        else:
            bits += 8
    return bits


def test_language_code_lengths_against_brute_force(spark):
    texts = [prose(k, 15) + " naïve Ünïcode" for k in range(6)]
    rows = spark.createDataFrame([(k, t, "aa") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    for nodes in (1 << 20, 150):
        model = language_id.train(rows, order=3, nodes=nodes)
        for text in (texts[0], prose(40, 8), "жш zz", ""):
            data = np.frombuffer(text.encode(), np.uint8)
            codes = language_id._codes(data, np.array([0, len(data)]), 3)
            assert language_id.code_lengths(model, codes, 0).sum() == pytest.approx(brute_bits(texts, text, 3, nodes))


def test_long_texts_score_as_in_one_piece(spark, monkeypatch):
    rows = [(k, prose(k, 60), "aa") for k in range(5)] + [(9, prose(9, 60).upper(), "zz")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    batch = pa.RecordBatch.from_arrays([pa.array([None, prose(3, 300), "", prose(4, 20).upper(), prose(5, 40)])], names=["text"])
    shared = type("Shared", (), {"value": model})
    whole = next(language_id._score(iter([batch]), shared, 0)).to_pydict()
    monkeypatch.setattr(language_id, "SLICE", 100)
    cut = next(language_id._score(iter([batch]), shared, 0)).to_pydict()
    assert cut["lang_pred"] == whole["lang_pred"] == ["und", "aa", "und", "zz", "aa"] and cut["bits_per_byte"] == pytest.approx(whole["bits_per_byte"])


def test_as_many_languages_as_there_are(spark):
    letters = [chr(c) for c in (*range(0x410, 0x44F), *range(0x3B1, 0x3C9), *range(0x5D0, 0x5EA))]
    rows = [(k, " ".join(a * n for n in range(1, 9)), f"l{k:03}") for k, a in enumerate(letters)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == len(letters) > 100
    got = language_id.identify(spark.createDataFrame([(k, a * 4) for k, a in enumerate(letters)], "doc_id long, text string"), model).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id']:03}" for r in got)


def test_language_identification(spark, docs):
    rows = [(k, prose(k, 60), "aa") for k in range(20)] + [(k + 100, prose(k, 60).replace("a", "ü").replace("s", "z"), "zz") for k in range(20)]
    rows += [(200, None, "aa"), (201, "x", None), (202, "", "bb")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "zz"]
    test = spark.createDataFrame([(1, prose(77, 40), 5), (2, prose(78, 40).replace("a", "ü").replace("s", "z"), 5), (3, None, 5), (4, "", 5), (5, "123 !!", 5), (6, prose(79, 90_000), 5), (6, prose(79, 90_000), 5)], "doc_id long, text string, lang_pred int")
    assert language_id.identify(test.limit(0), model).count() == 0
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language_id.identify(test, model).collect()}
    assert [got[k][0] for k in range(1, 7)] == ["aa", "zz", "und", "und", "und", "aa"]
    assert all(0 <= s <= 1 for _, s in got.values())
    twins = spark.createDataFrame([(k, "same words", lang) for k, lang in enumerate(["bb", "aa"])], "doc_id long, text string, lang string")
    tie = language_id.identify(spark.createDataFrame([(1, "same words")], "doc_id long, text string"), language_id.train(twins)).first()
    assert tie["lang_pred"] == "aa" and tie["lang_score"] == 0.5
    none = language_id.train(docs.limit(0))
    assert none.langs == [] and {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


# --- toxicity ----------------------------------------------------------------------------------------------------
def brute_segments(scores):
    """Maximal segments by definition: best segment, then the same left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return brute_segments(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_maximal_segments_by_definition():
    r = random.Random(4)
    for _ in range(300):
        s = [r.uniform(-4, 4) for _ in range(r.randint(0, 14))]
        got = toxicity.maximal_segments([(i, i + 1, x) for i, x in enumerate(s)])
        assert [x[2] for x in got] == pytest.approx([x[2] for x in brute_segments(s)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(s)]


def test_toxicity_learns_and_finds(spark):
    def row(k):
        words = prose(k, 80).split()
        if k % 4 == 0:
            words[20:20] = ["vilefool", "vilething"]
        return (k, " ".join(words), int(k % 4 == 0))

    train = spark.createDataFrame([row(k) for k in range(160)] + [(900, None, 0)], "doc_id long, text string, toxic int")
    model = toxicity.train(train, train.select("doc_id", "toxic"))
    test = spark.createDataFrame([(*row(k)[:2], 1.0) for k in range(200, 240)] + [(1, None, 0.0), (2, "", 0.0)], "doc_id long, text string, toxicity double")
    got = {r["doc_id"]: r for r in toxicity.detect(test, model).collect()}
    assert all((got[k]["toxicity"] >= 0.5) == (k % 4 == 0) for k in range(200, 240))
    assert got[1]["toxicity"] < 0.5 and got[2]["passages"] == []
    spot = got[200]["passages"][0]
    assert spot["first_word"] == 20 and spot["end_word"] == 22
    empty = toxicity.train(train, train.limit(0))
    assert toxicity.detect(test, empty).where("toxicity >= 0.5").count() == 0


# --- packing -----------------------------------------------------------------------------------------------------
def test_packing_places_every_piece(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    kept = packing.token_pieces(docs, path, capacity=64).cache()
    packed = packing.pack(kept, capacity=64).collect()
    assert len(packed) == kept.count()
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = [*reader.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 64 if len(ids) > 64 else len(ids)
        at = 0
        for k, n in enumerate(([first] if first else []) + [64] * ((len(ids) - first) // 64)):
            want[r["doc_id"], k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(kept.limit(0), capacity=64).count() == 0


def test_packing_keeps_columns_of_any_name(spark):
    rows = [(k % 7 if k % 5 else None, 0, k, 1 + k % 3, "s", k) for k in range(60)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, _salt string, offset int").withColumns({"rank": F.lit(1), "bin": F.lit(2), "whole": F.lit(3), "key": F.lit(4), "n": F.lit(5)})
    got = packing.pack(pieces, capacity=4, salts=3)
    assert got.columns == ["doc_id", "piece", "start", "length", "_salt", "rank", "bin", "whole", "key", "n", "sequence_id", "offset"]
    assert sorted(r["start"] for r in got.collect()) == list(range(60))
    assert {tuple(r) for r in got.select("_salt", "rank", "bin", "whole", "key", "n").collect()} == {("s", 1, 2, 3, 4, 5)}
    fill = Counter()
    for r in got.collect():
        fill[r["sequence_id"]] += r["length"]
    assert len(fill) == 30 and set(fill.values()) == {4}


def least_bins(sizes, capacity):
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= sizes[k]:
                place(k + 1, [*rooms[:i], room - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_reduction_never_costs_a_bin():
    r = random.Random(5)
    for _ in range(150):
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 8))), reverse=True)
        fixed, left = packing.reduce_dominated(Counter(sizes), 20)
        assert all(sum(b) <= 20 for b, _ in fixed)
        used = Counter(x for b, t in fixed for x in b for _ in range(t))
        assert used + Counter(left) == Counter(sizes)
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(t for _, t in fixed) + (least_bins(rest, 20) if rest else 0) == least_bins(sizes, 20)


def test_special_tokens_and_rare_characters_use_the_reference_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, fast = Tokenizer.from_file(path), packing.encoder(path)
    for text in ["plain text, and 123!", "<|endoftext|> x", "éàü ñ", "日本語 текст", "a b  \n\n c", "💥 boom", "don't   stop\t"]:
        assert list(fast(text)) == slow.encode(text, add_special_tokens=False).ids


# --- media -------------------------------------------------------------------------------------------------------
def test_media_round_trip(docs):
    got = media.sniff_media(media.encode_text(docs)).collect()
    texts = Counter((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())
    assert Counter((r["doc_id"], bytes(r["payload"])[: r["n_bytes"]]) for r in got) == texts
    assert all(len(r["payload"]) % 64 == 0 and len(r["payload"]) > 0 and r["mime"] == "audio/wav" and r["corrected"] for r in got)
    assert media.sniff_media(media.encode_text(docs.limit(0))).count() == 0


def test_validators_confirm_and_carve(spark):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(9) + b"\x02\x01\x00\x00;"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    gz = gz.compress(b"hello") + gz.flush()
    finder = media.automaton()
    for body, mime in ((png, "image/png"), (gif, "image/gif"), (gz, "application/gzip"), (media.wrap_wave(b"ab"), "audio/wav")):
        assert media.sniff(body, finder)[0] == media.Found(0, len(body), mime)
        assert not media.sniff(body[:-1], finder), mime
    assert media.sniff(b"RIFF PNG \xff\xd8\xff BMx PK\x03\x04", finder) == []
    both = b"noise" + png + b"more" + gif
    assert [(f.offset, f.length) for f in media.sniff(both, finder)] == [(5, len(png)), (9 + len(png), len(gif))]
    rows = spark.createDataFrame([(1, len(both), "image/jpeg", bytearray(both)), (2, 0, "text/plain", None)], "doc_id long, n_bytes long, declared string, media binary")
    sniffed = media.sniff_media(rows)
    assert sniffed.where("doc_id = 2").first()["mime"] == "text/plain"
    carved = {r["offset"]: bytes(r["content"]) for r in media.carve(sniffed).collect()}
    assert carved == {5: png, 9 + len(png): gif}


# --- WARC --------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    rows = [(5, "http://a/\r\nx", "same"), (3, None, "same"), (9, "http://b", None), (7, "http://c", ""), (8, "http://d", "é" * 70_000), (3, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc.read_archives(warc.write_archives(pages, archive_bytes=200)).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert [r["record_type"] for r in by[3]] == ["response"] * 2 and by[5][0]["record_type"] == "revisit" and by[5][0]["refers_to"] == 3
    assert by[9][0]["refers_to"] == 7 and by[5][0]["payload_bytes"] == 4 and by[8][0]["payload_bytes"] == 140_000
    assert by[5][0]["payload_digest"] == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert bytes(by[8][0]["payload"]).decode() == "é" * 70_000
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    odd = spark.createDataFrame([(None, "http://n", "null"), (-1, "http://m", "minus"), (None, None, "minus")], "page_id long, url string, html string")
    assert table_of(warc.read_archives(warc.write_archives(odd)), "page_id", "record_type", "refers_to") == sorted([(None, "response", None), (-1, "response", None), (None, "revisit", -1)], key=repr)
    few = warc.read_archives(warc.write_archives(pages, min_payload=5))
    assert few.where("record_type = 'revisit'").count() == 0


def test_warc_reader_takes_records_of_other_writers(spark):
    def member(*head, block=b""):
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        return squeeze.compress("\r\n".join(["WARC/1.0", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()

    http = b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\nbody"
    archive = b"".join([
        member("WARC-Type: warcinfo", "WARC-Record-ID: <urn:x:1>", "Content-Type: application/warc-fields", block=b"software: x\r\n"),
        member("WARC-Type: request", "Content-Type: application/http; msgtype=request", block=b"GET / HTTP/1.1\r\n\r\n"),
        member("WARC-Type: response", "WARC-Record-ID: <urn:uuid:12345678-1234-1234-1234-123456789abc>", "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: crc:1", block=http),
        member("WARC-Type: metadata", "WARC-Block-Digest: sha1:" + hashlib.sha1(b"m").hexdigest(), block=b"m"),
        member("WARC-Type: revisit", block=b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        warc.build_record(7, None, b"own", None),
    ])
    got = warc.read_archives(spark.createDataFrame([(bytearray(archive),), (None,), (bytearray(),)], "archive binary")).collect()
    assert [(r["record_type"], r["page_id"], r["payload_bytes"]) for r in got] == [("warcinfo", None, 13), ("request", None, 0), ("response", None, 4), ("metadata", None, 1), ("revisit", None, None), ("response", 7, 3)]
    assert got[3]["payload_digest"] == base64.b32encode(hashlib.sha1(b"m").digest()).decode() and got[4]["payload"] is None


def test_warc_reader_verifies():
    good = warc.build_record(1, "http://a", b"payload", None)
    assert [warc.page_of(r.headers["warc-record-id"]) for r in warc.read_records(good + warc.build_record(-4, None, b"", 1))] == [1, -4]
    plain = zlib.decompress(good, 31)
    squeeze = lambda b: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + c.flush()
    for bad in (good[:-9], squeeze(plain.replace(b"payload\r", b"paylOad\r")), squeeze(plain[:-3]), squeeze(b"nothing")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(bad))


# --- decontamination and licenses ----------------------------------------------------------------------------------
def test_decontamination(spark):
    question = "A train leaves the station at 9 and Tom rides 120 km before he meets Tom again after 3 hours of travel."
    bench = spark.createDataFrame([(1, question), (2, "What is 5?"), (3, None), (4, prose(50, 20))], "item_id long, text string")
    rows = [
        (1, "Intro words here. " + question.replace("9", "7").replace("Tom", "Ann").replace("120", "3.5") + " The end."),
        (2, question),
        (2, question),
        (3, question.replace("meets Tom", "meets Bob")),
        (4, "What is 5?"),
        (5, None),
        (6, ""),
        (7, prose(51, 30) + " " + prose(50, 20) + " " + prose(52, 30)),
        (8, prose(50, 9)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contamination(docs, bench).collect()}
    assert set(found) == {(1, 1), (2, 1), (7, 4)}
    assert not found[1, 1]["verbatim"] and found[2, 1]["verbatim"] and found[1, 1]["offset"] == 3
    odd = decontaminate.decontaminate(docs.withColumns({c: F.lit(c) for c in ("_r1", "_r2", "r1", "whole", "row", "key")}), bench)
    assert {tuple(r) for r in odd.select("_r1", "_r2", "r1", "whole", "row", "key").collect()} == {("_r1", "_r2", "r1", "whole", "row", "key")} and odd.count() == 5
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r[0] for r in left.select("doc_id").collect()) == [3, 4, 5, 6, 8]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 9
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_decontamination_of_short_and_slot_heavy_items(spark):
    bench = ["What is the capital of France today?", "What is 12 + 35 * 7 - 4?", "Tom buys 6 apples and 9 pears for lunch", "Sam adds 1 2 3 4 5 6 7 8 9 to the long list of numbers that Sam had written down before he left"]
    texts = ["Q: What is the capital of France today? A: Paris", "Solve this, What is 12 + 35 * 7 - 4?", "Then, Tom buys 6 apples and 9 pears for lunch.", "Now Ann buys 7 apples and 7 pears for lunch", bench[3], "What is 12 + 36 * 7 - 4?", "He said: Sam adds 1 2 3 4 5 6 7 8 9 to the long list of numbers that Bob had written down before he left"]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.contamination(rows, spark.createDataFrame([*enumerate(bench)], "item_id long, text string")).collect()}
    assert found == {(0, 0): True, (1, 1): True, (2, 2): True, (3, 2): False, (4, 3): True}


def brute_contamination(texts, bench, window=8, coverage=0.6):
    """(doc, item, verbatim) by the definition: every window of every form of every item looked for at every place of every text."""
    D = decontaminate
    P = lambda p: p.replace("(?i)", "")

    def tagged(text, keep, starts=False):
        value = r"\g<0>" if keep else ""
        out = regex.sub(D.NAMES, f" {D.NAME}{value} ", regex.sub(f"[{D.SLOTS}]", " ", text))
        if starts:
            out = regex.sub(D.STARTS, f" {D.NAME}{value} ", out)
        out = regex.sub(P(D.UNITS), f" {D.UNIT}{value} ", out, flags=regex.I)
        return regex.sub(rf"(?<![{D.SLOTS}\p{{L}}])" + D.NUMBERS if keep else D.NUMBERS, f" {D.NUMBER}{value} ", out)

    split = lambda t: [w for w in regex.split(D.BREAK, t.lower()) if w]
    canonical, slots = (lambda t, s=False: split(tagged(t, False, s))), (lambda t: split(tagged(t, True)))
    marks = {D.NAME, D.NUMBER, D.UNIT}
    plain = lambda t: [w[1:] if w[:1] in marks else w for w in slots(t)]
    free = lambda words, i, n: 2 * sum(w not in marks for w in words[i : i + n]) >= n
    runs = lambda words, n: [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    out = set()
    for item, body in bench.items():
        words = canonical(body or "")
        if len(words) < 4:
            continue
        n, marked = min(window, len(words)), canonical(body, True)
        marked = marked if len(marked) == len(words) else words
        first, rest = marked[:1] + words[1:], words[:1] + marked[1:]
        for doc, text in texts.items():
            own, values, hits = canonical(text or ""), plain(text or ""), set()
            for form in (words, first, rest, marked):
                hits |= {(at, p - at) for at, x in enumerate(runs(form, n)) if free(form, at, n) for p, y in enumerate(runs(own, n)) if x == y}
            strict = [at for at in range(len(words) - n + 1) if not (free(words, at, n) and free(first, at, n))]
            wanted = runs(plain(body), n)
            hits |= {(at, p - at) for at in strict for p, y in enumerate(runs(values, n)) if wanted[at] == y}
            found, all_free = {at for at, _ in hits}, [at for at in range(len(words) - n + 1) if free(words, at, n)]
            share = max(len(found) / (len(words) - n + 1), len(found & {*all_free}) / len(all_free) if all_free else 0)
            if share < coverage:
                continue
            offset = min({o for _, o in hits}, key=lambda o: (-len({at for at, x in hits if x == o}), o))
            mine, theirs, pairs = slots(text), slots(body), set()
            for i, b in enumerate(theirs):
                if 0 <= i + offset < len(mine):
                    b = D.NAME + b if marked[i : i + 1] == [D.NAME] and b[:1] not in marks else b
                    if b[:1] in marks and mine[i + offset][:1] == b[:1]:
                        pairs.add((b, mine[i + offset]))
            if len(pairs) == len({b for b, _ in pairs}):
                out.add((doc, item, all(b == m for b, m in pairs)))
    return out


def test_decontamination_against_brute_force(spark):
    r = random.Random(12)
    names, units = ["Ann", "Bob", "Zoë", "Xi"], ["km", "hours", "kg"]

    def sentence(n):
        words = [r.choice([r.choice(WORDS), r.choice(WORDS), r.choice(names), str(r.randint(1, 30)), f"{r.randint(1, 9)} {r.choice(units)}"]) for _ in range(n)]
        return words[0].capitalize() + " " + " ".join(words[1:]) + r.choice([".", "?"])

    def changed(text):
        kind = r.randrange(5)
        if kind == 0:
            return text
        if kind == 1:
            a, b = r.sample(names, 2)
            return text.replace(a, b).replace("1", "7")
        if kind == 2:
            return regex.sub(r"\d+", lambda m: str(int(m[0]) + 1), text)
        words = text.split(" ")
        k = r.randrange(len(words))
        return " ".join(words[:k] + ["extra"] * (kind - 2) + words[k + kind - 3 :])

    bench = {k: " ".join(sentence(r.randint(3, 12)) for _ in range(r.randint(1, 2))) for k in range(25)}
    texts = {k: sentence(9) + " " + r.choice(["So: ", "", "Then, "]) + changed(r.choice(list(bench.values()))) + " " + sentence(8) for k in range(160)}
    texts |= {900: None, 901: "", 902: " ".join(sentence(10) for _ in range(400)) + " " + bench[3]}
    got = decontaminate.contamination(spark.createDataFrame([*texts.items()], "doc_id long, text string"), spark.createDataFrame([*bench.items()], "item_id long, text string"))
    want = brute_contamination(texts, bench)
    assert len({v for *_, v in want}) == 2 and {(x["doc_id"], x["item_id"], x["verbatim"]) for x in got.collect()} == want


def test_license_scan_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(ORACLE_SQL["op6_license_scan"]).fetchall())
    assert want and sorted(tuple(x) for x in QUERIES["op6_license_scan"](spark, sf).collect()) == want


def test_whole_license_texts_are_met_by_their_windows(spark):
    whole = {name: t for name, part, t in licenses.TEMPLATES if part == "text"}
    edited = {name: " ".join(w for k, w in enumerate(t.split()) if k % 90 != 45) for name, t in whole.items()}
    rows = [(k, prose(k, 300) + "\n" + t + "\n" + prose(k + 9, 5000)) for k, t in enumerate(edited.values())] + [(50, prose(5, 80)), (50, prose(5, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "words": F.lit(2), "part": F.lit(3)})
    found = licenses.scan(docs, licenses.templates(spark)).collect()
    assert {(r["doc_id"], r["license"]) for r in found if r["part"] == "text"} >= set(enumerate(edited))


def test_license_scan(spark):
    texts = {i: t for i, (_, _, t) in enumerate(licenses.TEMPLATES)}
    rows = [(i, prose(i, 50) + "\n" + t + "\n" + prose(i + 1, 50)) for i, t in texts.items()] + [(100, None), (101, ""), (102, prose(7, 300)), (103, "MIT License"), (0, prose(0, 50) + "\n" + texts[0] + "\n" + prose(1, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    found = licenses.scan(docs, licenses.templates(spark)).collect()
    got = {(r["doc_id"], r["license"], r["part"]) for r in found}
    for i, (name, part, _) in enumerate(licenses.TEMPLATES):
        assert (i, name, part) in got
    assert not any(r["doc_id"] >= 100 for r in found) and len(got) == len(found)
    assert licenses.scan(docs.limit(0), licenses.templates(spark)).count() == 0


# --- HTML --------------------------------------------------------------------------------------------------------
def texts_of(spark, *pages, host=lambda k: f"h{k}"):
    rows = spark.createDataFrame([(k, f"http://{host(k)}/{k}", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(html_extract.extract(rows).collect(), key=lambda r: r["page_id"])]


def test_blocks_of_a_page(spark):
    page = "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav>m</nav><div class='post'><h1>Tit&amp;le</h1><p>One <b>two</b><br>three<p>Four &lt;x&gt; &#233;<ul><li>a<li>b</ul><form>f<input></form></div><div class='comments'><p>c</p></div><footer>x</footer><script>if(a<b){'</p>'}</script></body></html>"
    article = "<article><header><h1>H</h1></header><p>a<div class='ad'>x</div><p>b</article><p>out"
    kept = "<div class='related-work'><p>Others did <math><mi>x</mi></math> too</div><p class='search-results-of-1850'>c</p><div class='noticeable'>d</div><div class='shared-memory'>e</div>"
    assert texts_of(spark, page, "", "plain & text", article, kept) == ["Tit&le\n\nOne two three\n\nFour <x> é\n\na\n\nb", "", "plain & text", "H\n\na\n\nb", "Others did x too\n\nc\n\nd\n\ne"]


def test_nothing_goes_without_the_style_tree(spark, monkeypatch):
    page = lambda k: f"<body class='post-{k}'><nav>menu</nav><div><p>On this site since 19{k}0</p></div><div><p>{prose(k, 20)}</p></div></body>"
    pages = [page(k) for k in range(6)]
    article = f"<p>before</p><article><p>{prose(9, 20)}</p></article>"
    assert texts_of(spark, article) == [prose(9, 20)]
    assert texts_of(spark, *pages, host=lambda k: "one") == [prose(k, 20) for k in range(6)]
    tree = html_extract.style_tree
    monkeypatch.setattr(html_extract, "style_tree", lambda *a: tree(*a).where("false"))
    assert texts_of(spark, article) == [f"before\n\n{prose(9, 20)}"]
    assert texts_of(spark, *pages, host=lambda k: "one")[3] == f"menu\n\nOn this site since 1930\n\n{prose(3, 20)}"


def test_style_tree_against_brute_force(spark):
    r = random.Random(8)
    pages = [f"<div><p>{r.choice(['one', 'two', 'three 4'])}</p><p>{prose(r.randint(0, 3), 5)}</p></div>" + "<div class='ad'>x</div>" * r.randint(0, 2) + "<p>same</p>" for _ in range(30)]
    seen = {}
    for h in set(pages):
        own = {}
        page = html_extract.Page(h)
        for path, text, _ in page.blocks:
            own.setdefault(html_extract.node_of(path), []).append(re.sub("[1-9]", "0", text))
        for path, blocks in own.items():
            seen.setdefault(path, []).append((tuple(blocks), page.children.get(path)))

    def entropy(marks):
        n = Counter(marks)
        return -sum(c / len(marks) * np.log(c / len(marks)) for c in n.values()) / np.log(len(marks))

    want = {p: 0.0 if "!" in p else max(entropy([m[0] for m in marks]), entropy([m[1] for m in marks])) if len(marks) >= 5 else 1.0 for p, marks in seen.items()}
    rows = spark.createDataFrame([(k, "http://a/", h) for k, h in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    got = {r["path"]: r["importance"] for r in html_extract.style_tree(rows).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in got)


def test_html_keeps_columns_of_any_name_and_repeated_rows(spark):
    long = " ".join(prose(k, 2000) for k in range(30))
    rows = spark.createDataFrame([(1, "http://a/", f"<p>{long}</p>", "m"), (2, None, None, "m"), (2, None, None, "m")], "page_id long, url string, html string, low string")
    rows = rows.withColumns({"host": F.lit(1), "row": F.lit(2), "own": F.lit(3), "_host": F.lit(4)})
    got = html_extract.extract(rows)
    assert got.columns == ["page_id", "url", "low", "host", "row", "own", "_host", "text", "n_chars"]
    assert sorted(tuple(r)[2:7] for r in got.drop("text").collect()) == [("m", 1, 2, 3, 4)] * 3
    assert got.where("page_id = 1").first()["text"] == long


def test_style_tree_removes_what_a_site_repeats(spark):
    page = lambda k: f"<body><div class='top'><p>Welcome to our site</p></div><div class='body'><p>{prose(k, 30)}</p><p class='tail'>Read more here</p></div></body>"
    rows = [(k, f"http://Site.example/{k}", page(k)) for k in range(12)] + [(50, "http://other.example/", page(1)), (51, None, None), (52, "http://site.example/0", page(0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert all(got[k]["text"] == prose(k, 30) for k in range(12)) and got[52]["text"] == prose(0, 30)
    assert got[50]["text"].startswith("Welcome") and got[51]["text"] == "" and got[51]["n_chars"] == 0
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_style_tree_keeps_what_varies_below_a_constant_label(spark):
    label = lambda k: f"<body><div class='post'>By the editors<h1>{prose(k, 4)}</h1><p>{prose(k, 30)}</p></div><div class='end'>Goodbye<p>Come again</p></div></body>"
    shared = lambda k: f"<body><div>Welcome all</div><div><p>{prose(k, 30)}</p></div></body>"
    rows = [(k, f"http://label.example/{k}", label(k)) for k in range(8)] + [(20 + k, f"http://shared.example/{k}", shared(k)) for k in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"{prose(k, 4)}\n\n{prose(k, 30)}" for k in range(8)}, **{20 + k: prose(k, 30) for k in range(8)}}
