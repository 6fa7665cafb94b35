"""Tokenizer alignment, periodic runs and MinHash near-duplicates: brute force, nulls, long texts, ties, repeats, clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import alignment, near_dedup, ngram_join, periodic_runs

CLASH = ("key", "row", "id", "a", "b", "pairs", "n", "runs", "collapsed", "rep", "label", "band", "set_a", "component_id")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def crowd(docs, changes):
    """``docs`` with other columns of the operators' own names."""
    return docs.withColumns({c: F.lit("x") for c in changes})


# --- tokenizer alignment -----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


HOSTILE = [
    "plain words, and some more words",
    "  two  spaces   three ",
    "tab\tand\nline \n \t mixed\r\n end",
    "<|endoftext|> and <s> </s> <unk> <0x41>",
    "snake ▁ literal ▁ mark",
    "日本語のテキスト and русский ελληνικά",
    "emoji 😀😀 ​ zero  width 　 wide",
    "ﬁ ½ é é \x00 \x7f",
    " ",
    "\n",
    "a",
    "it's they'll I'd 12345 3.14 a_b-c",
    "x" * 3000 + " " + "word " * 3000,
]


def test_remembered_words_give_the_libraries_ids(files):
    import sentencepiece
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(files[0])
    plain.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=files[1])
    (first, _), (second, _) = alignment.first_tokenizer(files[0]), alignment.second_tokenizer(files[1])
    r = random.Random(5)
    marks = ["a", "Ab", "é", ".", ",", "'s", "1", " ", "  ", "\n", "\t", " ", "▁", "<|endoftext|>", "日", "-", "\r", "\x0b", " "]
    texts = HOSTILE + ["".join(r.choice(marks) for _ in range(r.randrange(1, 25))) for _ in range(3000)]
    for text in texts:
        assert list(first(text)) == plain.encode(" " + text, add_special_tokens=False).ids, text
        assert list(second(text)) == model.encode(text), text


def walked(files, text):
    """Links and groups of one text by two pointers, or None."""
    (first, bytes_a), (second, bytes_b) = alignment.first_tokenizer(files[0]), alignment.second_tokenizer(files[1])
    if not text:
        return None
    a, b, whole = list(first(text)), list(second(text)), (" " + text).encode()
    if b"".join(bytes_a[x] for x in a) != whole or b"".join(bytes_b[x] for x in b) != whole:
        return None
    ends_a, ends_b = np.cumsum([len(bytes_a[x]) for x in a]), np.cumsum([len(bytes_b[x]) for x in b])
    links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if max(ends_a[i] - len(bytes_a[x]), ends_b[j] - len(bytes_b[y])) < min(ends_a[i], ends_b[j])]
    groups, cuts = [], sorted(set(ends_a) & set(ends_b))
    for low, high in zip([0, *cuts], cuts):
        groups.append(",".join(str(x) for x, e in zip(a, ends_a) if low < e <= high) + "|" + ",".join(str(y) for y, e in zip(b, ends_b) if low < e <= high))
    return len(a), len(b), links, groups


@pytest.mark.parametrize("most", [alignment.BROADCAST, 0])
def test_alignment_against_two_pointers(spark, files, monkeypatch, most):
    monkeypatch.setattr(alignment, "BROADCAST", most)
    texts = dict(enumerate([*HOSTILE[:-1], None, "", HOSTILE[0], "word " * 200]))
    docs = spark.createDataFrame([*texts.items(), (0, texts[0]), (None, "a null key")], "doc_id long, text string").repartition(3)
    texts_of = [*texts.items(), (0, texts[0]), (None, "a null key")]
    found = [(k, walked(files, t)) for k, t in texts_of]
    counts = collections.Counter(p for _, w in found if w for p in set(w[2]))
    most_of = {}
    for (a, _), n in counts.items():
        most_of[a] = max(n, most_of.get(a, 0))
    want = []
    for k, w in found:
        if w is None:
            want.append((k, 0, 0, 0, 0, 0, 0, "", ""))
        else:
            groups = ";".join(w[3])
            want.append((k, w[0], w[1], len(w[3]), len(w[2]), sum(counts[p] == most_of[p[0]] for p in w[2]), sum(counts[p] for p in w[2]), hashlib.sha256(groups.encode()).hexdigest(), groups))
    assert rows_of(alignment.alignment(docs, *files)) == sorted(want, key=repr)
    assert rows_of(alignment.alignment(crowd(docs, CLASH), *files)) == sorted(want, key=repr)
    assert alignment.alignment(docs.limit(0), *files).count() == 0


def test_alignment_of_a_very_long_text(spark, files):
    text = " ".join(f"word{k % 977} and" for k in range(60_000))
    got = alignment.alignment(spark.createDataFrame([(1, text)], "doc_id long, text string"), *files).first()
    (first, _), (second, _) = alignment.first_tokenizer(files[0]), alignment.second_tokenizer(files[1])
    assert (got.n_a, got.n_b) == (len(first(text)), len(second(text))) and got.n_links == got.n_a + got.n_b - got.n_groups
    assert got.n_best <= got.n_links == got.count_sum


# --- periodic runs -----------------------------------------------------------------------------------------------
def brute_runs(words, least=12):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q), q)
            i = max(i, s + 1) if i == s else i
    return sorted((s, e - s, q) for (s, e), q in out.items())


@pytest.mark.parametrize("seed", range(6))
def test_word_runs_against_brute_force(seed):
    r = random.Random(seed)
    for _ in range(200):
        texts = []
        for _ in range(r.randrange(1, 4)):
            kinds, n = r.choice([1, 2, 3, 6]), r.randrange(0, 70)
            words = [b"%d" % r.randrange(kinds) for _ in range(n)]
            if n > 6 and r.random() < 0.5:
                a, p = r.randrange(n // 2), r.randrange(1, 9)
                words = words[: a + p] + [words[a + (i - a) % p] for i in range(a + p, n)]
            texts.append(words)
        least = r.choice([2, 4, 6, 12])
        for words, found in zip(texts, periodic_runs.texts_runs(texts, least)):
            assert [tuple(map(int, x)) for x in zip(*found)] == brute_runs(words, least), (least, words)


@pytest.mark.parametrize("words", [[b"a"] * 50_000, [b"a", b"b", b"c"] * 20_000, [b"%d" % (k % 10_007) for k in range(60_000)], [b"%d" % k for k in range(60_000)]])
def test_word_runs_of_long_texts(words):
    period = len(set(words))
    want = [(0, len(words), period)] if 2 * period <= len(words) else []
    assert [tuple(map(int, x)) for x in zip(*periodic_runs.texts_runs([words])[0])] == want


def test_fibonacci_words_have_their_runs():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 250:
        a, b = b, b + a
    assert [tuple(map(int, x)) for x in zip(*periodic_runs.texts_runs([b])[0])] == brute_runs(b)


def test_periodic_runs_of_a_table(spark):
    loop = "one two three " * 5
    rows = [(1, "start here " + loop + "end"), (2, None), (3, ""), (4, " \t\n "), (5, "plain text without any"), (1, "start here " + loop + "end"), (None, loop), (6, "x y " * 12), (7, "é " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()]
    want = [
        (1, 18, [(2, 15, 3)], "start here one two three end"),
        (1, 18, [(2, 15, 3)], "start here one two three end"),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (4, 0, [], ""),
        (5, 4, [], "plain text without any"),
        (None, 15, [(0, 15, 3)], "one two three"),
        (6, 12, [(0, 12, 1)], "x y"),
        (7, 20_000, [(0, 20_000, 1)], "é"),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert rows_of(periodic_runs.periodic_runs(crowd(docs, CLASH))) == rows_of(periodic_runs.periodic_runs(docs))
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    assert {(r.doc_id, r.text) for r in periodic_runs.collapse(docs).collect()} >= {(2, None), (4, " \t\n "), (1, "start here one two three end")}


# --- MinHash near-duplicates -------------------------------------------------------------------------------------
def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def components_of(rows, percent=85):
    """The smallest key that all links lead to, by all pairs."""
    own = {k: {shingles(t) for i, t in rows if i == k} for k, _ in rows}
    top = {k: k for k in own}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in own:
        for b in own:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in own[a] for y in own[b]):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {k: find(k) for k in own}


def near_rows(seed, groups=6, size=9):
    """Groups of edited copies: chains, stars around a text that is not the smallest, short texts."""
    r = random.Random(seed)
    rows, k = [], 0
    for g in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 8, 40, 150]))]
        for _ in range(size):
            words = list(base)
            for _ in range(r.randrange(0, 1 + len(words) // 25)):
                words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
            rows.append((k, " ".join(words)))
            k += 1
            if r.random() < 0.3:
                base = words
    order = list(range(k))
    r.shuffle(order)
    return [(order[i], t) for i, t in rows]


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_against_all_pairs(spark, seed):
    rows = near_rows(seed) + [(900, None), (901, ""), (902, "  \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "One\ttwo"), (907, "Écart deux trois"), (908, "écart deux trois"), (903, "one")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = components_of(rows)
    assert len(got) == len(rows)
    texts = collections.defaultdict(set)
    for k, t in rows:
        texts[k].add(len(shingles(t)))
    for r in got:
        assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id) and r.n_shingles in texts[r.doc_id], r


def apart_in_one_bucket():
    """A centre that is unlike all others of its buckets, which are pairwise alike or not."""
    base = [f"t{i}" for i in range(300)]
    rows = [(0, " ".join(base[:200] + [f"c{i}" for i in range(60)]))]
    for g in range(20):
        own = base[:220] + [f"g{g}x{i}" for i in range(60)]
        rows += [(10 * g + 1, " ".join(own)), (10 * g + 2, " ".join(own[:-3])), (10 * g + 3, " ".join(own[5:]))]
    return rows


@pytest.mark.parametrize("most", [512, 3])
def test_links_that_no_star_shows(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "MOST", most)
    rows = apart_in_one_bucket()
    # one row a band: every pair of these shares some bucket, and most buckets hold all of them
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), bands=30, rows=2).collect()
    assert {r.doc_id: r.component_id for r in got} == components_of(rows)


def test_a_group_of_many_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(base[:60] + [f"n{k}"] + base[60:])) for k in range(700)] + [(1000 + k, "all the same words here") for k in range(500)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.component_id for r in got} == {0, 1000} and sum(r.kept for r in got) == 2


def test_near_duplicates_of_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (5, text), (4, text + " more"), (None, "alone with no key"), (7, text + " x"), (7, "quite another text"), (6, "quite another text"), (8, "a b c " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got.where("doc_id is not null").collect()) == [(4, 4, True), (5, 4, False), (6, 4, False), (7, 4, False), (7, 4, False), (8, 8, True)]
    assert sorted(((r.component_id, r.kept) for r in got.where("doc_id is null").collect()), key=repr) == [(4, False), (None, True)]
    assert rows_of(near_dedup.near_duplicates(crowd(docs, CLASH))) == rows_of(got)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_densified_bins_agree_as_often_as_the_sets():
    r = np.random.default_rng(3)
    for size, common in ((6, 5), (40, 30), (400, 340)):
        agreed = 0
        for _ in range(60):
            x = r.integers(0, 1 << 63, size + size - common).astype(np.uint64)
            sets = [np.sort(x[:size]), np.sort(x[size - common :])]
            bins = near_dedup.densify(near_dedup.one_permutation(np.concatenate(sets), np.array([0, size, 2 * size]), 144))
            assert (bins != near_dedup.EMPTY).all()
            agreed += (bins[0] == bins[1]).mean()
        assert abs(agreed / 60 - common / (2 * size - common)) < 0.05
    empty = near_dedup.densify(near_dedup.one_permutation(np.zeros(0, np.uint64), np.array([0, 0]), 168))
    assert (empty == near_dedup.EMPTY).all()
    assert ngram_join.BYTE[ord("A")] != near_dedup.BYTE[ord("A")] == near_dedup.BYTE[ord("a")]
