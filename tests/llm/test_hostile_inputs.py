"""Inputs made to stall or end a task: each is worked through in time that grows with its length, and bad parts are rows, not failures."""

import gzip
import random
import time

import pytest

from quire.llm import decontaminate, html_extract, media, warc


def seconds(run):
    began = time.time()
    run()
    return time.time() - began


def test_numbers_of_a_million_digits_do_not_end_the_engine(spark):
    docs = spark.createDataFrame([(1, ",".join(str(i % 10) for i in range(500_000))), (2, "the quick brown fox jumps over 12 lazy dogs in 3 days today"), (3, "1.2," * 1000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "The quick brown fox jumps over 15 lazy dogs in 3 days today")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.verbatim) for r in decontaminate.contamination(docs, items).collect()] == [(2, 1, False)]


@pytest.mark.parametrize("html", ["<a " * 340_000, '<a "' * 250_000, "<a '\"" * 200_000 + ">", "<!" * 500_000, "<!--" * 250_000, "<div>" * 20_000 + "x", "<" * 1_000_000, "<p>x</q>" * 50_000])
def test_pages_of_a_megabyte(html):
    assert seconds(lambda: html_extract.Page(html).text()) < 10


def test_deep_pages_keep_their_text():
    page = html_extract.Page("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after</p>")
    assert page.text() == "deep\n\nafter" and max(len(p) for p, _, _ in page.blocks) < 5000


def test_comments_that_are_articles(spark):
    html = "<body><article><p>The story itself.</p></article><section><article class='comment'><p>A reader says.</p></article></section></body>"
    pages = spark.createDataFrame([(1, "http://h/1", html)], "page_id long, url string, html string")
    assert html_extract.extract(pages).first().text == "The story itself."


@pytest.mark.parametrize("body", [(b"OggS\0" + b"\0" * 21 + b"\1\1x") * 8000, b"GIF89a\1\0\1\0\0\0\0" + (b"\x21\xfe\x06GIF89a\0") * 20_000, b"GIF89a\1\0\1\0\0\0\0!\xfe" * 15_000, b"\xff\xd8\xff\xe0\x00\x02" * 40_000, b"\xff\xd8\xff\xda\x00\x02" * 40_000])
def test_magic_numbers_without_end(body):
    assert seconds(lambda: media.sniff(body, media.automaton())) < 10


def test_chained_parts_are_found_as_one_by_one():
    def ogg(b, at):
        p = at
        while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
            q = p + 27 + b[p + 26] + sum(b[p + 27 : p + 27 + b[p + 26]])
            if p + 27 + b[p + 26] > len(b) or q > len(b):
                return None
            if b[p + 5] & 4:
                return q
            p = q
        return None

    r = random.Random(1)
    parts = [b"OggS\0" + bytes([4]) + b"\0" * 20 + b"\1\2xy", b"OggS\0" + b"\0" * 21 + b"\1\1x", b"ab"]
    for _ in range(500):
        body = b"".join(r.choice(parts) for _ in range(r.randrange(1, 12)))
        want = {(at, ogg(body, at) - at) for at in range(len(body)) if body[at : at + 4] == b"OggS" and ogg(body, at)}
        assert {(f.offset, f.length) for f in media.sniff(body, media.automaton()) if f.mime == "audio/ogg"} == want


def test_bad_records_are_rows(spark):
    good = warc.build_record(1, "http://a", b"payload", None)
    plain = gzip.decompress(good)
    loose = b"WARC/1.0\nWARC-Type: resource\nContent-Length: 3\n\nabc\n\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nwiki\r\n0\r\n\r\n"
    told = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: {warc._digest(b'wiki')}\r\nContent-Length: {len(chunked)}\r\n\r\n".encode() + chunked + b"\r\n\r\n"
    archives = {
        "two in one member": gzip.compress(plain + plain),
        "plain": plain + loose + plain,
        "zeros behind": good + b"\0" * 700,
        "chunked": gzip.compress(told),
        "a broken member between": good + good[:40] + b"\xff" * 30 + good,
        "junk first": b"junk" + good,
        "cut off": good + good[:-9],
        "a wrong length": gzip.compress(plain.replace(b"Content-Length: 92", b"Content-Length: 90", 1) if b"Content-Length: 92" in plain else plain.replace(b"payload\r\n", b"payloa\r\n", 1)) + good,
        "a wrong digest": gzip.compress(plain.replace(b"payload", b"pAyload", 1)) + good,
        "no length": gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n") + good,
    }
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in archives.items()], "name string, archive binary")
    got = {}
    for name, body in archives.items():
        found = warc.read_archives(rows.where(rows.name == name)).collect()
        got[name] = [(r.page_id, r.error is None) for r in found]
    assert got["two in one member"] == [(1, True), (1, True)]
    assert got["plain"] == [(1, True), (None, True), (1, True)]
    assert got["zeros behind"] == [(1, True)] and got["chunked"] == [(None, True)]
    assert got["a broken member between"] == [(1, True), (None, False), (1, True)]
    assert got["junk first"] == [(None, False), (1, True)] and got["cut off"] == [(1, True), (None, False)]
    for name in ("a wrong length", "a wrong digest", "no length"):
        assert [ok for _, ok in got[name]] == [False, True], name


def test_damaged_archives_end():
    r = random.Random(3)
    sound = b"".join(warc.build_record(k, "http://a", b"payload %d" % k, None) for k in range(20))
    for _ in range(300):
        data = bytearray(sound)
        for _ in range(r.randrange(1, 20)):
            data[r.randrange(len(data))] = r.randrange(256)
        list(warc.scan_records(bytes(data[: r.randrange(len(data))])))


def test_windows_alone_find_edited_license_texts(spark):
    """Every template of 16 words or more, cut, with a tenth of its words changed at random: the share that MinHash windows retrieve."""
    from pyspark.sql import functions as F

    from quire.llm import licenses

    r = random.Random(9)
    long = [(name, part, text) for name, part, text in licenses.TEMPLATES if len(text.split()) >= 16]
    assert sum(part == "text" for _, part, _ in long) == 7 and "unlicense.org" in dict((n, t) for n, p, t in long if p == "text")["Unlicense"]
    docs = []
    for k in range(200):
        words = long[k % len(long)][2].split()
        for _ in range(len(words) // 10):
            words[r.randrange(len(words))] = f"edit{r.randrange(1000)}"
        docs.append((k, " ".join([f"own{r.randrange(500)}" for _ in range(r.randrange(60))] + words + ["end"])))
    theirs = licenses.template_table(spark.createDataFrame(long, "license string, part string, text string"))
    wide = lambda df, step, *keep: df.select(*keep, F.explode(licenses._windows(F.col("shingles"), step)).alias("w")).where("w.band >= 0")
    mine = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", licenses.shingles_of(licenses.words_of(F.col("text"))).alias("shingles"))
    met = wide(mine, licenses.STRIDE, "doc_id").join(wide(theirs, 1, "license", "part"), "w").select("doc_id", "license", "part").distinct().collect()
    found = {(m.doc_id, m.license, m.part) for m in met}
    assert sum((k, *long[k % len(long)][:2]) in found for k in range(200)) >= 0.98 * 200
