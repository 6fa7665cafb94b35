"""The reader, codecs, selectors and rules on small given inputs, and every registered query against its SQL."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import codecs, registry, rules
from quire.operators import findings, graph, select, structure
from quire.plans import document_queries, forms_queries, graph_queries, stream_queries, structure_queries, text_queries
from quire.sources import export, pdf

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for name in TABLES:
        out.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return out


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(repr(tuple(round(x, 5) if isinstance(x, float) else None if x is None else str(x) for x in r)) for r in frame.itertuples(index=False, name=None))


EVERY = [(m, n) for m in (graph_queries, text_queries, document_queries, stream_queries, structure_queries, forms_queries) for n in m.ORACLE]


@pytest.mark.parametrize("module,name", EVERY, ids=[n for _, n in EVERY])
def test_query_equals_its_sql(spark, sf, con, module, name):
    got, want = module.QUERIES[name](spark, sf).toPandas(), con.sql(module.ORACLE[name]).df()
    assert len(got) > 0
    a, b = rows_of(got), rows_of(want)
    assert a[0] == b[0] and a[1] == b[1]


# --- bytes ---------------------------------------------------------------------------------------------------------
def test_values():
    value, _ = pdf.parse_value(b"[1 2 3 /Name true null -1.5 (a\\(b\\051\\n) <48656C6C6F> <48656> 12 0 R << /K [] >> /A#20B]")
    assert value == [1, 2, 3, "/Name", True, None, -1.5, "(a(b)\n", "(Hello", "(He`", {"R": "12 0"}, {"K": []}, "/A B"]
    for bad in (b"[1 2 3", b"<< /Type >>", b"<< 1 2 >>", b"", b"(abc", b"[" * 300):
        with pytest.raises(pdf.PdfError):
            pdf.parse_value(bad)


def test_codecs_on_given_inputs():
    assert codecs.hex_decode(b"48656C6C6F>") == b"Hello" and codecs.hex_decode(b"4 8 6>") == b"H`"
    assert codecs.ascii85_decode(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert codecs.run_length_decode(bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"
    assert list(codecs.predictor_decode(bytes([1, 10, 5, 3, 7]), 11, 1, 8, 4)) == [10, 15, 18, 25]
    assert list(codecs.predictor_decode(bytes([10, 5, 3, 7]), 2, 1, 8, 4)) == [10, 15, 18, 25]
    assert codecs.jpx_codestream(b"\xff\x4f\xff\x51abc") == b"\xff\x4f\xff\x51abc"
    for name, data in (("ASCIIHexDecode", b"zz"), ("FlateDecode", b"abc"), ("RunLengthDecode", b"\x01a"), ("JPXDecode", b"abc"), ("Nothing", b"")):
        with pytest.raises(codecs.CodecError):
            codecs.decode(data, [name])


def test_codecs_round_trip():
    r = random.Random(1)
    for n in [*range(0, 600, 23), 9000]:
        for data in (bytes(r.choice(b"aab cd") for _ in range(n)), r.randbytes(n)):
            for name, encode in codecs.ENCODERS.items():
                assert codecs.decode(encode(data), [name]) == data, (name, n)


def test_reader_never_raises_on_damage():
    r = random.Random(0xC0FFEE)
    whole = pdf.render(35, "some lines\n" * 60)
    for _ in range(120):
        body = bytearray(whole)
        for _ in range(max(1, len(body) // 1000)):
            body[r.randrange(len(body))] ^= 1 << r.randrange(8)
        assert pdf.read_document(bytes(body))[0][0] == "doc"
    assert pdf.read_document(whole[: len(whole) // 2])[0][0] == "doc" and pdf.read_document(b"")[0][0] == "doc"


def test_object_and_xref_streams():
    inner = b"1 0 2 10 << /A 1 >>[2 (x)]"
    first = inner.index(b"<<")
    pairs = b"1 0 2 %d " % (inner.index(b"[") - first)
    plain = pairs + inner[first:]
    out = bytearray(b"%PDF-1.7\n")
    at = {3: len(out)}
    out += b"3 0 obj\n<< /Type /ObjStm /N 2 /First %d /Length %d >>\nstream\n" % (len(pairs), len(plain)) + plain + b"\nendstream\nendobj\n"
    at[4] = len(out)
    table = b"".join(bytes([k]) + n.to_bytes(2, "big") + bytes([i]) for k, n, i in ((2, 3, 0), (2, 3, 1), (1, at[3], 0), (1, at[4], 0)))
    out += b"4 0 obj\n<< /Type /XRef /W [1 2 1] /Index [1 4] /Size 5 /Root 1 0 R /Length %d >>\nstream\n" % len(table) + table + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at[4]
    rows = {r[2]: r[5] for r in pdf.read_document(bytes(out)) if r[0] == "object"}
    assert rows[1] == '{"A": 1}' and rows[2] == '[2, "(x"]'


def test_files_are_found_by_suffix_and_magic(spark, tmp_path):
    body = pdf.render(1, "hello")
    (tmp_path / "a.pdf").write_bytes(body)
    (tmp_path / "bare").write_bytes(body)
    (tmp_path / "c.txt").write_bytes(body)
    (tmp_path / "none").write_bytes(b"text")
    found = pdf.read(spark, str(tmp_path))
    assert sorted(os.path.basename(r["path"]) for r in found.collect()) == ["a.pdf", "bare"]
    assert pdf.documents(pdf.parse(found)).where("version = '1.5'").count() == 2


# --- graph ---------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tree(spark):
    nodes = spark.createDataFrame([("a", "Catalog", 1, {"Name": "x"}), ("b", "Pages", 2, {}), ("c", "Page", 3, {"Name": "y"}), ("d", "Page", 4, None), ("e", "Font", 5, {})], "node_id string, node_type string, obj long, props map<string,string>")
    edges = spark.createDataFrame([("a", "b", "Child", 0), ("b", "c", "Child", 0), ("b", "d", "Child", 1), ("c", "e", "Reference", 0), ("d", "z", "Reference", 0)], "src string, dst string, edge_type string, ord long")
    return nodes, edges


@pytest.mark.parametrize("text,want", [("page", "cd"), ("catalog page", "cd"), ("pages > page", "cd"), ("catalog > page", ""), ("page:first", "c"), ("page:last", "d"), ("page:nth-child(1)", "d"), ("#3", "c"), ("[Name]", "ac"), ("[Name=y], font", "ce"), ("page[Name]", "c")])
def test_selectors(tree, text, want):
    got = select.select(select.parse(text), *tree)
    assert "".join(sorted(r[0] for r in got.collect())) == want


@pytest.mark.parametrize("text", ["", "a >", "page,,font", "page:nope", "[", "#x"])
def test_selector_errors(text):
    with pytest.raises(ValueError):
        select.parse(text)


def test_graph_edges(spark, tree):
    nodes, edges = tree
    assert [tuple(r) for r in graph.dangling(edges, nodes).collect()] == [("d", "z")]
    loop = edges.unionByName(spark.createDataFrame([("c", "b", "Child", 9)], edges.schema))
    walked = graph.walk(loop.where("edge_type = 'Child'").withColumn("step", F.col("dst")), nodes.where("node_id = 'a'").withColumn("step", F.col("node_id")), step="step")
    assert sorted(r["path"] for r in walked.collect()) == ["a", "a/b", "a/b/c", "a/b/d"]
    assert {r["src"] for r in graph.cyclic(loop).collect()} == {"a", "b", "c"} and graph.cyclic(edges).count() == 0
    kept, left = graph.remove_subtree(nodes, edges, nodes.where("node_id = 'b'"))
    assert sorted(r["node_id"] for r in kept.collect()) == ["a", "e"] and left.count() == 0


def test_walks_have_no_depth_limit_and_visit_once(spark):
    chain = [(f"n{k}", f"n{k + 1}", "Child") for k in range(90)]
    ladder = [(f"{a}{k}", f"{b}{k + 1}", "Child") for k in range(30) for a in "xy" for b in "xy"]
    edges = spark.createDataFrame(chain + ladder + [("n90", "n5", "Reference")], "src string, dst string, edge_type string").coalesce(1)
    start = spark.createDataFrame([("n0",), ("x0",), ("x0",)], "node_id string")
    got = {(r["origin"], r["node_id"]): r["depth"] for r in graph.descendants(edges, start).collect()}
    assert got == {**{("n0", f"n{k}"): k for k in range(1, 91)}, **{("x0", f"{a}{k}"): k for k in range(1, 31) for a in "xy"}}


# --- rules ---------------------------------------------------------------------------------------------------------
def test_rules_on_texts(spark):
    one = spark.createDataFrame([(1, "\\x41" * 60 + " eval(unescape(x))", "http://10.1.2.3/a", "x.pdf.exe", "D:20240229101112Z", "1.7", "en-US")], "doc_id long, s string, u string, f string, d string, v string, l string")
    r = one.select(
        rules.is_shellcode(F.col("s")).alias("shell"),
        rules.is_suspicious_url(F.col("u")).alias("url"),
        rules.is_threat_url(F.lit("a.b.c.d.e.f.g.h")).alias("dots"),
        rules.is_exfiltration_url(F.lit("http://h/?k=" + "a" * 120 + "?x y")).alias("leak"),
        rules.is_exfiltration_url(F.lit("http://h/?" + "a" * 120)).alias("no_value"),
        rules.is_exfiltration_url(F.lit("http://h=/x/" + "a" * 120)).alias("no_query"),
        rules.js_features(F.lit("é" * 20 + "$" * 21 + " var x")).alias("features"),
        rules.checksum(F.lit("é")).alias("wide"),
        rules.has_double_extension(F.col("f")).alias("double"),
        rules.is_hidden_executable(F.lit("a .exe")).alias("hidden"),
        F.date_format(rules.pdf_date(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("date"),
        rules.parse_version(F.col("v")).alias("v"),
        rules.is_language_code(F.col("l")).alias("lang"),
        rules.checksum(F.lit("ab")).alias("sum"),
        rules.media_format(F.lit("clip.MP4")).alias("media"),
        rules.uri_status(F.lit("https://x")).alias("uri"),
    ).first()
    assert r["shell"] and r["url"] and r["dots"] and r["leak"] and r["double"] and r["hidden"] and r["lang"]
    assert not r["no_value"] and not r["no_query"] and r["features"] == 2 and r["wide"] == 0xC3 * 31 + 0xA9
    assert r["date"] == "2024-02-29 10:11:12" and tuple(r["v"]) == (1, 7) and r["sum"] == 97 * 31 + 98 and r["media"] == "MP4" and r["uri"] == "Warning"


def test_checksum_of_a_long_text_takes_a_moment(spark):
    text, total = "héllo " * 50_000, 0
    for b in text.encode():
        total = (total * 31 + b) % (1 << 32)
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, s string").repartition(1)
    found = {r["k"]: r["sum"] for r in rows.select("k", rules.checksum(F.col("s")).alias("sum")).collect()}
    assert found == {1: total, 2: 0, 3: None}


def test_every_address_and_name_of_a_text_counts(spark):
    text = "see https://fine.example/a and http://x.tk/b?user=1, run Invoice.PDF.exe or a.sh now; eval(x) https://fine.example/a"
    found = findings.threats(spark.createDataFrame([(1, text), (2, ""), (3, "plain words."), (4, None)], "doc_id long, text string"))
    got = sorted((r["rule"], r["severity"], r["subject"]) for r in found.collect() if r["rule"] != "suspicious pattern")
    assert got == [
        ("double extension", "High", "Invoice.PDF.exe"),
        ("executable name", "Critical", "Invoice.PDF.exe"),
        ("executable name", "Critical", "a.sh"),
        ("exfiltration url", "High", "http://x.tk/b?user=1,"),
        ("javascript", "High", ""),
        ("outbound connection", "Medium", "http://x.tk/b?user=1,"),
        ("outbound connection", "Medium", "https://fine.example/a"),
        ("suspicious url", "High", "http://x.tk/b?user=1,"),
    ]
    more = {(r["rule"], r["severity"]) for r in findings.combinations(found).collect()}
    assert more == {("several grave findings", "Critical"), ("script with network access", "High"), ("program with script", "Critical")}
    risk = findings.risk(found.select("doc_id", "rule", "severity").unionByName(findings.combinations(found))).first()
    assert tuple(risk) == (1, 100 * 2 + 50 * 4 + 20 * 3 + 250, "CRITICAL", False)


def least_edits(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_line_diff_keeps_as_many_lines_as_can_stay(spark):
    r = random.Random(6)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
        same = findings.shortest_edit(a, b)
        assert all(a[x] == b[y] for x, y in same) and len(same) == least_edits(a, b)
        assert same == sorted(same) and len({x for x, _ in same}) == len({y for _, y in same}) == len(same)
    pairs = spark.createDataFrame([(1, "a\nb\nc", "new\na\nb\nC"), (2, None, "x"), (3, "same", "same"), (4, "gone\nkept", "kept")], "k long, old string, new string")
    got = sorted(tuple(x) for x in findings.line_diff(pairs).collect())
    assert got == [(1, "Added", None, 0, None, "new"), (1, "Modified", 2, 3, "c", "C"), (2, "Added", None, 0, None, "x"), (4, "Removed", 0, None, "gone", None)]


def test_cmaps_and_packets(spark):
    cmap = "1 beginbfrange <01> <03> [<4E2D> <00660069> <D83D DE00>] endbfrange".replace(" DE00", "DE00") + " 1 beginbfrange <10> <12> <4E00> endbfrange 1 beginbfchar <20> <41> endbfchar"
    codes = spark.createDataFrame([(1, c) for c in (1, 2, 3, 0x11, 0x20, 0x99)], "cmap_id int, code long")
    got = {r["code"]: r["char"] for r in structure.decode_codes(codes, structure.cmap_ranges(spark.createDataFrame([(1, cmap)], "cmap_id int, text string"))).collect()}
    assert got == {1: "中", 2: "fi", 3: "😀", 0x11: "丁", 0x20: "A", 0x99: None}
    packet = "<rdf:RDF xmlns:dc='x'><rdf:Description rdf:about='' pdf:Producer='P &amp; Q'><dc:title><rdf:Alt><rdf:li xml:lang='x-default'>T</rdf:li></rdf:Alt></dc:title><dc:creator>\n<rdf:Seq><rdf:li>A</rdf:li><rdf:li>B</rdf:li></rdf:Seq></dc:creator><xmp:CreatorTool>C</xmp:CreatorTool></rdf:Description></rdf:RDF>"
    got = sorted((r["key"], r["value"]) for r in structure.xmp_properties(spark.createDataFrame([(1, packet)], "doc_id long, packet string")).collect())
    assert got == [("dc:creator", "A"), ("dc:creator", "B"), ("dc:title", "T"), ("pdf:Producer", "P & Q"), ("xmp:CreatorTool", "C")]


def document(objects, trailer=b"/Root 1 0 R", streams=()):
    """A file of given objects by another writer: its own cross-reference table, stream lengths as indirect objects."""
    out, at = bytearray(b"%PDF-1.4\n%\xe2\xe3\n"), {}
    for k, body in objects.items():
        at[k] = len(out)
        out += b"%d 0 obj %s endobj\n" % (k, body)
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (k, v) for k, v in at.items())
    return bytes(out + b"trailer << /Size %d %s >>\nstartxref\n%d\n%%%%EOF" % (max(at) + 1, trailer, start))


def stream(ops, extra=b"", length=b""):
    return b"<< /Length %s %s >> stream\n%s\nendstream" % (length or b"%d" % len(ops), extra, ops)


PAGES = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Count 3 /Kids [9 0 R 3 0 R] >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R 5 0 R] >>",
    4: stream(b"BT /F1 9 Tf 1 0 0 1 10 700 Tm (Hello) Tj [(wo) 12 (rld) -300 (a\\)b)] TJ 0 -12 Td (next \\101 (nested)) Tj T* (third) ' ET", length=b"12 0 R"),
    5: stream(b"BT <FEFF4E2D> Tj 5 0 Td (same line) Tj ET BI /W 1 ID (x) Tj EI"),
    9: b"<< /Type /Pages /Count 2 /Kids [11 0 R 10 0 R] >>",
    10: b"<< /Type /Page /Contents 6 0 R >>",
    6: stream(b"BT (second) Tj ET"),
    11: b"<< /Type /Page >>",
    12: b"119",
}


def test_text_of_ordinary_files(spark):
    nodes = pdf.objects(pdf.parse(spark.createDataFrame([(1, bytearray(document(PAGES)))], "doc_id long, content binary")))
    got = {r["page"]: r["text"] for r in pdf.page_texts(nodes).collect()}
    assert got == {1: "", 2: "second", 3: "Helloworld a)b\nnext A (nested)\nthird\n中 same line"}
    kinds = sorted({(r["src"], r["dst"], r["edge_type"], r["ord"]) for r in pdf.typed_edges(nodes).collect()})
    assert ("2 0", "3 0", "Child", 1) in kinds and ("3 0", "5 0", "Content", 1) in kinds and ("4 0", "12 0", "Reference", 0) in kinds and ("3 0", "2 0", "Parent", 0) in kinds


def test_damaged_sections_are_read_as_far_as_they_go():
    whole = document(PAGES)
    table = whole.index(b"xref\n0 1")
    bad = [whole.replace(b"xref\n0 1", b"xrefX0 1"), whole.replace(b"trailer <<", b"trailer [").replace(b">>\nstartxref", b"]\nstartxref"), whole.replace(b"/Root 1 0 R >>", b"/Root 1 0 R /Prev (x) >>"), whole[:table] + b"7 0 obj << /Type /XRef /W [1] /Size 2 /Length 2 >> stream\nab\nendstream endobj\nstartxref\n%d\n%%%%EOF" % table, whole[:table] + b"7 0 obj << /Type /XRef /W [1 2 1] /Size 99 /Length 4 >> stream\nabcd\nendstream endobj\nstartxref\n%d\n%%%%EOF" % table]
    for body in bad:
        rows = pdf.read_document(body)
        assert '"recovered": true' in rows[0][5] and len([r for r in rows if r[0] == "object" and r[5] != "null"]) >= len(PAGES)


def test_freed_and_hybrid_objects():
    first = document({1: b"<< /Type /Catalog >>", 2: b"(old)"})
    at = len(first) + 1
    again = first + b"\nxref\n2 1\n0000000000 00001 f \ntrailer << /Size 3 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (first.index(b"xref\n0"), at)
    assert [r[2] for r in pdf.read_document(again) if r[0] == "object"] == [1]
    body = bytearray(b"%PDF-1.5\n")
    one, two = len(body), len(body) + len(b"1 0 obj << /Type /Catalog >> endobj\n")
    body += b"1 0 obj << /Type /Catalog >> endobj\n2 0 obj (hidden) endobj\n"
    entries = bytes([1]) + two.to_bytes(2, "big") + bytes([0])
    hidden = len(body)
    body += b"3 0 obj << /Type /XRef /W [1 2 1] /Index [2 1] /Size 4 /Length 4 >> stream\n" + entries + b"\nendstream endobj\n"
    start = len(body)
    body += b"xref\n0 3\n0000000000 65535 f \n%010d 00000 n \n0000000000 00001 f \ntrailer << /Size 4 /Root 1 0 R /XRefStm %d >>\nstartxref\n%d\n%%%%EOF" % (one, hidden, start)
    assert {r[2]: r[5] for r in pdf.read_document(bytes(body)) if r[0] == "object"} == {1: '{"Type": "/Catalog"}', 2: '"(hidden"'}


def test_signature_hits_against_plain_search(spark):
    r = random.Random(9)
    bodies = [b"".join(r.choice([b"MZ", b"PK\x03\x04", b"\xff\xd8\xff\xd8\xff", b"xy", b"\n", b"ftyp", bytes([r.randrange(256)])]) for _ in range(60)) for _ in range(8)] + [b"", b"MZ"]
    want = {(k, name, at) for k, body in enumerate(bodies) for name, magic in pdf.SIGNATURES.items() for at in range(len(body)) if body.startswith(magic, at)}
    files = spark.createDataFrame([*((k, bytearray(b)) for k, b in enumerate(bodies)), (99, None)], "doc_id long, content binary")
    assert {tuple(x) for x in pdf.signature_hits(files).collect()} == want
    narrow = {x for x in want if x[2] + len(pdf.SIGNATURES[x[1]]) <= 20 or x[2] >= len(bodies[x[0]]) - 20}
    assert {tuple(x) for x in pdf.signature_hits(files, 20).collect()} == narrow


def test_passwords_of_three_revisions():
    for revision in (2, 3, 4):
        owner = structure.owner_entry(b"boss", b"me", revision=revision)
        given = (owner, structure.user_entry(structure.file_key(b"me", owner, -4, b"id", revision=revision), b"id", revision), -4, b"id", 16, revision)
        assert structure.is_user_password(b"me", *given) and structure.is_owner_password(b"boss", *given)
        assert not structure.is_user_password(b"boss", *given) and not structure.is_owner_password(b"me", *given) and not structure.is_user_password(b"", *given)


def test_actions(spark):
    acts = ['{"S": "/JavaScript", "JS": "(eval(x)"}', '{"S": "/JavaScript"}', '{"S": "/Launch"}', '{"S": "/URI", "URI": "(ftp://x"}', '{"S": "/URI"}', '{"S": "/SubmitForm", "F": "(u"}', '{"S": "/ImportData"}', '{"S": "/GoToR"}', '{"S": "/GoTo"}', "[1]"]
    nodes = spark.createDataFrame([(1, str(k), v) for k, v in enumerate(acts)], "doc_id long, node_id string, value string")
    assert {r["node_id"]: r["severity"] for r in findings.action_threats(nodes).collect()} == {"0": "High", "1": "Medium", "2": "Critical", "3": "High", "5": "High", "6": "High", "7": "Low"}


def test_revisions(spark):
    rows = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 1), (1, 1, "a", 2), (1, 1, "c", 1), (1, 2, "a", 2), (1, 2, "c", 1)], "doc_id long, rev int, obj string, mark int")
    got = {tuple(r)[1:] for r in findings.revision_delta(rows).collect()}
    assert got == {(0, "a", "added"), (0, "b", "added"), (1, "a", "modified"), (1, "c", "added"), (1, "b", "deleted")}


def test_cbor_round_trip():
    for value in (None, True, -1, 0, 23, 24, 300, 70_000, 1 << 40, 1.5, "é", [1, [2]], {"a": {"b": []}}):
        assert export._uncbor(export._cbor(value))[0] == value
    assert export._cbor([1, 2]).hex() == "820102"


def test_registry_order():
    own = registry.Registry()
    own.register(registry.Plugin("a", lambda df: df, needs=("b",), tags=frozenset(["t"])))
    own.register(registry.Plugin("b", lambda df: df))
    assert own.order(["a"]) == ["b", "a"] and own.tagged("t") == ["a"]
    with pytest.raises(ValueError):
        own.unregister("b")
    own.plugins["b"] = registry.Plugin("b", lambda df: df, needs=("a",))
    with pytest.raises(ValueError):
        own.order()
