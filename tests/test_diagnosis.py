"""Operators over makers, signatures, states, compliance and repairs, on given inputs and against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import conformance, diagnosis
from quire.plans import diagnosis_queries
from quire.sources import export, pdf
from quire.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for name in TABLES:
        out.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return out


def _plain(x):
    return None if x is None else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", list(diagnosis_queries.QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    got = diagnosis_queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(diagnosis_queries.ORACLE[name])
    assert columns == sorted(want.columns)
    assert sorted(repr(tuple(map(_plain, r))) for r in got.select(columns).collect()) == sorted(repr(tuple(map(_plain, r))) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_profiles_of_signatures(spark):
    documents = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False)], "doc_id long, has_store boolean")
    signatures = spark.createDataFrame([(1, "adbe.pkcs7.sha1", None, None), (1, "adbe.pkcs7.sha1", "valid", None), (2, "ETSI.RFC3161", None, None), (2, "adbe.pkcs7.detached", None, None), (3, "other", "valid", True)], "doc_id long, filter string, validity string, stamp_valid boolean")
    assert _rows(diagnosis.signature_profiles(documents, signatures, store_needed=True)) == [(1, "PAdES-LTV", "Fail"), (2, "PAdES-LTV", "Pass"), (2, "RFC3161", "Warning"), (3, "none", "Warning"), (4, "none", "Warning")]
    assert _rows(diagnosis.signature_profiles(documents.limit(0), signatures.limit(0))) == []


def test_pins_block_before_they_allow(spark):
    prints = spark.createDataFrame([("AA",), ("bb",), ("cc",)], "f string")
    ask = lambda allowed, blocked: [r[0] for r in prints.select(diagnosis.pinned(F.col("f"), allowed, blocked)).collect()]
    assert ask(["aa", "BB"], ["bb"]) == [True, False, False]
    assert ask([], ["bb"]) == [True, False, True]
    assert ask([], []) == [None, None, None]


def test_formats_of_signatures(spark):
    data = [b"\x30" + b"x" * 60, b"\x30" + b"x" * 30, b"\x30" + b"x" * 12, b"-----BEGIN PKCS7-----", b"-----BEGIN CERTIFICATE-----", b"-----BEGIN X", b"", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, data binary")
    assert [r[0] for r in rows.orderBy("i").select(diagnosis.signature_format(F.col("data"))).collect()] == ["PKCS7", "Time stamp", "Unknown", "PKCS7 PEM", "Certificate PEM", "Unknown", "Unknown", "Unknown"]


def test_digests_by_name(spark):
    import hashlib

    rows = spark.createDataFrame([(n, b"abc") for n in ("SHA-1", "SHA-256", "SHA-384", "SHA-512", "MD2")], "name string, data binary")
    got = dict(map(tuple, rows.select("name", diagnosis.digest(F.col("data"), F.col("name"))).collect()))
    assert got == {"SHA-1": hashlib.sha1(b"abc").hexdigest(), "SHA-256": hashlib.sha256(b"abc").hexdigest(), "SHA-384": hashlib.sha384(b"abc").hexdigest(), "SHA-512": hashlib.sha512(b"abc").hexdigest(), "MD2": None}


def test_states_take_entries_of_their_kind_only(spark):
    value = '{"LW": 2, "LC": 1, "ML": 10.5, "OP": "/x", "TK": false, "BM": ["/Darken"], "SMask": {"S": "/Alpha"}, "TR": {"R": "4 0"}}'
    rows = spark.createDataFrame([(1, "a", value), (1, "b", '{"LW": 2.5, "BM": 7}'), (1, "c", "12"), (1, "d", None)], "doc_id long, node_id string, value string")
    assert [r[1:] for r in _rows(diagnosis.graphics_states(rows))] == [
        ("a", "blend_mode", "Darken"), ("a", "line_cap", "1"), ("a", "miter_limit", "10.5"), ("a", "soft_mask", "Present"), ("a", "text_knockout", "false"), ("a", "transfer", "Reference"),
        ("b", "blend_mode", "Normal"), ("b", "line_width", "2.5"),
    ]


def test_linearization_needs_all_entries_in_the_first_kilobyte(spark):
    head = "%PDF-1.4\n1 0 obj\n<< /Linearized 1.0 /L 5 /H [ 6 7 ] /O 8 /E 9 /N 10 /T 11 >>\nendobj"
    rows = [(0, head), (1, head.replace("/T 11", "")), (2, head.replace(" 7 ]", " ]")), (3, " " * 1000 + head), (4, head.replace("/Linearized 1.0", "")), (5, "")]
    got = spark.createDataFrame(rows, "i int, t string").orderBy("i").select(diagnosis.linearization(F.encode("t", "UTF-8")).alias("l")).collect()
    assert [None if r.l is None else tuple(r.l) for r in got] == [(1.0, 5, 6, 7, 10, 8, 9, 11), None, (1.0, 5, 6, None, 10, 8, 9, 11), None, None, None]


def test_repairs_by_level(spark):
    assert diagnosis.strategies("Conservative") == ["BasicStructure", "StructureRepair", "Reference"]
    assert diagnosis.strategies("Experimental")[-1] == "Experimental"
    good = "%PDF-1.4\n1 0 obj << /A 2 0 R >> endobj trailer\n%%EOF"
    files = spark.createDataFrame([(1, good), (2, "xx" + good.replace("0 R", "0R")), (3, good.replace("endobj", "endobje").replace(">>", "")), (4, ""), (5, None)], "doc_id long, text string")
    mended = {r.doc_id: (r.text, r.actions) for r in diagnosis.repaired(files).collect()}
    assert mended[1] == (good, [])
    assert mended[2] == (good, ["BasicStructure", "Reference"])
    assert mended[3] == (good.replace(">>", "") + "]]", ["Heuristic"])
    assert mended[4] == ("%PDF-1.4\ntrailer\n<<\n/Size 2\n/Root 1 0 R\n>>\nstartxref\n0\n\n%%EOF", ["BasicStructure"])
    assert mended[5][0] is None
    careful = {r.doc_id: r.actions for r in diagnosis.repaired(files, "Conservative").collect()}
    assert careful[3] == []
    text = "%PDF-1.4\nstream\r\nabc endstream\nstream\nok\nendstream page Fond Pages trailer\n%%EOF"
    (one,) = diagnosis.repaired(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert one.text == "%PDF-1.4\nstream\nabc \nendstream\nstream\nok\nendstream Page Font Pages trailer\n%%EOF"
    assert one.actions == ["Stream", "FuzzyMatching"]


def test_a_batch_applies_changes_in_order(spark):
    nodes = spark.createDataFrame([(n, t, {}) for n, t in (("r", "Catalog"), ("a", "Pages"), ("b", "Page"), ("c", "Page"))], "node_id string, node_type string, props map<string,string>")
    edges = spark.createDataFrame([("r", "a", "Child", 0), ("a", "b", "Child", 0), ("a", "c", "Child", 1)], "src string, dst string, edge_type string, ord long")
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    batch = [
        ("insert", one([("a", "d", "Page", {})], "parent string, node_id string, node_type string, props map<string,string>")),
        ("move", one([("c", "d")], "node_id string, new_parent string")),
        ("replace", one([("b", "Other", {"x": "1"})], "node_id string, node_type string, props map<string,string>")),
        ("remove", one([("d",)], "node_id string")),
    ]
    left, links = diagnosis.apply_batch(nodes, edges, batch)
    assert _rows(left.select("node_id", "node_type")) == [("a", "Pages"), ("b", "Other"), ("r", "Catalog")]
    assert _rows(links.select("src", "dst")) == [("a", "b"), ("r", "a")]
    with pytest.raises(ValueError):
        diagnosis.apply_batch(nodes, edges, [("swap", nodes)])


def _file(catalog, *objects, version="2.0", trailer="/Root 1 0 R /Size 20 /ID [(a) (b)]"):
    body = [f"<< /Type /Catalog /Pages 2 0 R {catalog} >>", *objects]
    return "".join([f"%PDF-{version}\n", *(f"{k} 0 obj\n{b}\nendobj\n" for k, b in enumerate(body, 1)), f"trailer\n<< {trailer} >>\n%%EOF"]).encode()


def test_rules_of_profiles(spark):
    pages = "<< /Type /Pages /Count 1 /Kids [3 0 R] >>", "<< /Type /Page /Parent 2 0 R /TrimBox [0 0 1 1] >>"
    packet = lambda sub, text, kind="/Type /Metadata": f"<< {kind} /Subtype /{sub} /Length {len(text)} >>\nstream\n{text}\nendstream"
    good = _file("/Version /2.0 /Metadata 4 0 R /Lang (en) /MarkInfo << /Marked true >> /StructTreeRoot 5 0 R", *pages, packet("XML", "<x:xmpmeta/>"), "<< /Type /StructTreeRoot /K [6 0 R] /ParentTree 7 0 R >>", "<< /Type /StructElem /S /P >>", "<< /Nums [] >>")
    bad = _file(
        "/Lang () /Metadata 4 0 R /StructTreeRoot 5 0 R", "<< /Type /Pages /Kids [3 0 R] >>", "<< /Type /Page /Resources << /ColorSpace << /A [/Indexed /DeviceRGB 1 (x)] >> >> >>", packet("Text", "plain"), "<< /Type /StructTreeRoot /K [] >>",
        "<< /Type /StructElem /S /Figure >>", "<< /Type /XObject /Subtype /Image /ColorSpace /DeviceRGB >>", "<< /Type /Font >>", trailer="/Root 1 0 R /Size 3 /ID [(a)]",
    )
    old = _file("/Version /2.0 /Metadata << /A 1 >>", *pages, version="1.7", trailer="/Root 1 0 R /Size 20")
    rows = pdf.parse(spark.createDataFrame([(1, good), (2, bad), (3, old)], "doc_id long, content binary"))

    def broken(doc, profile):
        return {r.code for r in conformance.issues(rows, profile).where(F.col("doc_id") == doc).collect()}

    assert broken(1, "PDF-2.0") == set()
    assert broken(1, "PDF/UA") == set()
    assert broken(2, "PDF-2.0") == {"PAGES_NO_COUNT", "PAGES_COUNT_MISSING", "CATALOG_VERSION_MISSING", "TRAILER_SIZE_INCONSISTENT", "TRAILER_ID_INVALID", "METADATA_SUBTYPE_INVALID", "FONT_ENCODING_MISSING"}
    assert broken(2, "PDF/UA") == {"NO_TAGGED_STRUCTURE", "LANG_EMPTY", "ALT_TEXT_MISSING", "READING_ORDER_INCOMPLETE", "METADATA_STREAM_INVALID"}
    assert broken(2, "PDF/X") == {"FONT_NOT_EMBEDDED", "OUTPUT_INTENTS_MISSING", "DEVICE_RGB_DISALLOWED", "IMAGE_DEVICE_RGB_DISALLOWED", "TRIM_BOX_MISSING"}
    assert broken(3, "PDF-2.0") == {"TRAILER_ID_MISSING", "CATALOG_VERSION_MISMATCH", "METADATA_NOT_STREAM"}
    assert broken(3, "PDF/X") == {"OUTPUT_INTENTS_MISSING"}


def test_schema_of_an_export(spark):
    df = spark.createDataFrame([(1, "a", [1.5], {"k": True}, (b"x", None))], "id long not null, name string, xs array<double>, flags map<string,boolean>, s struct<data:binary,day:date>")
    got = export.json_schema(df.schema, "Rows")
    assert got["$schema"].endswith("draft-07/schema#") and got["title"] == "Rows" and got["required"] == ["id"]
    assert got["properties"] == {
        "id": {"type": "integer"}, "name": {"type": "string"}, "xs": {"type": "array", "items": {"type": "number"}}, "flags": {"type": "object", "additionalProperties": {"type": "boolean"}},
        "s": {"type": "object", "required": [], "properties": {"data": {"type": "string"}, "day": {"type": "string"}}},
    }


def test_a_consumer_ends_its_stream(spark, sf, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet(f"{sf}/events.parquet").repartition(4).write.parquet(path)
    seen = []
    keep = lambda limit: lambda batch, epoch: seen.append(batch.count()) or len(seen) < limit
    assert ingest.consume(ingest.file_stream(spark, path, 1), keep(2)) == 2 and len(seen) == 2
    seen.clear()
    assert ingest.consume(ingest.file_stream(spark, path, 1), keep(99)) == 4
    assert sum(seen) == spark.read.parquet(path).count()


def test_rows_are_observed_on_their_way(spark):
    df, seen = ingest.observed(spark.createDataFrame([("a",), ("a",), ("b",)], "node_type string"), "nodes")
    df.collect()
    assert seen.get == {"n": 3, "kinds": 2}
