"""Registered queries over documents that are written from the texts and parsed back; SQL tells what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import conformance, findings
from ..sources import pdf
from ..sources.bridge import table
from ..sources.shared import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

ALL = """WITH d AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n_lines, CAST(ceil(len(string_split(text, chr(10))) / 40.0) AS BIGINT) AS n_pages,
 doc_id % 5 = 0 AS js, doc_id % 7 = 0 AS uri, doc_id % 4 = 1 AS revised, doc_id % 6 = 2 AS has_trailing, doc_id % 8 = 3 AS file, doc_id % 10 = 7 AS encrypted, doc_id % 9 = 8 AS broken FROM documents WHERE text IS NOT NULL)"""


def _register(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql.replace("@all", ALL)
        return fn

    return add


def _rows(spark, d):
    return pdf.parse(pdf.rendered(table(spark, d, "documents").where("text is not null")))


@_register("@all SELECT doc_id, concat('1.', 4 + doc_id % 4) AS version, CASE WHEN broken OR NOT revised THEN 1 ELSE 2 END AS revisions, broken AS recovered, CASE WHEN revised THEN 2 ELSE 1 END AS eof_marks, has_trailing, encrypted FROM d")
def parsed_documents(spark, d):
    return pdf.documents(_rows(spark, d)).select("doc_id", "version", "revisions", "recovered", "eof_marks", "has_trailing", "encrypted")


@_register("""@all SELECT doc_id, unnest(['Catalog', 'Pages', 'Page', 'ContentStream', 'JavaScriptAction', 'Annotation', 'URIAction', 'Filespec', 'Object']) AS node_type, unnest([1, 1, n_pages, n_pages, js::BIGINT, uri::BIGINT, uri::BIGINT, file::BIGINT, 1 + revised::BIGINT]) AS n FROM d""")
def parsed_type_histogram(spark, d):
    kinds = ["Catalog", "Pages", "Page", "ContentStream", "JavaScriptAction", "Annotation", "URIAction", "Filespec", "Object"]
    by = pdf.objects(_rows(spark, d)).groupBy("doc_id").agg(*(F.count_if(F.col("node_type") == k).alias(k) for k in kinds))
    return by.unpivot("doc_id", kinds, "node_type", "n")


@_register("@all SELECT doc_id, n_pages, md5(text) AS digest FROM d")
def parsed_text(spark, d):
    texts = pdf.page_texts(pdf.objects(_rows(spark, d)))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n")
    return texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.md5(whole.cast("binary")).alias("digest"))


@_register("@all SELECT doc_id, 1 + js::BIGINT + file::BIGINT + 3 * n_pages + 2 * uri::BIGINT + revised::BIGINT AS n_references, CAST(0 AS BIGINT) AS n_dangling FROM d")
def parsed_references(spark, d):
    nodes = pdf.objects(_rows(spark, d)).select("doc_id", "node_id", "value")
    refs = pdf.object_references(nodes)
    there = nodes.select("doc_id", F.col("node_id").alias("dst"), F.lit(True).alias("there"))
    return refs.join(there, ["doc_id", "dst"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_references"), F.count_if(F.col("there").isNull()).alias("n_dangling"))


@_register("@all SELECT doc_id, CASE WHEN revised THEN 'Revised' ELSE concat('Document (', doc_id, ')') END AS title, 'Quire' AS producer FROM d")
def parsed_info(spark, d):
    rows = pdf.objects(_rows(spark, d)).where("node_id = '3 0'")
    text = lambda name: F.expr(f"substring(get_json_object(value, '$.{name}'), 2)")
    return rows.select("doc_id", text("Title").alias("title"), text("Producer").alias("producer"))


@_register("@all SELECT doc_id, 0 AS rev, CASE WHEN revised AND NOT broken THEN 2 ELSE 3 + 2 * n_pages + js::BIGINT + 2 * uri::BIGINT + file::BIGINT + revised::BIGINT END AS n FROM d UNION ALL SELECT doc_id, 1, 3 + 2 * n_pages + js::BIGINT + 2 * uri::BIGINT + file::BIGINT FROM d WHERE revised AND NOT broken")
def parsed_revisions(spark, d):
    return _rows(spark, d).where("kind = 'rev'").groupBy("doc_id", "rev").agg(F.count(F.lit(1)).alias("n"))


@_register("@all, o AS (SELECT doc_id, unnest(['BT', 'ET', 'Tf', 'Td', 'Tj']) AS op, unnest([n_pages, n_pages, n_pages, n_pages + n_lines, n_lines]) AS n FROM d) SELECT * FROM o")
def parsed_operators(spark, d):
    return conformance.content_operators(pdf.objects(_rows(spark, d))).groupBy("doc_id", "op").agg(F.count(F.lit(1)).alias("n"))


@_register("""@all SELECT doc_id, 'JavaScriptAction' AS "check", 'Fail' AS status FROM d WHERE js UNION ALL SELECT doc_id, 'ExternalAction', 'Warning' FROM d WHERE uri UNION ALL SELECT doc_id, 'EmbeddedFile', 'Warning' FROM d WHERE file
 UNION ALL SELECT doc_id, 'OpenAction', 'Warning' FROM d WHERE js UNION ALL SELECT doc_id, 'TrailingData', 'Warning' FROM d WHERE has_trailing UNION ALL SELECT doc_id, 'RevisionHistory', 'Warning' FROM d WHERE revised AND NOT broken
 UNION ALL SELECT doc_id, 'Security', 'Pass' FROM d WHERE NOT (js OR uri OR file OR has_trailing OR (revised AND NOT broken))""")
def indicator_rows(spark, d):
    return conformance.indicators(_rows(spark, d))


RULES = {
    "PDF-2.0": "SELECT doc_id, 'TRAILER_ID_MISSING' AS code, 'Warning' AS severity, CAST(1 AS BIGINT) AS n FROM d",
    "PDF/A-1b": "SELECT doc_id, 'ENCRYPTION_NOT_ALLOWED' AS code, 'Error' AS severity, CAST(1 AS BIGINT) AS n FROM d WHERE encrypted UNION ALL SELECT doc_id, 'JAVASCRIPT_NOT_ALLOWED', 'Error', 1 FROM d WHERE js UNION ALL SELECT doc_id, 'EXTERNAL_REFERENCE_NOT_ALLOWED', 'Error', 1 FROM d WHERE uri UNION ALL SELECT doc_id, 'EMBEDDED_FILE_NOT_ALLOWED', 'Error', 1 FROM d WHERE file",
    "PDF/X": "SELECT doc_id, 'ENCRYPTION_NOT_ALLOWED' AS code, 'Error' AS severity, CAST(1 AS BIGINT) AS n FROM d WHERE encrypted UNION ALL SELECT doc_id, 'JAVASCRIPT_NOT_ALLOWED', 'Error', 1 FROM d WHERE js UNION ALL SELECT doc_id, 'OUTPUT_INTENTS_MISSING', 'Error', 1 FROM d UNION ALL SELECT doc_id, 'TRIM_BOX_MISSING', 'Warning', n_pages FROM d",
    "PDF/UA": "SELECT doc_id, unnest(['NO_TAGGED_STRUCTURE', 'LANG_MISSING', 'STRUCT_TREE_ROOT_MISSING', 'ACCESSIBILITY_METADATA_MISSING', 'STRUCT_ELEM_MISSING']) AS code, 'Error' AS severity, CAST(1 AS BIGINT) AS n FROM d",
}


def _profile(name: str, profile: str, sql: str) -> None:
    def run(spark, d):
        return conformance.issues(_rows(spark, d), profile)

    run.__name__ = name
    _register(f"@all {sql}")(run)


for _name, _p in (("validate_base", "PDF-2.0"), ("validate_archive", "PDF/A-1b"), ("validate_print", "PDF/X"), ("validate_accessible", "PDF/UA")):
    _profile(_name, _p, RULES[_p])


@_register("@all SELECT doc_id, CAST(f AS BIGINT) AS failed, CAST(8 - f AS BIGINT) AS passed, f = 0 AS is_valid FROM (SELECT doc_id, encrypted::INT + js::INT + uri::INT + file::INT AS f FROM d)")
def validation_report(spark, d):
    return conformance.report(_rows(spark, d), "PDF/A-1b")


@_register("""@all, p AS (SELECT doc_id, 'PDF/A-1b' AS profile, encrypted::INT + js::INT + uri::INT + file::INT AS f, 8 AS n, encrypted OR js OR uri OR file AS bad FROM d UNION ALL SELECT doc_id, 'PDF-2.0', 1, 19, false FROM d
 UNION ALL SELECT doc_id, 'PDF/UA', 5, 12, true FROM d WHERE doc_id % 4 = 3 UNION ALL SELECT doc_id, 'PDF/X', encrypted::INT + js::INT + 2, 9, true FROM d) SELECT doc_id, profile, CAST(f AS BIGINT) AS failed, CAST(n - f AS BIGINT) AS passed, NOT bad AS is_valid FROM p""")
def validation_of_all_profiles(spark, d):
    return conformance.all_reports(_rows(spark, d))


@_register("@all SELECT doc_id, i AS integrity, i AS score, CASE WHEN i = 1 THEN 'Healthy' ELSE 'Damaged' END AS level FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 2 AND NOT has_trailing THEN 1.0 ELSE 2 / 3 END::DOUBLE AS i FROM d)")
def document_health(spark, d):
    """A file ends with its end mark only where the line break after it is cut off, here for one in four."""
    files = pdf.rendered(table(spark, d, "documents").where("text is not null"))
    cut = F.expr("CASE WHEN doc_id % 4 = 2 AND substring(content, -1, 1) = X'0A' THEN substring(content, 1, octet_length(content) - 1) ELSE content END")
    return conformance.health(stored(pdf.parse(files.withColumn("content", cut)), "rows"))


@_register("""@all SELECT doc_id, 'TrailingData' AS "check", CAST(1 AS BIGINT) AS n FROM d WHERE has_trailing UNION ALL SELECT doc_id, 'MultipleEOF', 2 FROM d WHERE revised UNION ALL SELECT doc_id, 'MultipleStartXref', 2 FROM d WHERE revised AND broken
 UNION ALL SELECT doc_id, 'TrailerSizeMismatch', 10 - 3 - js::INT - 2 * uri::INT - file::INT - revised::INT FROM d""")
def document_heuristics(spark, d):
    return pdf.heuristics(_rows(spark, d))


@_register("@all SELECT doc_id, 'JavaScript' AS action, 'Medium' AS severity FROM d WHERE js UNION ALL SELECT doc_id, 'URI', 'Medium' FROM d WHERE uri")
def action_threats(spark, d):
    return findings.action_threats(pdf.objects(_rows(spark, d))).select("doc_id", "action", "severity")


def signature_hits(spark, d):
    """Signatures of other formats in the written files; compressed bytes are beyond SQL, tests compare with a plain search."""
    return pdf.signature_hits(pdf.rendered(table(spark, d, "documents").where("text is not null")))


QUERIES["signature_hits"] = signature_hits


@_register("""@all SELECT doc_id, unnest(['Child', 'Content', 'Parent', 'Annotation', 'Action', 'Name']) AS edge_type, unnest([n_pages + 1, n_pages, n_pages, uri::BIGINT, uri::BIGINT + js::BIGINT, file::BIGINT]) AS n FROM d""")
def parsed_edges(spark, d):
    kinds = ["Child", "Content", "Parent", "Annotation", "Action", "Name"]
    by = pdf.typed_edges(pdf.objects(_rows(spark, d))).groupBy("doc_id").agg(*(F.count_if(F.col("edge_type") == k).alias(k) for k in kinds))
    return by.unpivot("doc_id", kinds, "edge_type", "n")


@_register("@all SELECT doc_id, CAST(i AS INT) AS page, CAST(10 + 2 * (i - 1) AS INT) AS obj FROM (SELECT doc_id, unnest(generate_series(1, n_pages)) AS i FROM d)")
def parsed_page_order(spark, d):
    nodes = stored(pdf.objects(_rows(spark, d)).where("node_type in ('Catalog', 'Pages', 'Page')").drop("stream"), "objects")
    return pdf.page_order(nodes).select("doc_id", "page", F.split("node_id", " ")[0].cast("int").alias("obj"))


@_register("SELECT doc_id, f AS filter, md5(text) AS digest FROM documents, unnest(['ASCIIHexDecode', 'ASCII85Decode', 'FlateDecode', 'LZWDecode', 'RunLengthDecode', 'ASCII85Decode,FlateDecode']) AS t(f) WHERE text IS NOT NULL")
def codec_round_trip(spark, d):
    """Every text through every chain and back: a text crosses to Python once, with all chains."""
    chains = [*codecs.ENCODERS, "ASCII85Decode,FlateDecode"]
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    back = codecs.round_trips(docs, chains)
    return back.select("doc_id", F.posexplode("decoded").alias("k", "body")).select("doc_id", F.get(F.array(*map(F.lit, chains)), F.col("k")).alias("filter"), F.md5("body").alias("digest"))


@_register("SELECT o_orderkey, md5(concat_ws('|', o_orderpriority, o_orderstatus)) AS digest FROM orders")
def predictor_round_trip(spark, d):
    """PNG rows with the left-neighbour rule, made in SQL and undone by the predictor."""
    import pyarrow as pa

    orders = table(spark, d, "orders").select("o_orderkey", F.encode(F.concat_ws("|", "o_orderpriority", "o_orderstatus"), "UTF-8").alias("data"))

    def rows(batches):
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                row = bytes([1]) + bytes((b - a) & 255 for a, b in zip(b"\0" + data, data))
                out.append(codecs.predictor_decode(row, 15, 1, 8, len(data)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["o_orderkey", "data"])

    return orders.mapInArrow(rows, "o_orderkey long, data binary").select("o_orderkey", F.md5("data").alias("digest"))
