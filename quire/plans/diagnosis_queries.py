"""Registered queries over makers, signatures, states, compliance, statistics and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnosis
from ..sources.bridge import object_edges, object_nodes, table
from .graph_queries import ALL, _from_root

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql.replace("@all", ALL)
        return fn

    return add


def _pick(column: str, values: dict, other=None):
    """The value that belongs to a column's value."""
    out = F.lit(other)
    for key, value in values.items():
        out = F.when(F.col(column) == key, F.lit(value)).otherwise(out)
    return out


@_register("""SELECT doc_id, maker FROM (SELECT o_orderkey AS doc_id, CASE o_orderpriority WHEN '1-URGENT' THEN ['Adobe'] WHEN '2-HIGH' THEN ['Apple'] WHEN '3-MEDIUM' THEN ['Ghostscript', 'Apple'] ELSE [] END AS a, CASE o_orderstatus WHEN 'F' THEN ['MuPDF'] WHEN 'O' THEN ['Adobe'] ELSE [] END AS b FROM orders), unnest(list_distinct(list_concat(a, b))) AS u(maker)""")
def producer_quirks(spark, d):
    """Orders as documents, their priority as producer and their status as creator."""
    producer = _pick("o_orderpriority", {"1-URGENT": "Adobe Acrobat 9", "2-HIGH": "Mac OS X 10 Quartz", "3-MEDIUM": "GPL Ghostscript on Apple"})
    creator = _pick("o_orderstatus", {"F": "muPDF 1.2", "O": "ADOBE InDesign"}, "other")
    return diagnosis.producer_quirks(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), producer.alias("producer"), creator.alias("creator")))


_FILTERS = {"1-URGENT": "ETSI.CAdES.detached", "2-HIGH": "ETSI.RFC3161", "3-MEDIUM": "adbe.pkcs7.detached", "4-NOT SPECIFIED": "adbe.x509.rsa_sha1"}


@_register("""WITH d AS (SELECT c_custkey AS doc_id, c_mktsegment = 'BUILDING' AS has_store FROM customer), s AS (SELECT o_custkey AS doc_id, o_orderpriority AS p, o_orderstatus AS v FROM orders WHERE o_orderpriority <> '5-LOW'),
 r AS (SELECT doc_id, 'CAdES' AS profile, CASE v WHEN 'F' THEN 'Pass' WHEN 'O' THEN 'Fail' ELSE 'Warning' END AS status FROM s WHERE p = '1-URGENT' UNION ALL SELECT doc_id, 'RFC3161', CASE v WHEN 'F' THEN 'Pass' WHEN 'O' THEN 'Fail' ELSE 'Warning' END FROM s WHERE p = '2-HIGH'
 UNION ALL SELECT doc_id, 'PAdES-LTV', CASE WHEN has_store THEN 'Pass' ELSE 'Warning' END FROM d WHERE doc_id IN (SELECT doc_id FROM s WHERE p IN ('3-MEDIUM', '4-NOT SPECIFIED')) UNION ALL SELECT doc_id, 'none', 'Warning' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM s))
 SELECT profile, status, count(*) AS n, sum(doc_id)::BIGINT AS total FROM r GROUP BY ALL""")
def signature_profiles(spark, d):
    """Customers as documents, their orders as signatures."""
    documents = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_mktsegment") == "BUILDING").alias("has_store"))
    validity, stamp = _pick("o_orderstatus", {"F": "valid", "O": "invalid"}, "unknown"), _pick("o_orderstatus", {"F": True, "O": False})
    signatures = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), _pick("o_orderpriority", _FILTERS, "other").alias("filter"), validity.alias("validity"), stamp.cast("boolean").alias("stamp_valid"))
    return diagnosis.signature_profiles(documents, signatures).groupBy("profile", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("total"))


@_register("SELECT o_orderkey, o_orderpriority <> '5-LOW' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AS both_lists, o_orderpriority <> '5-LOW' AS only_blocked, true AS no_list FROM orders")
def pinned_authorities(spark, d):
    c = F.col("o_orderpriority")
    allowed, blocked = ["1-urgent", "2-High", "5-LOW"], ["5-low"]
    return table(spark, d, "orders").select("o_orderkey", diagnosis.pinned(c, allowed, blocked).alias("both_lists"), diagnosis.pinned(c, [], blocked).alias("only_blocked"), diagnosis.pinned(c, [], []).isNull().alias("no_list"))


@_register("""SELECT doc_id, CASE WHEN text IS NULL THEN 'Unknown' WHEN doc_id % 4 = 0 AND strlen(text) + 1 > 50 THEN 'PKCS7' WHEN doc_id % 4 = 0 AND strlen(text) + 1 > 20 THEN 'Time stamp' WHEN doc_id % 4 = 1 THEN 'PKCS7 PEM' WHEN doc_id % 4 = 2 THEN 'Certificate PEM' ELSE 'Unknown' END AS format FROM documents""")
def signature_formats(spark, d):
    """Every text as a signature's bytes, behind a mark that its id gives it."""
    mark = F.element_at(F.array(*map(F.lit, ("0", "-----BEGIN PKCS7-----\n", "-----BEGIN CERTIFICATE-----\n", "\x01"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", diagnosis.signature_format(F.encode(F.concat(mark, "text"), "UTF-8")).alias("format"))


@_register("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha1(text) WHEN 1 THEN sha256(text) END AS digest FROM documents")
def content_digests(spark, d):
    algorithm = F.element_at(F.array(*map(F.lit, ("SHA-1", "SHA-256", "MD2"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", diagnosis.digest(F.encode("text", "UTF-8"), algorithm).alias("digest"))


def _json(**entries: str):
    """A dictionary of an item's keys and of expressions giving JSON texts, left out where null."""
    parts = [F.concat(F.lit(f'"{key}": '), F.expr(value)) for key, value in entries.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


@_register("""SELECT p_partkey AS doc_id, 'p' AS node_id, name, space FROM (
 SELECT p_partkey, 'A' AS name, CASE p_size % 4 WHEN 0 THEN 'DeviceRGB' WHEN 1 THEN 'DeviceGray' WHEN 2 THEN 'DeviceCMYK' END AS space FROM part
 UNION ALL SELECT p_partkey, 'B', CASE p_size % 3 WHEN 0 THEN 'ICCBased' WHEN 1 THEN 'Indexed' ELSE 'Reference' END FROM part) WHERE space IS NOT NULL""")
def page_color_spaces(spark, d):
    """Parts as pages with two colour spaces each: names, arrays and references by their size."""
    a = """element_at(array('"/DeviceRGB"', '"/DeviceGray"', '"/DeviceCMYK"', '"/Own"'), cast(p_size % 4 + 1 as int))"""
    b = """element_at(array('["/ICCBased", {"R": "7 0"}]', '["/Indexed", "/DeviceRGB", 255, "(x"]', '{"R": "9 0"}'), cast(p_size % 3 + 1 as int))"""
    parts = table(spark, d, "part").withColumn("a", F.expr(a)).withColumn("b", F.expr(b))
    value = F.concat(F.lit('{"Type": "/Page", "Resources": {"ColorSpace": '), _json(A="a", B="b"), F.lit("}}"))
    return diagnosis.page_color_spaces(parts.select(F.col("p_partkey").alias("doc_id"), F.lit("p").alias("node_id"), value.alias("value")))


@_register("""SELECT p_partkey AS doc_id, 'g' AS node_id, property, setting FROM (
 SELECT p_partkey, 'line_cap' AS property, cast(p_size AS VARCHAR) AS setting FROM part UNION ALL SELECT p_partkey, 'rendering_intent', 'Perceptual' FROM part WHERE p_size % 2 = 0
 UNION ALL SELECT p_partkey, 'alpha_fill', '0.5' FROM part UNION ALL SELECT p_partkey, 'overprint', 'true' FROM part WHERE p_size % 3 = 0
 UNION ALL SELECT p_partkey, 'blend_mode', CASE p_size % 3 WHEN 0 THEN 'Multiply' WHEN 1 THEN 'Screen' ELSE 'Normal' END FROM part
 UNION ALL SELECT p_partkey, 'soft_mask', CASE p_size % 2 WHEN 0 THEN 'None' ELSE 'Reference' END FROM part UNION ALL SELECT p_partkey, 'transfer', 'Identity' FROM part WHERE p_size % 5 = 0)""")
def graphics_states(spark, d):
    """Parts as graphics states; a line width that is no real number and an overprint that is no boolean do not count."""
    value = _json(
        LW="cast(p_size as string)", LC="cast(p_size as string)", ca="'0.5'",
        RI="if(p_size % 2 = 0, '\"/Perceptual\"', '12')", OP="if(p_size % 3 = 0, 'true', '1')",
        BM="element_at(array('\"/Multiply\"', '[\"/Screen\", \"/Normal\"]', '[]'), cast(p_size % 3 + 1 as int))",
        SMask="if(p_size % 2 = 0, '\"/None\"', '{\"R\": \"4 0\"}')", TR="if(p_size % 5 = 0, '\"/Identity\"', null)",
    )
    return diagnosis.graphics_states(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("g").alias("node_id"), value.alias("value")))


@_register("""SELECT p_partkey AS doc_id, CASE p_size % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'list' WHEN 2 THEN 'form' ELSE 'none' END AS part, p_name AS alt, CASE WHEN p_size % 2 = 0 THEN 'de' ELSE 'en' END AS lang, CASE WHEN p_size % 4 = 0 THEN 'a|' || p_brand END AS headers, CASE WHEN p_size % 4 = 0 THEN p_size ELSE -1 END::INT AS col_span, CASE WHEN p_size % 4 = 0 THEN 'Column' END AS scope FROM part""")
def accessibility_attributes(spark, d):
    """Parts as structure elements of four types."""
    value = F.to_json(F.struct(
        F.element_at(F.array(*map(F.lit, ("/TH", "/LI", "/Form", "/P"))), (F.col("p_size") % 4 + 1).cast("int")).alias("S"),
        F.concat(F.lit("("), "p_name").alias("Alt"), F.lit("(en").alias("Lang"),
        F.struct(F.lit("/Layout").alias("O"), F.lit("/Column").alias("Scope"), F.col("p_size").alias("ColSpan"), F.array(F.lit("(a"), F.concat(F.lit("("), "p_brand")).alias("Headers"), F.when(F.col("p_size") % 2 == 0, "(de").alias("Lang")).alias("A"),
    ))
    made = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("e").alias("node_id"), value.alias("value"))
    found = diagnosis.accessibility_attributes(made)
    return found.select("doc_id", "part", "alt", "lang", F.array_join("headers", "|").alias("headers"), F.coalesce("col_span", F.lit(-1)).alias("col_span"), "scope")


def _marked_nodes(spark, d):
    """The object graph, with an error on orders of one status and a warning on customers of one segment."""
    mark = lambda key, value, name: F.when(F.col("props")[key] == value, F.array(F.lit(name)))
    return object_nodes(spark, d).select("node_id", "node_type", mark("Status", "F", "size").alias("errors"), mark("Segment", "BUILDING", "old").alias("warnings"))


@_register("SELECT 'errors' AS asked, concat('o', o_orderkey) AS node_id, 4 AS depth FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'warnings', concat('c', c_custkey), 3 FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'shallow', concat('n', n_nationkey), 2 FROM nation UNION ALL SELECT 'shallow', 'root', 0")
def queried_nodes(spark, d):
    nodes, edges, root = _marked_nodes(spark, d), object_edges(spark, d), spark.range(1).select(F.lit("root").alias("node_id"))
    asked = {
        "errors": {"types": ["Annotation"], "errors": True, "warnings": False},
        "warnings": {"warnings": True},
        "shallow": {"types": ["Root", "Pages", "Page"], "errors": False, "max_depth": 2},
    }
    out = None
    for name, how in asked.items():
        found = diagnosis.query_nodes(nodes, edges, root, **how).select(F.lit(name).alias("asked"), "node_id", "depth")
        out = found if out is None else out.unionByName(found)
    return out


@_register("""@all, r AS (SELECT n.doc_id, e.dst, count(*) AS n FROM edges e JOIN nodes n ON e.src = n.node_id WHERE e.edge_type = 'Reference' GROUP BY ALL),
 c AS (SELECT doc_id, sum(n)::BIGINT AS n_references, count(*) AS n_targets, max(n) AS most_references FROM r GROUP BY doc_id),
 f AS (SELECT doc_id, count(*) FILTER (node_type = 'Page') AS n_pages, max(CASE node_type WHEN 'Catalog' THEN 1 WHEN 'Pages' THEN 2 WHEN 'Page' THEN 3 WHEN 'Annotation' THEN 4 WHEN 'ContentOperator' THEN 5 ELSE 0 END)::BIGINT AS max_depth FROM nodes WHERE doc_id IS NOT NULL GROUP BY doc_id)
 SELECT doc_id, n_pages, coalesce(n_references, 0) AS n_references, coalesce(n_targets, 0) AS n_targets, coalesce(most_references, 0) AS most_references, max_depth FROM f LEFT JOIN c USING (doc_id)""")
def security_statistics(spark, d):
    return diagnosis.security_statistics(object_nodes(spark, d), object_edges(spark, d), _from_root(spark, d).select("node_id", "depth"))


@_register("""@all, f AS (SELECT doc_id, count(*) AS n_nodes, max(CASE node_type WHEN 'Catalog' THEN 1 WHEN 'Pages' THEN 2 WHEN 'Page' THEN 3 WHEN 'Annotation' THEN 4 WHEN 'ContentOperator' THEN 5 ELSE 0 END) AS max_depth, bool_or(node_type = 'Catalog') AS has_root FROM nodes WHERE doc_id IS NOT NULL GROUP BY doc_id)
 SELECT doc_id, n_nodes, max_depth, has_root, CASE WHEN n_nodes > 10000 THEN 'many nodes' ELSE '' END AS warnings FROM f""")
def structure_analysis(spark, d):
    found = diagnosis.structure_analysis(object_nodes(spark, d), _from_root(spark, d).select("node_id", "depth"))
    return found.withColumn("warnings", F.array_join("warnings", ", "))


_KINDS = {"1-URGENT": "JavaScriptAction", "2-HIGH": "LaunchAction", "3-MEDIUM": "URIAction", "4-NOT SPECIFIED": "EmbeddedFile"}


def _acting(spark, d):
    """Orders as nodes of their customers' documents, typed by priority."""
    address = F.when(F.col("o_orderstatus") == "F", "http://x.org").otherwise("https://x.org")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("node_id"), _pick("o_orderpriority", _KINDS, "Font").alias("node_type"), F.create_map(F.lit("URI"), address).alias("props"))


@_register("""SELECT o_custkey AS doc_id, o_orderkey AS node_id, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'info' ELSE 'warning' END AS level, CASE o_orderpriority WHEN '1-URGENT' THEN 'JavaScript' WHEN '2-HIGH' THEN 'Launch action' WHEN '3-MEDIUM' THEN 'Insecure address' ELSE 'Embedded file' END AS message
 FROM orders WHERE o_orderpriority <> '5-LOW' AND (o_orderpriority <> '3-MEDIUM' OR o_orderstatus = 'F')""")
def node_warnings(spark, d):
    return diagnosis.node_warnings(_acting(spark, d))


@_register("SELECT o_custkey AS doc_id, o_orderkey AS node_id, CASE WHEN k = 1 THEN 'K' ELSE 'Fo' END AS event, concat('app.alert(', o_orderkey, ')') AS script FROM orders, (VALUES (1), (2)) AS t(k) WHERE o_orderstatus <> 'F' AND (k = 1 OR o_orderpriority = '1-URGENT')")
def widget_scripts(spark, d):
    """Orders as annotations: one status is no widget, one priority has a second script, the others an action of another kind."""
    act = lambda kind: F.struct(kind.alias("S"), F.concat(F.lit("(app.alert("), F.col("o_orderkey").cast("string"), F.lit(")")).alias("JS"))
    second = F.when(F.col("o_orderpriority") == "1-URGENT", "/JavaScript").otherwise("/Named")
    value = F.to_json(F.struct(F.when(F.col("o_orderstatus") == "F", "/Link").otherwise("/Widget").alias("Subtype"), F.struct(act(F.lit("/JavaScript")).alias("K"), act(second).alias("Fo")).alias("AA")))
    return diagnosis.widget_scripts(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("node_id"), value.alias("value")))


@_register("""WITH v AS (SELECT c_custkey AS doc_id, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) + count(*) FILTER (o_orderpriority = '5-LOW' AND o_orderstatus <> 'F') AS archive,
 CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS accessible FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, c_mktsegment)
 SELECT doc_id, profile, n::BIGINT AS n_violations, CASE WHEN n > 0 THEN 'NonCompliant' ELSE 'Compliant' END AS status FROM (SELECT doc_id, 'archive' AS profile, archive AS n FROM v UNION ALL SELECT doc_id, 'accessible', accessible FROM v)""")
def compliance_reports(spark, d):
    """Customers as documents: a Catalog each, and their orders as actions, files and fonts."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_nationkey", "c_mktsegment")
    some = lambda cond, value: F.when(cond, value)
    catalog = F.to_json(F.struct(some(F.col("c_nationkey") % 2 == 0, "/Tree").alias("StructTreeRoot"), some(F.col("c_mktsegment") == "BUILDING", "(en").alias("Lang")))
    orders = table(spark, d, "orders")
    rest = orders.select(F.col("o_custkey").alias("doc_id"), _pick("o_orderpriority", _KINDS, "Font").alias("node_type"), F.to_json(F.struct(some(F.col("o_orderstatus") == "F", "/File").alias("FontFile2"))).alias("value"))
    nodes = customers.select("doc_id", F.lit("Catalog").alias("node_type"), catalog.alias("value")).unionByName(rest)
    return diagnosis.compliance(nodes, customers)


@_register("SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN 1.2 ELSE 1.0 END::DOUBLE AS version, p_partkey + 9000 AS length, p_size::BIGINT AS hint_offset, CASE WHEN p_size % 2 = 0 THEN 77 ELSE -1 END::BIGINT AS hint_length, 12::BIGINT AS objects FROM part WHERE p_size % 4 <> 3 AND p_size % 5 <> 0")
def linearized_files(spark, d):
    """Parts as the heads of files: one in four is not linearized, one in five has no main table."""
    c = F.col
    first = F.when(c("p_size") % 4 == 3, "/Type /Catalog").otherwise(F.concat(F.lit("/Linearized "), F.when(c("p_size") % 4 == 1, "1.2").otherwise("1")))
    hint = F.concat(F.lit(" /H [ "), c("p_size").cast("string"), F.when(c("p_size") % 2 == 0, " 77 ]").otherwise(" ]"))
    main = F.when(c("p_size") % 5 == 0, "").otherwise(" /T 8800")
    head = F.concat(F.lit("%PDF-1.7\n1 0 obj\n<< "), first, F.lit(" /L "), (c("p_partkey") + 9000).cast("string"), hint, F.lit(" /O 5 /E 700 /N 12"), main, F.lit(" >>\nendobj\n"))
    found = table(spark, d, "part").select("p_partkey", diagnosis.linearization(F.encode(head, "UTF-8")).alias("l")).where("l is not null")
    return found.select("p_partkey", "l.version", "l.length", "l.hint_offset", F.coalesce("l.hint_length", F.lit(-1)).alias("hint_length"), "l.objects")


_KEYS = "[" + ", ".join(f"'{k}'" for k in diagnosis.KEYWORDS) + "]"
_END = r"concat(CASE WHEN contains(a, 'trailer') THEN a ELSE concat(a, 'trailer', chr(10), '<<', chr(10), '/Size 2', chr(10), '/Root 1 0 R', chr(10), '>>', chr(10), 'startxref', chr(10), '0', chr(10)) END"


@_register(rf"""WITH t AS (SELECT doc_id, concat(CASE doc_id % 3 WHEN 0 THEN 'junk %PDF-1.7 ' WHEN 1 THEN '%PDF-1.7 ' ELSE '' END, text, ' 12 0R ', chr(1), ' obje [ ( stram stream Q q endstream Fomt', CASE WHEN doc_id % 2 = 0 THEN ' trailer %%EOF' ELSE '' END) AS text FROM documents WHERE text IS NOT NULL),
 h AS (SELECT doc_id, text, CASE WHEN strpos(text, '%PDF-') = 0 THEN concat('%PDF-1.4', chr(10), text) ELSE substr(text, strpos(text, '%PDF-')) END AS a FROM t),
 b AS (SELECT doc_id, text, {_END}, CASE WHEN contains(a, 'trailer') AND (ends_with(a, '%%EOF') OR ends_with(a, concat('%%EOF', chr(10)))) THEN '' ELSE concat(chr(10), '%%EOF') END) AS b FROM h),
 r AS (SELECT *, regexp_replace(b, '\b(\d+)\s+(\d+)R\b', '\1 \2 R', 'g') AS r FROM b), x AS (SELECT *, regexp_replace(r, '(?s)\bstream(?:\r?\n)?(.*?)\n?endstream', concat('stream', chr(10), '\1', chr(10), 'endstream'), 'g') AS x FROM r), e AS (SELECT *, regexp_replace(x, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g') AS e FROM x),
 w AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(e, '\bobje\b', 'obj', 'g'), '\bendobje\b', 'endobj', 'g'), '\bstram\b', 'stream', 'g'), '\bendstram\b', 'endstream', 'g') AS w FROM e),
 m AS (SELECT *, greatest(0, length(regexp_replace(w, '[^\[(<]', '', 'g')) - length(regexp_replace(w, '[^\])>]', '', 'g'))) AS n FROM w), v AS (SELECT *, concat(w, repeat(']', n)) AS v FROM m),
 z AS (SELECT *, array_to_string(list_transform(regexp_extract_all(v, '[ \t\n\r]+|[^ \t\n\r]+'), lambda t: CASE WHEN length(t) > 10 OR list_contains({_KEYS}, t) THEN t ELSE coalesce(list_filter({_KEYS}, lambda k: levenshtein(t, k) = 1)[1], t) END), '') AS z FROM v)
 SELECT doc_id, md5(z) AS digest, concat_ws(',', CASE WHEN b <> text THEN 'BasicStructure' END, CASE WHEN r <> b THEN 'Reference' END, CASE WHEN x <> r THEN 'Stream' END, CASE WHEN e <> x THEN 'Encoding' END, CASE WHEN w <> e OR n > 0 THEN 'Heuristic' END, CASE WHEN z <> v THEN 'FuzzyMatching' END) AS actions FROM z""")
def repaired_files(spark, d):
    """Every text as a damaged file: what is wrong follows from the id."""
    c = F.col("doc_id")
    head = F.when(c % 3 == 0, "junk %PDF-1.7 ").when(c % 3 == 1, "%PDF-1.7 ").otherwise("")
    tail = F.concat(F.lit(" 12 0R \x01 obje [ ( stram stream Q q endstream Fomt"), F.when(c % 2 == 0, " trailer %%EOF").otherwise(""))
    files = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(head, "text", tail).alias("text"))
    return diagnosis.repaired(files).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.array_join("actions", ",").alias("actions"))


@_register("SELECT event_type AS stage, count(*) AS n_items, count(*) FILTER (value < 1) AS n_errors, sum(user_id % 7)::BIGINT AS ms, round(CASE WHEN sum(user_id % 7) > 0 THEN count(*) / (sum(user_id % 7) / 1000) ELSE 0 END, 6) AS rate FROM events GROUP BY 1")
def stage_statistics(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 7).alias("ms"), (F.col("value") < 1).alias("failed"))
    return diagnosis.stage_statistics(events).withColumn("rate", F.round("rate", 6))


@_register("SELECT o_custkey, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS share FROM orders GROUP BY 1")
def completion(spark, d):
    return diagnosis.completion(table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("done")), "o_custkey").withColumn("share", F.round("share", 6))


@_register("SELECT p_partkey AS doc_id, text FROM (SELECT p_partkey, unnest(['Type', 'Part', 'Kids', 'Info', 'Title', concat('a \"', p_name, '\"'), p_brand, p_type, 'Next']) AS text FROM part)")
def textual_values(spark, d):
    """Parts as dictionaries with names, strings with quotes, an array and a reference."""
    info = F.struct(F.concat(F.lit('(a "'), "p_name", F.lit('"')).alias("Title"))
    value = F.to_json(F.struct(F.lit("/Part").alias("Type"), F.array(F.concat(F.lit("("), "p_brand"), F.concat(F.lit("/"), "p_type")).alias("Kids"), info.alias("Info"), F.struct(F.lit("7 0").alias("R")).alias("Next")))
    made = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("v").alias("node_id"), value.alias("value"))
    return diagnosis.textual_values(made).select("doc_id", "text")


@_register("WITH r AS (SELECT o_custkey AS doc_id, year(o_orderdate)::INT AS rev, count(*) AS n_changes FROM orders GROUP BY ALL) SELECT doc_id, rev, coalesce(lag(rev) OVER w, 0)::INT AS previous, n_changes, coalesce(n_changes - lag(n_changes) OVER w, 0) AS grown FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY rev)")
def revision_timeline(spark, d):
    """Customers as documents, a year's orders as a revision's changes."""
    found = diagnosis.timeline(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.year("o_orderdate").alias("rev")))
    return found.withColumn("previous", F.coalesce("previous", F.lit(0))).withColumn("grown", F.coalesce("grown", F.lit(0)))


@_register("SELECT event_id, 0.5::DOUBLE AS low, -1.0::DOUBLE AS lower FROM events")
def calculator_values(spark, d):
    y = diagnosis.minima([(0.5, 2.0), (-1.0, 1.0)])
    return table(spark, d, "events").select("event_id", F.get(y, 0).alias("low"), F.get(y, 1).alias("lower"))


@_register("""@all, gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)),
 n AS (SELECT 'Page' AS node_type FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN 'Archived' ELSE 'Annotation' END FROM o UNION ALL SELECT 'Note' FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'ContentOperator' FROM lines WHERE l_orderkey IN (SELECT o_orderkey FROM o))
 SELECT node_type, count(*) AS n FROM n GROUP BY 1""")
def batch_of_changes(spark, d):
    """Orders of one status replaced, customers of one segment removed with all below them, a note inserted below every customer (those removed take none)."""
    nodes, edges = object_nodes(spark, d), object_edges(spark, d)
    new = nodes.where("props['Status'] = 'F'").select("node_id", F.lit("Archived").alias("node_type"), "props")
    gone = nodes.where("props['Segment'] = 'BUILDING'").select("node_id")
    notes = nodes.where("node_type = 'Page'").select(F.col("node_id").alias("parent"), "doc_id", F.concat(F.lit("note"), "node_id").alias("node_id"), F.lit("Note").alias("node_type"), "obj", "props")
    changed, _ = diagnosis.apply_batch(nodes, edges, [("replace", new), ("remove", gone), ("insert", notes)])
    return changed.where("node_type in ('Page', 'Annotation', 'Archived', 'Note', 'ContentOperator')").groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))
