"""Registered queries over names, outlines, optional content, fonts, metadata and security."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import findings, structure
from ..sources.bridge import table
from ..sources.shared import spread
from . import text_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return add


@_register("""WITH i AS (SELECT concat('r', r_regionkey) AS item, NULL AS parent, -r_regionkey AS ord FROM region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), -n_nationkey FROM nation UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), -c_custkey FROM customer),
 k AS (SELECT *, lpad(CAST(row_number() OVER (PARTITION BY parent ORDER BY ord, item) AS VARCHAR), 10, '0') AS at FROM i)
 SELECT i.item, CASE WHEN i.parent IS NULL THEN 0 WHEN i.item LIKE 'n%' THEN 1 ELSE 2 END AS level, concat_ws('/', p.parent, i.parent, i.item) AS path, concat_ws('/', g.at, p.at, i.at) AS place FROM k i LEFT JOIN k p ON i.parent = p.item LEFT JOIN k g ON p.parent = g.item""")
def outline_items(spark, d):
    ident = lambda p, c: F.concat(F.lit(p), F.col(c))

    def rows(name, own, parent):
        return table(spark, d, name).select(own[1].alias("item"), parent.alias("parent"), (-F.col(own[0])).cast("long").alias("ord"))

    items = rows("region", ("r_regionkey", ident("r", "r_regionkey")), F.lit(None).cast("string"))
    items = items.unionByName(rows("nation", ("n_nationkey", ident("n", "n_nationkey")), ident("r", "n_regionkey")))
    items = items.unionByName(rows("customer", ("c_custkey", ident("c", "c_custkey")), ident("n", "c_nationkey")))
    return structure.outline_items(items)


@_register("SELECT c_custkey, concat('F1=', n_name) AS f1, concat('F2=', CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE r_name END) AS f2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def inherited_resources(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    one = lambda k, v: F.create_map(F.lit(k), F.col(v))
    level = lambda n, m: customers.select(F.col("c_custkey").alias("node_id"), F.lit(n).alias("level"), m.alias("resources"))
    chain = level(0, F.create_map(F.lit("F1"), F.col("r_name"), F.lit("F2"), F.col("r_name"))).unionByName(level(1, one("F1", "n_name"))).unionByName(level(2, F.when(F.col("c_custkey") % 3 == 0, one("F2", "c_mktsegment")).otherwise(F.create_map().cast("map<string,string>"))))
    merged = structure.inherited(chain)
    return merged.select(F.col("node_id").alias("c_custkey"), F.concat(F.lit("F1="), F.col("resources")["F1"]).alias("f1"), F.concat(F.lit("F2="), F.col("resources")["F2"]).alias("f2"))


@_register("""WITH g AS (SELECT o_custkey AS doc_id, o_orderkey AS group_id, o_custkey % 2 = 0 AS base_on, o_orderstatus = 'F' AS listed_on, o_orderstatus = 'O' AS listed_off, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END AS radio FROM orders),
 s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, radio ORDER BY group_id) AS place FROM g WHERE (base_on AND NOT listed_off) OR listed_on) SELECT doc_id, group_id FROM s WHERE radio IS NULL OR place = 1""")
def visible_groups(spark, d):
    c = F.col
    groups = table(spark, d, "orders").select(c("o_custkey").alias("doc_id"), c("o_orderkey").alias("group_id"), (c("o_custkey") % 2 == 0).alias("base_on"), (c("o_orderstatus") == "F").alias("listed_on"), (c("o_orderstatus") == "O").alias("listed_off"), F.when(c("o_orderpriority") == "1-URGENT", 1).alias("radio"))
    return structure.visible_groups(groups)


@_register("WITH s AS (SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_on, bool_or(o_orderstatus = 'F') AS any_on FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE o_custkey % 4 WHEN 0 THEN all_on WHEN 1 THEN NOT all_on WHEN 2 THEN NOT any_on ELSE any_on END AS visible FROM s")
def membership_policies(spark, d):
    states = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderstatus") == "F").alias("states"))
    policy = F.element_at(F.array(*map(F.lit, ("AllOn", "AnyOff", "AllOff", "AnyOn"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    return states.select("o_custkey", structure.membership(policy, F.col("states")).alias("visible"))


@_register("SELECT o_orderkey, replace(replace(replace(o_orderpriority, 'O', '文'), 'L', 'fi'), 'W', 'Ωω') AS text FROM orders")
def cmap_decoded(spark, d):
    """Priorities coded as two-byte codes 256 above the character, decoded by a CMap of ranges, a list and single characters, some of them beyond Latin-1 or two characters."""
    cmap = spark.createDataFrame([(1, "2 beginbfrange\n<0121> <014b> <0021>\n<0158> <017e> <0058>\nendbfrange\n1 beginbfrange\n<014c> <014f> [<00660069> <004D> <004E>\n<6587>]\n<0150> <0156> <0050>\nendbfrange\n2 beginbfchar\n<0120> <0020>\n<0157> <03A903C9>\nendbfchar")], "cmap_id int, text string")
    codes = table(spark, d, "orders").select("o_orderkey", F.posexplode(F.transform(F.split("o_orderpriority", ""), lambda c: F.ascii(c) + 256)).alias("at", "code"), F.lit(1).alias("cmap_id"))
    chars = structure.decode_codes(codes.where("code > 256"), structure.cmap_ranges(cmap))
    return chars.groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "char"))), lambda x: x["char"]), "").alias("text"))


PACKET = '<x:xmpmeta><rdf:RDF><rdf:Description rdf:about="" pdf:Producer="%2$s"><dc:title>\n<rdf:Alt><rdf:li xml:lang="x-default">%1$s</rdf:li></rdf:Alt></dc:title><xmp:Label>%2$s</xmp:Label></rdf:Description></rdf:RDF></x:xmpmeta>'


def _packets(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.format_string(PACKET, "p_name", "p_brand").alias("packet"))


@_register("SELECT p_partkey AS doc_id, 'dc:title' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, unnest(['pdf:Producer', 'xmp:Label']), p_brand FROM part")
def xmp_properties(spark, d):
    return structure.xmp_properties(_packets(spark, d))


@_register("SELECT p_partkey AS doc_id, 'Title' AS label, p_name AS xmp, upper(p_name) AS info FROM part WHERE p_partkey % 3 = 0 AND upper(p_name) <> p_name")
def metadata_coherence(spark, d):
    info = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("Title").alias("label"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("value"))
    return structure.incoherent(structure.xmp_properties(_packets(spark, d)), info)


@_register("SELECT o_orderkey, md5(o_orderpriority) AS digest, true AS changed FROM orders")
def rc4_round_trip(spark, d):
    key = structure.file_key(b"secret", bytes(32), -44, b"id")
    orders = table(spark, d, "orders").withColumn("data", F.encode("o_orderpriority", "UTF-8"))
    coded = orders.withColumn("coded", structure.rc4_column(F.col("data"), F.col("o_orderkey"), key))
    back = structure.rc4_column(F.col("coded"), F.col("o_orderkey"), key)
    return coded.select("o_orderkey", F.md5(back).alias("digest"), (F.col("coded") != F.col("data")).alias("changed"))


@_register("SELECT o_orderkey, md5(o_orderpriority) AS digest FROM orders")
def aes_round_trip(spark, d):
    key, iv = F.lit(b"\x11" * 16), F.lit(b"\x22" * 16)
    coded = table(spark, d, "orders").select("o_orderkey", F.aes_encrypt(F.encode("o_orderpriority", "UTF-8"), key, F.lit("CBC"), F.lit("PKCS"), iv).alias("coded"))
    return coded.select("o_orderkey", F.md5(F.aes_decrypt("coded", key, F.lit("CBC"), F.lit("PKCS"))).alias("digest"))


@_register("SELECT doc_id, sha256(unhex(concat(substr(h, 1, 2 * (n // 3)), substr(h, 2 * (n // 3 + n // 5) + 1)))) AS digest FROM (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE text IS NOT NULL)")
def signature_digests(spark, d):
    """The digest over each text's bytes but a fifth of them, where its signature would lie."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    size = F.octet_length("content")
    gap, length = F.floor(size / 3), F.floor(size / 5)
    return docs.select("doc_id", structure.signed_digest(F.col("content"), F.array(F.lit(0), gap, gap + length, size - gap - length)).alias("digest"))


@_register(f"{text_queries.ALL} SELECT doc_id, CASE WHEN strlen(text) > 10000 THEN 'size' WHEN contains(lower(text), 'javascript:') THEN 'pattern javascript:' WHEN contains(lower(text), 'eval(') THEN 'pattern eval(' END AS violation, md5(replace(replace(text, 'javascript:', '[removed]'), 'eval(', '[removed]')) AS cleaned FROM texts")
def hardening(spark, d):
    text = F.col("text")
    cleaned = F.md5(F.encode(structure.sanitized(text), "UTF-8"))
    return text_queries._texts(spark, d).select("doc_id", structure.first_violation(text).alias("violation"), cleaned.alias("cleaned"))


@_register("SELECT l_suppkey AS element, string_agg(l_returnflag, ' ' ORDER BY l_orderkey, l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY l_suppkey")
def structure_texts(spark, d):
    lines = table(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    own = lines.withColumn("mcid", F.row_number().over(order))
    marks = own.select(F.col("l_suppkey").alias("element"), F.col("l_orderkey").alias("page"), "mcid")
    return structure.structure_texts(marks, own.select(F.col("l_orderkey").alias("page"), "mcid", F.col("l_returnflag").alias("text")))


@_register("WITH k AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS nearest), t AS (SELECT DISTINCT concat(substr(c_mktsegment, 1, 3), 'X', substr(c_mktsegment, 5)) AS name FROM customer), m AS (SELECT name, nearest, levenshtein(name, nearest) AS distance FROM t, k), b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, nearest) AS place FROM m) SELECT name, nearest, distance FROM b WHERE place = 1 AND distance <= 2")
def nearest_names(spark, d):
    names = table(spark, d, "customer").select(F.concat(F.substring("c_mktsegment", 1, 3), F.lit("X"), F.expr("substring(c_mktsegment, 5)")).alias("name")).distinct()
    return structure.nearest_names(names, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


def _times(marks):
    return " + ".join(f"(strlen(t) - strlen(replace(t, {text_queries._quote(m)}, ''))) / {len(m)}" for m in marks)


@_register(f"""WITH d AS (SELECT doc_id, text AS t, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
 k AS (SELECT *, CASE WHEN n > 0 AND (len(list_filter(generate_series(1, least(n, 1000) * 2 - 1, 2), lambda i: substr(h, i, 1) < '8')) / least(n, 1000) > 0.8 OR {" OR ".join(f"contains(t, '{m}')" for m in rules.TEXT_MARKS)}) THEN 'Text' WHEN {_times(rules.VECTOR_OPS)} > n // 100 THEN 'Vector' WHEN {_times(rules.STRUCTURE_MARKS)} > n // 50 THEN 'Structured' ELSE 'Binary' END AS kind FROM d)
 SELECT doc_id, kind, CASE kind WHEN 'Binary' THEN 'LZW' ELSE 'Flate' END AS algorithm FROM k""")
def content_kinds(spark, d):
    text = F.col("text")
    kind = rules.content_kind(text)
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", kind.alias("kind"))
    return docs.select("doc_id", "kind", rules.compression_choice(F.col("kind"), F.lit(False)).alias("algorithm"))


@_register("WITH d AS (SELECT doc_id, strlen(text) AS n, hex(encode(text))[1:2000] AS h FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, n, unnest(list_transform(generate_series(1, length(h) - 1, 2), lambda i: substr(h, i, 2))) AS b FROM d), c AS (SELECT doc_id, n, b, count(*) AS times FROM b GROUP BY ALL) SELECT d.doc_id, d.n >= 1000 AND coalesce(max(times), 0) > 100 AS repetitive FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id, d.n")
def repetitive_contents(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce(rules.is_repetitive(F.col("text")), F.lit(False)).alias("repetitive"))


@_register("SELECT p_type AS kind, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY p_type")
def media_statistics(spark, d):
    return findings.type_statistics(table(spark, d, "part").select(F.col("p_type").alias("kind"), F.col("p_size").alias("size")))


@_register("SELECT p_brand, arg_min(p_type, (-n, p_type)) AS predominant FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def predominant_types(spark, d):
    return findings.predominant(table(spark, d, "part").select("p_brand", F.col("p_type").alias("kind")), "p_brand")


@_register("SELECT c_custkey, CAST(2 + c_custkey % 3 AS INT) AS revision, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS is_user, c_custkey % 5 <> 0 AND c_custkey % 7 = 0 AS is_owner FROM customer")
def password_checks(spark, d):
    """Entries made for each customer's name and segment as passwords, then tried with the user's, the owner's (one in seven) or a wrong one (one in five)."""

    @F.pandas_udf("owner binary, user binary")
    def entries(name: pd.Series, segment: pd.Series, ident: pd.Series, revision: pd.Series) -> pd.DataFrame:
        names, revisions, ids = [n.encode() for n in name], [int(r) for r in revision], [bytes(i) for i in ident]
        owners = structure.owner_entries([s.encode() for s in segment], names, [16] * len(names), revisions)
        keys = [structure.file_key(n, o, -44, i, revision=r) for n, o, i, r in zip(names, owners, ids, revisions)]
        out = list(zip(owners, structure.user_entries(keys, ids, revisions)))
        return pd.DataFrame(out, columns=["owner", "user"])

    key = F.col("c_custkey")
    rows = spread(table(spark, d, "customer"), "c_custkey").select("c_custkey", "c_name", "c_mktsegment", (2 + key % 3).cast("int").alias("revision"), F.md5(key.cast("string")).cast("binary").alias("file_id"), F.lit(-44).alias("permissions"))
    rows = rows.withColumn("made", entries("c_name", "c_mktsegment", "file_id", "revision")).select("*", "made.*")
    tried = F.when(key % 5 == 0, "wrong").when(key % 7 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    return structure.checked_passwords(rows.withColumn("password", F.encode(tried, "UTF-8"))).select("c_custkey", "revision", "is_user", "is_owner")


@_register("SELECT l_returnflag AS algorithm, count(*) AS n, sum(l_quantity) AS original, sum(l_quantity * (1 - l_discount)) AS compressed, min((l_quantity * (1 - l_discount)) / l_quantity) AS best, max((l_quantity * (1 - l_discount)) / l_quantity) AS worst FROM lineitem GROUP BY l_returnflag".replace("sum(l_quantity * (1 - l_discount))", "round(sum(l_quantity * (1 - l_discount)), 2)"))
def compression_statistics(spark, d):
    sizes = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("algorithm"), F.col("l_quantity").alias("original"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("compressed"))
    return findings.compression_stats(sizes).withColumn("compressed", F.round("compressed", 2))


@_register("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS place FROM orders ORDER BY 2 LIMIT 50")
def task_queue(spark, d):
    """The first 50 tasks by priority, then by arrival: a top-k, not a sort of all."""
    top = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderpriority", "o_orderkey").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy("o_orderpriority", "o_orderkey")).cast("long")).select("o_orderkey", "place")


@_register("WITH f AS (SELECT c_nationkey AS n, count(*) AS c, count(*) FILTER (c_acctbal < 0) AS w FROM customer GROUP BY 1) SELECT a.n AS doc_a, b.n AS doc_b, round(greatest(0, least(1, 1 - abs(a.c - b.c) / (greatest(a.c, b.c) + 1 + 10.0))), 6) AS similarity FROM f a JOIN f b ON b.n = a.n + 1")
def document_similarity(spark, d):
    facts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    a, b = facts.select(F.col("n").alias("doc_a"), F.col("c").alias("ca"), (F.col("n") + 1).alias("doc_b")), facts.select(F.col("n").alias("doc_b"), F.col("c").alias("cb"))
    sim = findings.similarity(F.abs(F.col("ca") - F.col("cb")), F.greatest("ca", "cb"), F.lit(1))
    return a.join(b, "doc_b").select("doc_a", "doc_b", F.round(sim, 6).alias("similarity"))


@_register("WITH p AS (SELECT page_id, (NOT regexp_matches(html, '<html[^>]*\\slang='))::INT + (NOT contains(html, '<title>'))::INT AS errors, (NOT contains(html, '<h1'))::INT + (contains(html, '<ul>') AND NOT contains(html, '<li'))::INT + (contains(html, '<br>'))::INT AS warnings FROM pages WHERE html IS NOT NULL) SELECT page_id, CAST(errors AS BIGINT) AS errors, CAST(warnings AS BIGINT) AS warnings, round(greatest(0, 1 - (errors * 0.5 + warnings * 0.2) / 10), 6) AS score, CASE WHEN errors = 0 AND warnings = 0 THEN 'AAA' WHEN errors = 0 AND warnings <= 5 THEN 'AA' WHEN errors <= 2 THEN 'A' ELSE 'NonCompliant' END AS level FROM p")
def accessibility_summary(spark, d):
    """Compliance of pages: no language or title is an error; no heading, an empty list and breaks for layout are warnings."""
    html = F.col("html")
    flag = lambda c: c.cast("long")
    found = table(spark, d, "pages").where("html is not null").select("page_id", (flag(~html.rlike(r"<html[^>]*\slang=")) + flag(~html.contains("<title>"))).alias("errors"), (flag(~html.contains("<h1")) + flag(html.contains("<ul>") & ~html.contains("<li")) + flag(html.contains("<br>"))).alias("warnings"))
    e, w = F.col("errors"), F.col("warnings")
    return found.select("page_id", "errors", "warnings", F.round(rules.compliance_score(e, w), 6).alias("score"), rules.compliance_level(e, w).alias("level"))


@_register("SELECT conv_id, count(*) AS n_turns, list_sort(list(DISTINCT role)) [1] AS first_role, count(DISTINCT role) AS n_roles FROM conversations GROUP BY conv_id")
def unique_names(spark, d):
    by = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.array_distinct(F.collect_list("role"))).alias("roles"))
    return by.select("conv_id", "n_turns", F.col("roles")[0].alias("first_role"), F.size("roles").cast("long").alias("n_roles"))


@_register("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'High' ELSE 'Low' END AS severity, CASE WHEN s_acctbal < 0 THEN 50 ELSE 5 END AS score FROM supplier")
def severity_scores(spark, d):
    severity = F.when(F.col("s_acctbal") < 0, "High").otherwise("Low")
    return table(spark, d, "supplier").select("s_suppkey", severity.alias("severity"), rules.severity_score(severity).alias("score"))
