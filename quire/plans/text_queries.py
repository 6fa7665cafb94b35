"""Registered queries over document texts, each with its SQL on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import findings
from ..sources.bridge import INJECTED, document_texts, table, text_chunks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TEXTS = "texts AS (SELECT doc_id, concat(text, CASE doc_id % 11 " + " ".join(f"WHEN {k} THEN {_quote(t)}" for k, t in enumerate(INJECTED)) + " ELSE '' END) AS text FROM documents WHERE text IS NOT NULL)"
URLS = r"urls AS (SELECT doc_id, unnest(regexp_extract_all(text, '((?:https?|ftp|file)://[^\s'')]+)', 1)) AS url FROM texts)"
ALL = f"WITH {TEXTS}, {URLS}"


def _any(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quote(p)})" for p in parts) + ")"


def _register(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql.replace("@all", ALL)
        return fn

    return add


def _texts(spark, d):
    return document_texts(spark, d).where("text is not null")


JS, BAD = _any("lower(text)", rules.JAVASCRIPT), _any("lower(text)", rules.SUSPICIOUS)
IP = r"regexp_matches(lower(url), 'https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')"
URL_BAD = f"({IP} OR {_any('lower(url)', rules.BAD_TLDS + rules.SHORTENERS + rules.BAD_PATHS)})"
QUERY = "coalesce(string_split(url, '?')[2], '')"
URL_LEAK = f"({_any('lower(url)', rules.LEAKS)} OR (contains(url, '=') AND strlen(url) > 100 AND strlen({QUERY}) > 50 AND regexp_full_match({QUERY}, '[A-Za-z0-9=&]+')))"
URL_THREAT = f"(regexp_matches(lower(url), '^(ftp://|file://|javascript:|data:)') OR {_any('lower(url)', rules.SHORTENERS + rules.LOCAL)} OR len(regexp_extract_all(url, '\\.')) > 6)"
SPRAY = "(contains(text, 'new Array(') AND (contains(text, '0x') OR regexp_matches(text, '[0-9]{4,}')) AND (contains(text, 'for(') OR contains(text, 'while(')) AND (contains(text, 'new Array')::INT + contains(text, '.length')::INT + contains(text, 'for(')::INT + contains(text, 'String(')::INT) >= 3)"
SHELL = r"(len(regexp_extract_all(text, '\\x[0-9a-fA-F]{2}')) > 50 AND (regexp_matches(text, '\\u[0-9a-fA-F]{4}')::INT + contains(text, 'String.fromCharCode')::INT + contains(text, 'unescape(')::INT + contains(text, 'eval(')::INT) >= 1)"
FEATURES = r"((length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) > strlen(text) * 0.4)::INT + contains(text, 'var ')::INT + regexp_matches(text, '[a-zA-Z_$][a-zA-Z0-9_$]{20,}')::INT + ((length(text) - length(replace(text, '\x', ''))) / 2 > 10)::INT + ((length(text) - length(replace(text, '\u', ''))) / 2 > 5)::INT + (len(regexp_extract_all(text, ' \+ ')) > 20)::INT + (contains(text, 'eval(') AND (contains(text, 'unescape(') OR contains(text, 'fromCharCode')))::INT)"
DOUBLE = f"regexp_matches(lower(name), '\\.({'|'.join(rules.DOCUMENT_SUFFIXES)})\\.({'|'.join(rules.PROGRAM_SUFFIXES)})$')"
PROGRAM = f"regexp_matches(lower(name), '\\.({'|'.join(rules.EXECUTABLES)})$')"
NAMES = r"names AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \t\n\v\f\r]+')) AS name FROM texts))"
FOUND = f"""{NAMES}, once AS (SELECT DISTINCT doc_id, url FROM urls), found AS (SELECT doc_id, 'javascript' AS rule, CASE WHEN {_any('lower(text)', rules.SUSPICIOUS_SCRIPT)} THEN 'High' ELSE 'Medium' END AS severity, '' AS subject FROM texts WHERE {JS}
 UNION ALL SELECT doc_id, 'obfuscated javascript', 'High', '' FROM texts WHERE {JS} AND {FEATURES} >= 3
 UNION ALL SELECT doc_id, 'suspicious pattern', 'Medium', '' FROM texts WHERE {BAD}
 UNION ALL SELECT doc_id, 'heap spray', 'Critical', '' FROM texts WHERE {SPRAY}
 UNION ALL SELECT doc_id, 'shellcode', 'Critical', '' FROM texts WHERE {SHELL}
 UNION ALL SELECT doc_id, 'hidden executable', 'Critical', '' FROM texts WHERE contains(lower(text), ' .exe') OR contains(text, chr(8238))
 UNION ALL SELECT doc_id, 'outbound connection', CASE WHEN {URL_THREAT} THEN 'High' ELSE 'Medium' END, url FROM once
 UNION ALL SELECT doc_id, 'suspicious url', 'High', url FROM once WHERE {URL_BAD}
 UNION ALL SELECT doc_id, 'exfiltration url', 'High', url FROM once WHERE {URL_LEAK}
 UNION ALL SELECT doc_id, 'double extension', 'High', name FROM names WHERE {DOUBLE}
 UNION ALL SELECT doc_id, 'executable name', 'Critical', name FROM names WHERE {PROGRAM}),
 facts AS (SELECT doc_id, count(*) FILTER (severity IN ('High', 'Critical')) > 2 AS many, bool_or(rule = 'javascript') AS js, bool_or(rule = 'outbound connection') AS net, bool_or(rule IN ('hidden executable', 'executable name')) AS prog FROM found GROUP BY doc_id),
 combined AS (SELECT doc_id, 'several grave findings' AS rule, 'Critical' AS severity FROM facts WHERE many UNION ALL SELECT doc_id, 'script with network access', 'High' FROM facts WHERE js AND net UNION ALL SELECT doc_id, 'program with script', 'Critical' FROM facts WHERE prog AND js),
 every_threat AS (SELECT doc_id, rule, severity FROM found UNION ALL SELECT * FROM combined)"""


@_register(f"@all SELECT doc_id, {JS} AS is_javascript, {BAD} AS is_suspicious FROM texts")
def script_indicators(spark, d):
    return _texts(spark, d).select("doc_id", rules.is_javascript(F.col("text")).alias("is_javascript"), rules.is_suspicious(F.col("text")).alias("is_suspicious"))


@_register("@all SELECT doc_id, url, CASE WHEN regexp_matches(url, '^(http://|ftp://|file://)') THEN 'Fail' ELSE 'Warning' END AS status FROM urls")
def uri_status(spark, d):
    return findings.urls(_texts(spark, d)).select("doc_id", "url", rules.uri_status(F.col("url")).alias("status"))


@_register(f"@all SELECT doc_id, url, {URL_BAD} AS suspicious, {URL_LEAK} AS exfiltration, {URL_THREAT} AS threat FROM urls")
def url_rules(spark, d):
    u = F.col("url")
    return findings.urls(_texts(spark, d)).select("doc_id", "url", rules.is_suspicious_url(u).alias("suspicious"), rules.is_exfiltration_url(u).alias("exfiltration"), rules.is_threat_url(u).alias("threat"))


@_register(f"@all, {NAMES} SELECT doc_id, count(*) AS n_names, count(*) FILTER ({DOUBLE}) AS double_extension, count(*) FILTER ({PROGRAM}) AS executable FROM names GROUP BY doc_id")
def file_name_rules(spark, d):
    names = _texts(spark, d).select("doc_id", F.explode(F.split("text", r"\s+")).alias("name")).distinct()
    name = F.col("name")
    return names.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_names"), F.count_if(rules.has_double_extension(name)).alias("double_extension"), F.count_if(rules.is_executable_name(name)).alias("executable"))


@_register(f"@all SELECT doc_id, {SPRAY} AS heap_spray FROM texts")
def heap_spray(spark, d):
    return _texts(spark, d).select("doc_id", rules.is_heap_spray(F.col("text")).alias("heap_spray"))


@_register(f"@all SELECT doc_id, {FEATURES} AS n_features FROM texts")
def script_obfuscation(spark, d):
    return _texts(spark, d).select("doc_id", rules.js_features(F.col("text")).alias("n_features"))


@_register(f"@all, {FOUND} SELECT * FROM found")
def threat_findings(spark, d):
    return findings.threats(_texts(spark, d))


@_register(f"@all, {FOUND}, s AS (SELECT doc_id, CAST(least(sum(CASE severity WHEN 'Critical' THEN 100 WHEN 'High' THEN 50 WHEN 'Medium' THEN 20 ELSE 5 END), 1000) AS BIGINT) AS score, bool_or(severity IN ('High', 'Critical')) AS grave FROM every_threat GROUP BY doc_id) SELECT doc_id, score, CASE WHEN score <= 20 THEN 'LOW' WHEN score <= 100 THEN 'MEDIUM' WHEN score <= 200 THEN 'HIGH' ELSE 'CRITICAL' END AS level, score <= 20 AND NOT grave AS safe FROM s")
def risk_scores(spark, d):
    return findings.risk(findings.all_threats(_texts(spark, d)))


@_register(f"@all, {FOUND} SELECT * FROM combined")
def combination_rules(spark, d):
    return findings.combinations(findings.threats(_texts(spark, d)))


MALWARE = ["heap spray", "shellcode", "several grave findings", "script with network access", "program with script"]


@_register(f"@all, {FOUND} SELECT doc_id, rule, severity FROM every_threat WHERE rule IN ({', '.join(map(_quote, MALWARE))})")
def malware_findings(spark, d):
    """Malware and exploits: what scripts do to memory, and the combinations."""
    return findings.all_threats(_texts(spark, d)).where(F.col("rule").isin(*MALWARE))


@_register(f"@all, {FOUND} SELECT doc_id, subject AS url, severity FROM found WHERE rule = 'exfiltration url'")
def privacy_findings(spark, d):
    return findings.threats(_texts(spark, d)).where("rule = 'exfiltration url'").select("doc_id", F.col("subject").alias("url"), "severity")


@_register(f"@all, {FOUND} SELECT t.doc_id, coalesce(NOT bool_or(f.severity IN ('High', 'Critical')), true) AS passes FROM texts t LEFT JOIN every_threat f ON t.doc_id = f.doc_id GROUP BY t.doc_id")
def quick_security_check(spark, d):
    """Whether no threat is grave; a combination needs a grave finding or adds one, so both count."""
    texts = _texts(spark, d)
    grave = findings.all_threats(texts).where(F.col("severity").isin("High", "Critical")).select("doc_id", F.lit(True).alias("grave")).distinct()
    return texts.select("doc_id").join(grave, "doc_id", "left").select("doc_id", F.col("grave").isNull().alias("passes"))


@_register("@all, c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM texts) WHERE ch <> '' GROUP BY ALL) SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY doc_id")
def text_entropy(spark, d):
    return findings.entropy(_texts(spark, d)).select("doc_id", F.round("entropy", 6).alias("entropy"))


@_register(r"@all SELECT doc_id, CAST(CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS BIGINT) AS n_words, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM texts")
def extraction_totals(spark, d):
    return findings.extraction_totals(_texts(spark, d))


@_register(r"@all, w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: strlen(w) >= 3)[1:100] AS ws FROM texts) SELECT doc_id, CAST(unnest(generate_series(0, len(ws) - 1)) AS BIGINT) AS place, unnest(ws) AS keyword FROM w")
def keyword_index(spark, d):
    return findings.keywords(_texts(spark, d)).withColumn("place", F.col("place").cast("long"))


@_register("@all, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line FROM texts) SELECT doc_id, CAST(line AS BIGINT) AS line, text FROM l WHERE contains(lower(text), 'the anea')")
def text_search(spark, d):
    return findings.search(_texts(spark, d), "the anea").withColumn("line", F.col("line").cast("long"))


@_register("@all, c AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, length(text) - 1), 896)) AS o FROM texts) SELECT doc_id, o // 896 AS seq, CAST(o AS BIGINT) AS off, substr(text, CAST(o + 1 AS BIGINT), 1024) AS data FROM c")
def chunk_overlap(spark, d):
    return text_chunks(_texts(spark, d)).select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("offset").alias("off"), "data")


@_register("@all, c AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, length(text) - 1), 896)) AS o FROM texts), h AS (SELECT doc_id, o // 896 AS seq, hex(encode(substr(text, CAST(o + 1 AS BIGINT), 1024))) AS h FROM c) SELECT doc_id, seq, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(generate_series(1, length(h) - 1, 2), lambda i: CAST(concat('0x', substr(h, i, 2)) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296) AS BIGINT) AS sum FROM h")
def chunk_checksum(spark, d):
    return text_chunks(_texts(spark, d)).select("doc_id", F.col("seq").cast("long").alias("seq"), rules.checksum(F.col("data")).alias("sum"))


@_register("@all SELECT doc_id, CASE WHEN strlen(text) > 200 THEN concat(substr(text, 1, 197), '...') ELSE text END AS evidence FROM texts")
def evidence(spark, d):
    return _texts(spark, d).select("doc_id", rules.truncate_evidence(F.col("text")).alias("evidence"))


@_register("SELECT lang, regexp_matches(lang, '^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$') AS ok, count(*) AS n FROM documents GROUP BY lang")
def language_codes(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", rules.is_language_code(F.col("lang")).alias("ok"), "n")


@_register("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders")
def document_dates(spark, d):
    text = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+00'00'"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(rules.pdf_date(text), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@_register("SELECT p_partkey, CAST(1 + p_size % 2 AS INT) AS major, CAST(p_size % 8 AS INT) AS minor FROM part")
def versions(spark, d):
    text = F.concat_ws(".", (1 + F.col("p_size") % 2).cast("string"), (F.col("p_size") % 8).cast("string"))
    v = rules.parse_version(text)
    return table(spark, d, "part").select("p_partkey", v["major"].alias("major"), v["minor"].alias("minor"))


@_register("SELECT s_suppkey, (s_suppkey & 4) <> 0 AS print, (s_suppkey & 8) <> 0 AS modify, (s_suppkey & 16) <> 0 AS copy, (s_suppkey & 32) <> 0 AS annotate FROM supplier")
def permission_flags(spark, d):
    p = rules.permission_flags(F.col("s_suppkey").cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", *(p[c].alias(c) for c in ("print", "modify", "copy", "annotate")))


@_register("SELECT l_orderkey, l_linenumber, round(0.2 + pow(l_discount * 5, 2) * 0.6, 6) AS y2, round(CASE WHEN x < 0.5 THEN 0.0 + (x / 0.5) * 1.0 ELSE 1.0 + pow((x - 0.5) / 0.5, 2) * -0.5 END, 6) AS y3 FROM (SELECT *, l_discount * 10 AS x FROM lineitem)")
def function_values(spark, d):
    x = F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(rules.exponential(x * 5, 0.2, 0.8, 2), 6).alias("y2"), F.round(rules.stitched(x * 10, [0.5], [(0.0, 1.0, 1), (1.0, 0.5, 2)]), 6).alias("y3"))


@_register("SELECT event_id, round(value * 2 + 10, 6) AS x, round(value * 0.5 + event_id % 100 * 3 - 4, 6) AS y FROM events")
def transformed_points(spark, d):
    x, y = rules.transform_point(F.col("value"), F.col("event_id") % 100, [2.0, 0.5, 0.0, 3.0, 10.0, -4.0])
    return table(spark, d, "events").select("event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@_register("")
def line_diff(spark, d):
    """What every turn of a conversation changes in the lines of the turn before; an edit script is beyond SQL, tests compare it with brute force."""
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.lag("text").over(own).alias("old"), F.col("text").alias("new"), F.row_number().over(own).alias("at"))
    return findings.line_diff(turns.where("at > 1").drop("at"))


@_register("""WITH r AS (SELECT DISTINCT user_id AS doc_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) % 5 AS rev, event_type AS obj, 0 AS mark FROM events),
 s AS (SELECT *, lag(rev) OVER w AS b, lead(rev) OVER w AS f FROM r WINDOW w AS (PARTITION BY doc_id, obj ORDER BY rev)), m AS (SELECT doc_id, max(rev) AS last FROM r GROUP BY doc_id)
 SELECT doc_id, rev, obj, 'added' AS change FROM s WHERE b IS NULL OR b < rev - 1 UNION ALL SELECT s.doc_id, rev + 1, obj, 'deleted' FROM s JOIN m USING (doc_id) WHERE rev < last AND (f IS NULL OR f > rev + 1)""")
def revision_delta(spark, d):
    events = table(spark, d, "events")
    revs = events.select(F.col("user_id").alias("doc_id"), (F.floor(F.unix_timestamp("ts") / 86400) % 5).alias("rev"), F.col("event_type").alias("obj"), F.lit(0).alias("mark")).distinct()
    return findings.revision_delta(revs)


@_register("""WITH p AS (SELECT l_orderkey, l_linenumber FROM lineitem), a AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page FROM p WHERE l_orderkey % 2 = 0), b AS (SELECT DISTINCT l_orderkey - 1 AS doc_id, l_linenumber AS page FROM p WHERE l_orderkey % 2 = 1 AND l_orderkey > 1)
 SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page, b.page) AS page, CASE WHEN a.page IS NULL THEN 'Added' WHEN b.page IS NULL THEN 'Removed' ELSE 'Same' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.page = b.page""")
def page_compare(spark, d):
    lines = table(spark, d, "lineitem")
    pages = lambda df, key: df.select(key.alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(0).alias("mark"))
    return findings.compare_pages(pages(lines.where("l_orderkey % 2 = 0"), F.col("l_orderkey")), pages(lines.where("l_orderkey % 2 = 1 and l_orderkey > 1"), F.col("l_orderkey") - 1))


@_register("SELECT event_type AS op, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY event_type")
def performance_breakdown(spark, d):
    out = findings.performance_breakdown(table(spark, d, "events").select(F.col("event_type").alias("op"), "value"))
    return out.select("op", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "least", "most", F.round("share", 6).alias("share"))


@_register("""WITH s AS (SELECT l_orderkey AS page, l_linenumber, l_quantity AS x, l_partkey % 40 AS y, l_suppkey AS t FROM lineitem), k AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) <= 3 AND x - (lag(x) OVER w + 5) < 6 THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY page ORDER BY y, x)),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY y, x) AS line FROM k) SELECT page, CAST(line AS BIGINT) AS line, count(*) AS n FROM n GROUP BY ALL""")
def merged_lines(spark, d):
    lines = table(spark, d, "lineitem")
    spans = lines.select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 40).alias("y"), F.lit(10.0).alias("height"), F.lit(2.0).alias("space"), F.lit(5.0).alias("width"), F.lit("w").alias("text"))
    merged = findings.merge_lines(spans)
    return merged.select("page", F.col("line").cast("long").alias("line"), F.size(F.split("text", " ")).cast("long").alias("n"))


@_register("SELECT event_id, CAST(props::JSON ->> 'k' AS BIGINT) AS k FROM events")
def property_values(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_register("SELECT event_type, count(*) AS n, avg(CASE WHEN value < 10 THEN 1.0 ELSE 0.0 END) AS success_rate FROM events GROUP BY event_type")
def chunk_success_rate(spark, d):
    return findings.success_rates(table(spark, d, "events").select("event_type", (F.col("value") >= 10).cast("int").alias("n_errors")), "event_type")


@_register("SELECT CAST(n_chars AS BIGINT) AS n_chars, level, n FROM (SELECT n_chars // 1000 AS n_chars, CASE WHEN h >= 0.9 THEN 'Healthy' WHEN h >= 0.7 THEN 'PartiallyRecovered' WHEN h >= 0.4 THEN 'Damaged' ELSE 'SeverelyDamaged' END AS level, count(*) AS n FROM (SELECT n_chars, 1 - (doc_id % 11) * 0.1 AS h FROM documents) GROUP BY ALL)")
def health_levels(spark, d):
    docs = table(spark, d, "documents").select(F.floor(F.col("n_chars") / 1000).alias("n_chars"), (F.lit(10) - F.col("doc_id") % 11).alias("tenths"))
    level = rules.health_level(F.col("tenths") / 10)
    return docs.groupBy("n_chars", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@_register("WITH k AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT o_custkey, o_orderkey FROM k WHERE place = 1")
def first_visible_per_group(spark, d):
    own = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("place", F.row_number().over(own)).where("place = 1").select("o_custkey", "o_orderkey")
