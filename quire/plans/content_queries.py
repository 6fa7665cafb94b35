"""Registered queries over content threats, strings, provenance, codec choices, damage and merged trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import content, findings, forms_media, graph, structure
from ..sources import export
from ..sources.bridge import table
from . import structure_queries, text_queries
from .graph_queries import _name_trees

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return add


def _list(words) -> str:
    return "[" + ", ".join(map(text_queries._quote, words)) + "]"


@_register(f"""{text_queries.ALL}, s AS (SELECT doc_id, unnest(list_filter({_list(content.SUSPECT)}, lambda w: contains(text, w))) AS pattern FROM texts)
 SELECT doc_id, 'script' AS kind, 'javascript' AS pattern, 'Medium' AS risk FROM texts WHERE len(list_filter({_list(content.SCRIPT)}, lambda w: contains(text, w))) >= 2 OR contains(text, 'function') OR contains(text, 'eval')
 UNION ALL SELECT doc_id, 'external', 'URL', 'High' FROM texts WHERE contains(text, 'http://') OR contains(text, 'https://')
 UNION ALL SELECT doc_id, 'external', 'FilePath', 'High' FROM texts WHERE contains(text, 'file://') OR contains(text, '\\\\') OR contains(text, 'C:\\')
 UNION ALL SELECT doc_id, 'suspicious', pattern, CASE WHEN regexp_matches(pattern, 'eval|exec|shell|ActiveX|launch|system') THEN 'High' WHEN regexp_matches(pattern, 'JavaScript|unescape') THEN 'Medium' ELSE 'Low' END FROM s""")
def content_threats(spark, d):
    return content.content_threats(text_queries._texts(spark, d))


@_register("SELECT doc_id, CAST(i - 1 AS INT) AS place, runs[i] AS string FROM (SELECT doc_id, runs, unnest(generate_series(1, len(runs))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '([ -~]{4,})[^ -~]', 1) AS runs FROM documents WHERE text IS NOT NULL))")
def printable_strings(spark, d):
    return content.printable_strings(table(spark, d, "documents"))


@_register("SELECT event_type, count(*) AS n, round(CASE WHEN sum(user_id % 7) = 0 THEN 0.0 ELSE sum(strlen(props)) / 1048576 / (sum(user_id % 7) / 1000) END, 9) AS rate FROM events GROUP BY event_type")
def throughput(spark, d):
    samples = table(spark, d, "events").select("event_type", F.octet_length("props").alias("bytes"), (F.col("user_id") % 7).alias("ms"))
    return content.throughput(samples, "event_type").withColumn("rate", F.round("rate", 9))


@_register("SELECT p_type AS format, count(*) AS n FROM part WHERE p_size % 4 <> 0 GROUP BY 1")
def format_counts(spark, d):
    return content.format_counts(table(spark, d, "part").select(F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("format")))


@_register("SELECT o_custkey AS doc_id, count(*) AS n_items, count(*) FILTER (o_orderstatus <> 'F') AS n_visible FROM orders GROUP BY 1")
def visible_items(spark, d):
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", -3).otherwise(2).alias("count"))
    return content.visible_items(items)


DAMAGE = [*content.REPAIRS, "MissingObjects"]


@_register(f"""WITH i AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, {_list(DAMAGE)}[1 + o_orderkey % 5] AS damage FROM orders),
 r(damage, priority, name, action, success) AS (VALUES {", ".join(f"('{k}', {p}, '{('Low', 'Medium', 'High')[p - 1]}', '{a}', CAST({s} AS DOUBLE))" for k, (p, a, s) in (content.REPAIRS | {"MissingObjects": content.OTHER_REPAIR}).items())})
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, ord) - 1 AS INT) AS place, action, name AS priority, success FROM i JOIN r USING (damage)""")
def recommendations(spark, d):
    damage = F.element_at(F.array(*map(F.lit, DAMAGE)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return content.recommendations(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), damage.alias("damage")))


@_register(f"WITH k AS ({structure_queries.ORACLE['content_kinds']}) SELECT doc_id, kind, CASE WHEN kind IN ('Text', 'Vector', 'Binary') THEN 'Flate,LZW' WHEN kind = 'Image' THEN 'JPX,DCT,Flate' ELSE 'Flate' END AS algorithms FROM k")
def ranked_algorithms(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", rules.content_kind(F.col("text")).alias("kind"))
    return docs.select("doc_id", "kind", F.array_join(content.ranked_algorithms(F.col("kind")), ",").alias("algorithms"))


@_register("SELECT l_orderkey, t.algorithm AS algorithm, t.ratio AS ratio FROM (SELECT l_orderkey, arg_min({'algorithm': l_returnflag, 'ratio': l_quantity * (1 - l_discount) / l_quantity}, (l_quantity * (1 - l_discount) / l_quantity, l_linenumber, l_returnflag)) AS t FROM lineitem GROUP BY l_orderkey)")
def best_ratios(spark, d):
    tries = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("algorithm"), F.col("l_quantity").alias("original"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("compressed"))
    return content.best_ratios(tries, "l_orderkey")


@_register("SELECT source, min(doc_id) AS place, line AS value FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY source, line")
def unique_lines(spark, d):
    """The lines of each source, each where it comes first."""
    lines = table(spark, d, "documents").select("source", F.col("doc_id").alias("place"), F.explode(F.split("text", "\n")).alias("value"))
    return content.unique_in_order(lines, "source")


def _parent_trees(spark, d):
    """A customer's orders as a number tree in parts, one a priority; the numbers are days of the year, so that parts overlap."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("tree"), F.col("o_orderpriority").alias("part"), F.dayofyear("o_orderdate").cast("long").alias("num"), F.col("o_orderkey").alias("value"))


@_register("SELECT o_custkey AS tree, CAST(dayofyear(o_orderdate) AS BIGINT) AS num, arg_max(o_orderkey, (o_orderpriority, o_orderkey)) AS value FROM orders GROUP BY ALL")
def parent_tree_entries(spark, d):
    return content.merged_entries(_parent_trees(spark, d))


@_register("SELECT o_custkey AS tree, CAST(min(dayofyear(o_orderdate)) AS BIGINT) AS low, CAST(max(dayofyear(o_orderdate)) AS BIGINT) AS high FROM orders GROUP BY 1")
def parent_tree_limits(spark, d):
    return content.merged_limits(_parent_trees(spark, d))


SAMPLES = [0.0, 0.25, 1.0, 0.5, 0.75]


@_register(f"""WITH e AS (SELECT event_id, least(greatest((least(greatest(value, 1.0), 9.0) - 1.0) / 8.0 * 4.0, 0.0), 4.0) AS x FROM events), s AS (SELECT event_id, x, CAST(floor(x) AS INT) AS low, {SAMPLES}::DOUBLE[] AS t FROM e)
 SELECT event_id, round(10.0 + (t[low + 1] + (x - low) * (t[least(low + 1, 4) + 1] - t[low + 1])) * 10.0, 6) AS y FROM s""")
def sampled_values(spark, d):
    y = content.sampled(F.col("value"), SAMPLES, (1.0, 9.0), (0.0, 4.0), (10.0, 20.0))
    return table(spark, d, "events").select("event_id", F.round(y, 6).alias("y"))


def _provenance(spark, d):
    """Orders as nodes: those of one status were changed by later revisions, those of two priorities were repaired, some lie in an object stream."""
    c = F.col
    repairs = F.when(c("o_orderpriority") == "1-URGENT", F.array(F.lit("ObjectRepair"))).when(c("o_orderpriority") == "2-HIGH", F.array(F.lit("StreamRepair"))).otherwise(F.array().cast("array<string>"))
    revisions = F.when(c("o_orderstatus") == "F", F.array(F.year("o_orderdate"), F.year("o_orderdate") + 1)).otherwise(F.array().cast("array<int>"))
    errors = F.when(c("o_totalprice") > 250000, F.array(F.lit("size"))).when(c("o_totalprice") > 100000, F.array().cast("array<string>"))
    return table(spark, d, "orders").select("o_orderkey", revisions.alias("revisions"), repairs.alias("repairs"), (c("o_custkey") % 10).alias("container"), errors.alias("errors"))


@_register("""SELECT 'Incremental' AS asked, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'Recovered', o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') UNION ALL SELECT 'Inferred', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
 UNION ALL SELECT 'FromObjectStream', o_orderkey FROM orders WHERE o_custkey % 10 = 3 UNION ALL SELECT 'Revision', o_orderkey FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (1995, 1996)""")
def provenance_hits(spark, d):
    nodes = _provenance(spark, d)
    out = None
    for asked in (*content.PROVENANCE, "FromObjectStream", "Revision"):
        hits = content.by_provenance(nodes, asked, container=3, revision=1996).select(F.lit(asked).alias("asked"), "o_orderkey")
        out = hits if out is None else out.unionByName(hits)
    return out


@_register("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000")
def error_nodes(spark, d):
    return content.with_errors(_provenance(spark, d)).select("o_orderkey")


@_register("SELECT l_orderkey, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag WHEN l_partkey % 3 <> 0 THEN p_brand END AS dict, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def resolved_dicts(spark, d):
    """Line items with a dictionary of their own or a reference to a part, of which one in three is no dictionary."""
    own = F.col("l_partkey") % 2 == 0
    values = table(spark, d, "lineitem").select("l_orderkey", F.when(own, F.col("l_returnflag")).alias("dict"), F.when(~own, F.col("l_partkey")).alias("ref"))
    objects = table(spark, d, "part").select(F.col("p_partkey").alias("obj"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("dict"))
    return content.resolved_dicts(values, objects).groupBy("l_orderkey", "dict").agg(F.count(F.lit(1)).alias("n"))


def _named_objects(spark, d):
    """Customers as the objects behind their names: scripts in one segment, file specifications in another."""
    c = F.col
    script = F.create_map(F.lit("JS"), F.concat(F.lit("app.alert('"), "c_name", F.lit("')")))
    spec = F.create_map(F.lit("F"), F.col("c_name"), F.lit("UF"), F.when(c("c_custkey") % 2 == 0, F.lower("c_name")), F.lit("Size"), (c("c_custkey") * 10).cast("string"), F.lit("Subtype"), F.lit("/text/plain"), F.lit("EF"), F.lit("yes"))
    made = F.when(c("c_mktsegment") == "BUILDING", script).when(c("c_mktsegment") == "MACHINERY", spec).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, d, "customer").select(c("c_custkey").alias("obj"), made.alias("dict"))


_NAMED = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@_register(f"SELECT r_name AS tree, c_name AS name, concat('app.alert(''', c_name, ''')') AS script {_NAMED} WHERE c_mktsegment = 'BUILDING'")
def named_scripts(spark, d):
    return content.named_scripts(graph.tree_entries(*_name_trees(spark, d)), _named_objects(spark, d))


@_register(f"SELECT r_name AS tree, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END AS file_name, c_custkey * 10 AS size, 'text/plain' AS mime {_NAMED} WHERE c_mktsegment = 'MACHINERY'")
def embedded_files(spark, d):
    return content.embedded_files(graph.tree_entries(*_name_trees(spark, d)), _named_objects(spark, d))


@_register("SELECT p_partkey AS doc_id, CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_brand = p_type THEN 1 ELSE 2 END::BIGINT AS n_assets, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_brand = p_type THEN p_brand ELSE concat(p_brand, '|', p_type) END AS asset_names, (CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END)::BIGINT AS n_configurations, (CASE WHEN p_size % 3 = 0 THEN 0 ELSE 2 END)::BIGINT AS n_scripts FROM part")
def rich_media(spark, d):
    body = F.to_json(F.struct(F.struct(F.array("p_brand", "p_type", "p_brand").alias("Names")).alias("Assets"), F.array("p_name").alias("Configurations")))
    made = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 5 != 0, body).alias("content"), F.when(F.col("p_size") % 3 != 0, '{"Scripts": ["a", "b"]}').alias("settings"))
    return content.rich_media(made).withColumn("asset_names", F.array_join("asset_names", "|"))


@_register("SELECT p_partkey AS doc_id, 'dc:title' AS key, p_name AS value FROM part")
def namespace_properties(spark, d):
    return content.properties_of(structure.xmp_properties(structure_queries._packets(spark, d)), "dc:")


_DIFFS = text_queries.ORACLE["page_compare"]


@_register(f"""WITH c AS ({_DIFFS}), n AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (change = 'Added') AS a, count(*) FILTER (change = 'Removed') AS r, string_agg(concat('- page ', page, ': ', change), chr(10) ORDER BY page) FILTER (change <> 'Same') AS lines FROM c GROUP BY doc_id)
 SELECT doc_id, concat_ws(chr(10), format('similarity {{:.2f}}%', greatest(0, least(1, 1 - (a + r) / (pages + 10))) * 100), concat('changes ', a + r), concat('added ', a), concat('removed ', r), 'modified 0', lines) AS report FROM n""")
def diff_reports(spark, d):
    """Each order compared with the one after it, as text."""
    changes = text_queries.page_compare(spark, d)
    return export.diff_reports(changes, changes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages")))


_TOML = "string_agg(concat('[[findings]]', chr(10), 'severity = \"', severity, '\"', chr(10), 'rule = \"', rule, '\"'), chr(10) || chr(10) ORDER BY concat(severity, '\"', rule)) AS tables"


@_register(f"""WITH s AS ({text_queries.ORACLE["risk_scores"]}), t AS (SELECT doc_id, {_TOML} FROM ({text_queries.ALL}, {text_queries.FOUND} SELECT * FROM every_threat) GROUP BY doc_id)
 SELECT doc_id, concat('score = ', score, chr(10), 'level = "', level, '"', chr(10), 'is_safe = ', CASE WHEN safe THEN 'true' ELSE 'false' END, chr(10), chr(10), tables) AS report FROM s JOIN t USING (doc_id)""")
def toml_reports(spark, d):
    found = findings.all_threats(text_queries._texts(spark, d))
    return export.report_toml(findings.risk(found), found)


def _form_parts(spark, d):
    """Orders as parts of their customers' forms: one status has no content, one priority no name."""
    c = F.col
    name = F.when(c("o_orderpriority") != "5-LOW", F.lower("o_orderpriority"))
    body = F.when(c("o_orderstatus") == "F", F.lit("")).otherwise(F.concat(F.lit("<?xml version='1.0'?>\n<xfa:part"), c("o_orderstatus"), F.lit(" id='"), c("o_orderkey").cast("string"), F.lit("'/>")))
    return table(spark, d, "orders").select(c("o_custkey").alias("doc_id"), c("o_orderkey").alias("ord"), name.alias("name"), body.alias("xml"))


@_register("SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE WHEN o_orderpriority = '5-LOW' THEN 'packet' ELSE lower(o_orderpriority) END AS name, concat('part', o_orderstatus) AS root, strlen(concat('<?xml version=''1.0''?>', chr(10), '<xfa:part', o_orderstatus, ' id=''', o_orderkey, '''/>')) AS n_bytes FROM orders WHERE o_orderstatus <> 'F'")
def template_packets(spark, d):
    return forms_media.template_packets(_form_parts(spark, d))


@_register("SELECT DISTINCT o_custkey AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND c_mktsegment = 'BUILDING'")
def hybrid_forms(spark, d):
    fields = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("doc_id"))
    return forms_media.hybrid_forms(forms_media.template_packets(_form_parts(spark, d)), fields)
