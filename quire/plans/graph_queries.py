"""Registered queries over the object graph, each with its SQL on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import graph, select
from ..sources.bridge import object_edges, object_nodes, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

LINES = """lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord FROM lineitem)"""
NODES = """nodes AS (
 SELECT CAST(-1 AS BIGINT) doc_id, 'root' node_id, 'Root' node_type, CAST(NULL AS BIGINT) obj, NULL k1, NULL v1, NULL k2, NULL v2
 UNION ALL SELECT r_regionkey, concat('r', r_regionkey), 'Catalog', r_regionkey, 'Name', r_name, NULL, NULL FROM region
 UNION ALL SELECT n_regionkey, concat('n', n_nationkey), 'Pages', n_nationkey, 'Name', n_name, NULL, NULL FROM nation
 UNION ALL SELECT n_regionkey, concat('c', c_custkey), 'Page', c_custkey, 'Name', c_name, 'Segment', c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT n_regionkey, concat('o', o_orderkey), 'Annotation', o_orderkey, 'Status', o_orderstatus, 'Priority', o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT n_regionkey, concat('l', l_orderkey, '.', ord), 'ContentOperator', l_orderkey, 'ReturnFlag', l_returnflag, 'LineStatus', l_linestatus FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT NULL, concat('p', p_partkey), 'Font', p_partkey, 'Name', p_name, 'Brand', p_brand FROM part
 UNION ALL SELECT NULL, concat('s', s_suppkey), 'Image', s_suppkey, 'Name', s_name, NULL, NULL FROM supplier)"""
EDGES = """edges AS (
 SELECT 'root' src, concat('r', r_regionkey) dst, 'Child' edge_type, CAST(r_regionkey AS BIGINT) ord FROM region
 UNION ALL SELECT concat('r', n_regionkey), concat('n', n_nationkey), 'Child', n_nationkey FROM nation
 UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey), 'Child', c_custkey FROM customer
 UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey), 'Child', o_orderkey FROM orders
 UNION ALL SELECT concat('o', l_orderkey), concat('l', l_orderkey, '.', ord), 'Child', ord FROM lines
 UNION ALL SELECT concat('l', l_orderkey, '.', ord), concat('p', l_partkey), 'Reference', 0 FROM lines
 UNION ALL SELECT concat('l', l_orderkey, '.', ord), concat('s', l_suppkey), 'Reference', 1 FROM lines)"""
CHILD = "child AS (SELECT src, dst, ord FROM edges WHERE edge_type = 'Child')"
PLACED = "placed AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY ord, dst) - 1 AS at, count(*) OVER (PARTITION BY src) AS n FROM child)"
ALL = f"WITH RECURSIVE {LINES}, {NODES}, {EDGES}, {CHILD}, {PLACED}"


def _register(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql.replace("@all", ALL)
        return fn

    return add


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return object_nodes(spark, d), object_edges(spark, d)


@_register("@all SELECT coalesce(doc_id, -2) AS doc_id, count(*) AS n FROM nodes GROUP BY ALL")
def node_count(spark, d):
    return object_nodes(spark, d).groupBy(F.coalesce("doc_id", F.lit(-2)).alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@_register("@all SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type")
def edge_count(spark, d):
    return object_edges(spark, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@_register("@all SELECT coalesce(doc_id, -2) AS doc_id, node_type, count(*) AS n FROM nodes GROUP BY ALL")
def type_histogram(spark, d):
    return object_nodes(spark, d).groupBy(F.coalesce("doc_id", F.lit(-2)).alias("doc_id"), "node_type").agg(F.count(F.lit(1)).alias("n"))


@_register("@all SELECT s.node_type AS src_type, e.edge_type, t.node_type AS dst_type, count(*) AS n FROM edges e JOIN nodes s ON e.src = s.node_id JOIN nodes t ON e.dst = t.node_id GROUP BY ALL")
def edge_type_histogram(spark, d):
    """Ends are looked up by (node_id, type) alone; what is counted first is the types on the source's side of each target."""
    nodes, edges = _graph(spark, d)
    src, dst = (nodes.select(F.col("node_id").alias(c), F.col("node_type").alias(f"{c}_type")) for c in ("src", "dst"))
    by_target = edges.join(src, "src").groupBy("dst", "edge_type", "src_type").agg(F.count(F.lit(1)).alias("n"))
    return by_target.join(dst, "dst").groupBy("src_type", "edge_type", "dst_type").agg(F.sum("n").alias("n"))


@_register("@all SELECT c.src, c.dst, n.node_type, c.ord FROM child c JOIN nodes n ON c.dst = n.node_id")
def children(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.children(edges, nodes)


@_register("@all SELECT e.src, e.dst, n.node_type FROM edges e JOIN nodes n ON e.dst = n.node_id WHERE e.edge_type = 'Reference'")
def references(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.references(edges, nodes)


@_register("@all SELECT dst AS node_id, src AS parent FROM child")
def parent(spark, d):
    return graph.parents(object_edges(spark, d))


@_register("@all SELECT src, count(*) AS n_out, count(*) FILTER (edge_type = 'Reference') AS n_references FROM edges GROUP BY src")
def out_edges(spark, d):
    return object_edges(spark, d).groupBy("src").agg(F.count(F.lit(1)).alias("n_out"), F.count_if(F.col("edge_type") == "Reference").alias("n_references"))


@_register("@all SELECT e.src, e.dst FROM edges e WHERE edge_type = 'Reference' AND e.dst IN (SELECT concat('p', p_partkey) FROM part WHERE p_partkey % 97 = 0)")
def dangling_references(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.dangling(edges, nodes.where(~((F.col("node_type") == "Font") & (F.col("obj") % 97 == 0))))


@_register("@all SELECT node_id, node_type, obj FROM nodes WHERE node_type = 'Page' AND obj = 12")
def resolve_object(spark, d):
    return object_nodes(spark, d).where((F.col("node_type") == "Page") & (F.col("obj") == 12)).select("node_id", "node_type", "obj")


WALK = "w(node_id, depth, path) AS (SELECT 'root', 0, 'root' UNION ALL SELECT c.dst, w.depth + 1, concat(w.path, '/', c.dst) FROM w JOIN child c ON w.node_id = c.src)"


def _from_root(spark, d, **more) -> DataFrame:
    edges = object_edges(spark, d).where("edge_type = 'Child'")
    start = spark.range(1).select(F.lit("root").alias("node_id"))
    if more.get("step"):
        edges, start = edges.withColumn("step", F.col("dst")), start.withColumn("step", F.col("node_id"))
    return graph.walk(edges, start, **more)


@_register(f"@all, {WALK} SELECT node_id, path, CAST(depth AS BIGINT) AS depth FROM w")
def path_to_root(spark, d):
    return _from_root(spark, d, step="step").select("node_id", "path", F.col("depth").cast("long").alias("depth"))


@_register(f"@all, {WALK} SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM w GROUP BY depth")
def breadth_first_levels(spark, d):
    return _from_root(spark, d).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@_register(f"@all, {WALK} SELECT n.node_type, count(*) AS n FROM w JOIN nodes n USING (node_id) WHERE depth <= 3 GROUP BY n.node_type")
def depth_limited_walk(spark, d):
    nodes = object_nodes(spark, d).select("node_id", "node_type")
    return _from_root(spark, d, max_depth=3).join(nodes, "node_id").groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@_register(f"@all, {WALK} SELECT n.doc_id, CAST(max(depth) AS BIGINT) AS max_depth FROM w JOIN nodes n USING (node_id) GROUP BY n.doc_id")
def max_depth(spark, d):
    nodes = object_nodes(spark, d).select("node_id", "doc_id")
    return _from_root(spark, d).join(nodes, "node_id").groupBy("doc_id").agg(F.max("depth").cast("long").alias("max_depth"))


@_register(f"@all, {WALK} SELECT node_id, array_to_string(list_transform(string_split(path, '/'), lambda x: lpad(x, 14, '0')), '/') AS sort_key FROM w")
def depth_first_order(spark, d):
    """The key that sorts nodes in pre-order."""
    key = F.array_join(F.transform(F.split("path", "/"), lambda x: F.lpad(x, 14, "0")), "/")
    return _from_root(spark, d, step="step").select("node_id", key.alias("sort_key"))


@_register("""@all, u(origin, node_id) AS (SELECT node_id, node_id FROM nodes WHERE node_type IN ('Catalog', 'Pages', 'Page')
 UNION ALL SELECT u.origin, c.dst FROM u JOIN child c ON u.node_id = c.src) SELECT origin AS node_id, count(*) - 1 AS n_descendants FROM u GROUP BY origin""")
def subtree_size(spark, d):
    nodes, edges = _graph(spark, d)
    start = nodes.where(F.col("node_type").isin("Catalog", "Pages", "Page")).select("node_id")
    under = graph.walk(edges.where("edge_type = 'Child'"), start)
    return under.groupBy(F.col("origin").alias("node_id")).agg((F.count(F.lit(1)) - 1).alias("n_descendants"))


@_register("""@all, u(origin, node_id) AS (SELECT node_id, node_id FROM nodes WHERE node_type = 'Page' UNION ALL SELECT u.origin, c.dst FROM u JOIN child c ON u.node_id = c.src)
 SELECT u.node_id, u.origin AS page, p.at + 1 AS page_number FROM u JOIN placed p ON u.origin = p.dst""")
def page_number(spark, d):
    return graph.page_numbers(*_graph(spark, d))


@_register("@all, u(node_id, over, depth) AS (SELECT dst, src, 1 FROM child WHERE dst LIKE 'l%' UNION ALL SELECT u.node_id, c.src, u.depth + 1 FROM u JOIN child c ON u.over = c.dst) SELECT node_id, over AS ancestor, CAST(depth AS BIGINT) AS depth FROM u")
def ancestors(spark, d):
    nodes, edges = _graph(spark, d)
    start = nodes.where("node_type = 'ContentOperator'").select("node_id")
    return graph.ancestors(edges, start).select(F.col("origin").alias("node_id"), F.col("node_id").alias("ancestor"), F.col("depth").cast("long").alias("depth"))


@_register("SELECT concat('r', r_regionkey) AS src, concat('n', n_nationkey) AS dst FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3) UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation WHERE n_regionkey IN (1, 3) UNION ALL SELECT 'root', concat('r', r_regionkey) FROM region WHERE r_regionkey IN (1, 3)")
def cyclic_structure(spark, d):
    """Parent links added in two documents; what peeling leaves is their cycles and what leads into them."""
    edges = object_edges(spark, d).where("edge_type = 'Child'").select("src", "dst")
    back = table(spark, d, "nation").where("n_regionkey in (1, 3)").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("dst"))
    return graph.cyclic(edges.unionByName(back))


@_register("@all SELECT DISTINCT e.dst AS node_id FROM edges e WHERE e.edge_type = 'Reference'")
def reachable_resources(spark, d):
    nodes, edges = _graph(spark, d)
    ends = graph.references(edges, nodes).select(F.col("dst").alias("node_id"))
    return ends.distinct()


SELECTORS = {
    "select_type": ("page", "SELECT node_id FROM nodes WHERE node_type = 'Page'"),
    "select_object": ("#12.0", "SELECT node_id FROM nodes WHERE obj = 12"),
    "select_has_property": ("[Segment]", "SELECT node_id FROM nodes WHERE k2 = 'Segment' AND v2 IS NOT NULL"),
    "select_property_equals": ("[Segment=BUILDING]", "SELECT node_id FROM nodes WHERE k2 = 'Segment' AND v2 = 'BUILDING'"),
    "select_child": ("pages > page[Segment=MACHINERY]", "SELECT n.node_id FROM nodes n JOIN child c ON c.dst = n.node_id JOIN nodes p ON p.node_id = c.src WHERE n.v2 = 'MACHINERY' AND n.node_type = 'Page' AND p.node_type = 'Pages'"),
    "select_descendant": ("catalog[Name=ASIA] annotation", "SELECT node_id FROM nodes WHERE node_type = 'Annotation' AND doc_id IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')"),
    "select_or": ("font, image", "SELECT node_id FROM nodes WHERE node_type IN ('Font', 'Image')"),
    "select_first": ("annotation:first", "SELECT n.node_id FROM nodes n JOIN placed p ON n.node_id = p.dst WHERE node_type = 'Annotation' AND p.at = 0"),
    "select_last": ("annotation:last", "SELECT n.node_id FROM nodes n JOIN placed p ON n.node_id = p.dst WHERE node_type = 'Annotation' AND p.at = p.n - 1"),
    "select_nth": ("annotation:nth-child(2)", "SELECT n.node_id FROM nodes n JOIN placed p ON n.node_id = p.dst WHERE node_type = 'Annotation' AND p.at = 2"),
}


def _selector(name: str, text: str, sql: str) -> None:
    def run(spark, d):
        return select.select(select.parse(text), *_graph(spark, d))

    run.__name__ = name
    _register(f"@all {sql}")(run)


for _name, (_text, _sql) in SELECTORS.items():
    _selector(_name, _text, _sql)

_S = select.Selector
BUILT = {
    "select_and": (select.of_type("page") & select.equals("Segment", "BUILDING"), "SELECT node_id FROM nodes WHERE node_type = 'Page' AND v2 = 'BUILDING'"),
    "select_not": (~select.of_type("ContentOperator"), "SELECT node_id FROM nodes WHERE node_type <> 'ContentOperator'"),
    "select_property_regex": (select.matches("Name", "^Customer#0*1[0-9]$"), "SELECT node_id FROM nodes WHERE k1 = 'Name' AND regexp_matches(v1, '^Customer#0*1[0-9]$')"),
    "select_range": (select.place(select.of_type("Annotation"), 1, 3), "SELECT n.node_id FROM nodes n JOIN placed p ON n.node_id = p.dst WHERE node_type = 'Annotation' AND p.at IN (1, 2)"),
    "select_parent": (_S("parent", (select.equals("Status", "F"), select.of_type("page"))), "SELECT DISTINCT c.src AS node_id FROM nodes n JOIN child c ON n.node_id = c.dst WHERE n.k1 = 'Status' AND n.v1 = 'F'"),
    "select_ancestor": (_S("ancestor", (select.equals("Status", "P"), select.of_type("pages"))), "SELECT DISTINCT concat('n', c_nationkey) AS node_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'"),
    "select_sibling": (_S("sibling", (select.equals("Status", "P"), select.of_type("Annotation"))), "SELECT DISTINCT b.dst AS node_id FROM nodes n JOIN child a ON n.node_id = a.dst JOIN child b ON a.src = b.src AND a.dst <> b.dst WHERE n.k1 = 'Status' AND n.v1 = 'P'"),
    "select_path": (select.of_type("catalog").child(select.of_type("pages")).child(select.equals("Segment", "BUILDING")), "SELECT node_id FROM nodes WHERE v2 = 'BUILDING' AND node_type = 'Page'"),
}


def _built(name: str, selector, sql: str) -> None:
    def run(spark, d):
        return select.select(selector, *_graph(spark, d))

    run.__name__ = name
    _register(f"@all {sql}")(run)


for _name, (_sel, _sql) in BUILT.items():
    _built(_name, _sel, _sql)


@_register("@all SELECT node_id FROM nodes WHERE node_type = 'Page' ORDER BY node_id LIMIT 10")
def select_limit(spark, d):
    return select.select(select.parse("page"), *_graph(spark, d)).orderBy("node_id").limit(10)


@_register("@all SELECT node_type, count(*) AS n FROM nodes WHERE doc_id IS DISTINCT FROM 2 AND node_id <> 'root' GROUP BY node_type")
def remove_subtree(spark, d):
    nodes, edges = _graph(spark, d)
    kept, _ = graph.remove_subtree(nodes.where("node_id <> 'root'"), edges, spark.range(1).select(F.lit("r2").alias("node_id")))
    return kept.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@_register("@all SELECT CASE WHEN dst LIKE 'n%' AND ord % 5 = 0 THEN 'r0' ELSE src END AS src, dst FROM child WHERE dst LIKE 'n%'")
def move_subtree(spark, d):
    edges = object_edges(spark, d)
    moves = table(spark, d, "nation").where("n_nationkey % 5 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node_id"), F.lit("r0").alias("new_parent"))
    return graph.move_subtree(edges, moves).where("dst like 'n%'").select("src", "dst")


@_register("""@all, moved AS (SELECT DISTINCT CASE WHEN e.dst LIKE 's%' AND CAST(substr(e.dst, 2) AS BIGINT) % 2 = 1 THEN concat('s', CAST(substr(e.dst, 2) AS BIGINT) + 1) ELSE e.dst END AS dst, e.src FROM edges e WHERE e.dst LIKE 's%')
 SELECT dst, count(*) AS n FROM moved GROUP BY dst""")
def merge_nodes(spark, d):
    nodes, edges = _graph(spark, d)
    pairs = table(spark, d, "supplier").where("s_suppkey % 2 = 1").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("source"), F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("target"))
    _, merged = graph.merge_nodes(nodes, edges.where("dst like 's%'"), pairs)
    return merged.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


@_register("@all SELECT count(*) AS n_nodes, count(DISTINCT concat(node_type, '|', coalesce(v1, ''), '|', coalesce(v2, ''))) AS n_contents FROM nodes WHERE node_type = 'Annotation'")
def content_ids(spark, d):
    found = graph.content_ids(object_nodes(spark, d).where("node_type = 'Annotation'"))
    return found.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("content_id").alias("n_contents"))


@_register("""@all SELECT doc_id, count(*) FILTER (node_type = 'Page') AS n_pages, bool_or(node_type = 'Annotation' AND v2 = '1-URGENT') AS has_urgent, count(DISTINCT node_type) AS n_types FROM nodes WHERE doc_id >= 0 GROUP BY doc_id""")
def document_metadata(spark, d):
    nodes = object_nodes(spark, d).where("doc_id >= 0")
    return nodes.groupBy("doc_id").agg(
        F.count_if(F.col("node_type") == "Page").alias("n_pages"),
        F.bool_or(F.coalesce((F.col("node_type") == "Annotation") & (F.col("props")["Priority"] == "1-URGENT"), F.lit(False))).alias("has_urgent"),
        F.count_distinct("node_type").alias("n_types"),
    )


@_register("@all SELECT node_type, CASE node_type WHEN 'Catalog' THEN 1.0 WHEN 'Page' THEN 0.8 ELSE 0.5 END AS weight, count(*) AS n FROM nodes GROUP BY ALL")
def index_weights(spark, d):
    return object_nodes(spark, d).groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).select("node_type", rules.index_weight(F.col("node_type")).cast("double").alias("weight"), "n")


@_register("""@all SELECT doc_id, CASE WHEN n_cat = 1 AND n_pages > 0 THEN 'pass' ELSE 'fail' END AS status, n_cat, n_pages FROM (SELECT doc_id, count(*) FILTER (node_type = 'Catalog') AS n_cat, count(*) FILTER (node_type = 'Pages') AS n_pages FROM nodes WHERE doc_id >= 0 GROUP BY doc_id)""")
def validate_catalog_and_pages(spark, d):
    by = object_nodes(spark, d).where("doc_id >= 0").groupBy("doc_id").agg(F.count_if(F.col("node_type") == "Catalog").alias("n_cat"), F.count_if(F.col("node_type") == "Pages").alias("n_pages"))
    return by.select("doc_id", F.when((F.col("n_cat") == 1) & (F.col("n_pages") > 0), "pass").otherwise("fail").alias("status"), "n_cat", "n_pages")


@_register("@all SELECT src AS node_id, arg_max(dst, ord) AS last_child, count(*) AS n FROM child WHERE src LIKE 'c%' GROUP BY src")
def last_children(spark, d):
    edges = object_edges(spark, d).where("edge_type = 'Child' and src like 'c%'")
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.max_by("dst", "ord").alias("last_child"), F.count(F.lit(1)).alias("n"))


@_register("@all, f AS (SELECT n.doc_id, e.dst, count(*) AS uses FROM edges e JOIN nodes n ON e.src = n.node_id WHERE e.dst LIKE 'p%' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, dst) AS place FROM f) SELECT doc_id, dst AS font, uses, place FROM k WHERE place <= 3")
def most_used_fonts(spark, d):
    nodes, edges = _graph(spark, d)
    uses = edges.where("dst like 'p%'").join(nodes.select(F.col("node_id").alias("src"), "doc_id"), "src").groupBy("doc_id", "dst").agg(F.count(F.lit(1)).alias("uses"))
    own = Window.partitionBy("doc_id").orderBy(F.desc("uses"), "dst")
    return uses.withColumn("place", F.row_number().over(own).cast("long")).where("place <= 3").select("doc_id", F.col("dst").alias("font"), "uses", "place")


@_register("@all SELECT concat('r', n_regionkey) AS node_id, concat('n', n_nationkey) AS new_parent, true AS cycle FROM nation UNION ALL SELECT concat('n', n_nationkey), concat('r', (n_regionkey + 1) % 5), false FROM nation")
def cycle_checks(spark, d):
    nations = table(spark, d, "nation")
    up = nations.select(F.concat(F.lit("r"), "n_regionkey").alias("node_id"), F.concat(F.lit("n"), "n_nationkey").alias("new_parent"))
    side = nations.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), (F.col("n_regionkey") + 1) % 5).alias("new_parent"))
    return graph.would_create_cycle(object_edges(spark, d), up.unionByName(side))


@_register("SELECT concat('r', n_regionkey) AS node_id, concat('n', n_nationkey) AS new_parent, 'cycle' AS problem FROM nation UNION ALL SELECT concat('c', c_custkey), concat('r', c_nationkey % 5), 'type' FROM customer UNION ALL SELECT concat('n', n_nationkey), 'x', 'missing' FROM nation")
def move_problems(spark, d):
    nodes, edges = _graph(spark, d)
    nations, customers = table(spark, d, "nation"), table(spark, d, "customer")
    pair = lambda df, a, b: df.select(a.alias("node_id"), b.alias("new_parent"))
    nation = F.concat(F.lit("n"), "n_nationkey")
    moves = pair(nations, F.concat(F.lit("r"), "n_regionkey"), nation).unionByName(pair(nations, nation, F.lit("x"))).unionByName(pair(nations, nation, F.concat(F.lit("r"), (F.col("n_regionkey") + 1) % 5)))
    moves = moves.unionByName(pair(customers, F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("r"), F.col("c_nationkey") % 5)))
    return graph.validate_moves(nodes, edges, moves)


@_register("@all SELECT CASE WHEN node_type = 'Annotation' AND v1 = 'F' THEN 'Archived' ELSE node_type END AS node_type, count(*) AS n FROM nodes GROUP BY ALL")
def replaced_nodes(spark, d):
    nodes = object_nodes(spark, d)
    new = nodes.where("node_type = 'Annotation' and props['Status'] = 'F'").select("node_id", F.lit("Archived").alias("node_type"), "props")
    return graph.replace_nodes(nodes, new).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@_register("@all, o AS (SELECT concat('c', c_custkey) AS src, concat('new', c_custkey) AS dst FROM customer) SELECT o.src, o.dst, CAST(coalesce(m.last, -1) + 1 AS BIGINT) AS ord FROM o LEFT JOIN (SELECT src, max(ord) AS last FROM child GROUP BY src) m USING (src)")
def inserted_nodes(spark, d):
    nodes, edges = _graph(spark, d)
    new = nodes.where("node_type = 'Page'").select(F.col("node_id").alias("parent"), "doc_id", F.concat(F.lit("new"), F.expr("substring(node_id, 2)")).alias("node_id"), F.lit("Annotation").alias("node_type"), "obj", "props")
    _, grown = graph.insert_nodes(nodes, edges, new.unionByName(new.withColumn("parent", F.lit("nowhere")).withColumn("node_id", F.concat("node_id", F.lit("x")))))
    return grown.where("dst like 'new%'").select("src", "dst", "ord")


@_register("@all SELECT n.node_type, count(*) AS n, (SELECT count(*) FROM edges e JOIN nodes s ON e.src = s.node_id WHERE s.doc_id = 2) + 1 AS n_edges FROM nodes n WHERE doc_id = 2 GROUP BY n.node_type")
def cloned_subtree(spark, d):
    nodes, edges = _graph(spark, d)
    copies, links = graph.clone_subtrees(nodes, edges, spark.range(1).select(F.lit("r2").alias("node_id"), F.lit("root").alias("new_parent")))
    return copies.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).crossJoin(links.agg(F.count(F.lit(1)).alias("n_edges")))


def _name_trees(spark, d):
    """Customers' names in one tree a region: a nation's node holds the names of its customers."""
    nations = table(spark, d, "nation")
    trees = table(spark, d, "region").select(F.col("r_name").alias("tree"), F.concat(F.lit("r"), "r_regionkey").alias("node_id"))
    kids = nations.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    entries = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("node_id"), F.col("c_name").alias("key"), F.col("c_custkey").alias("value"))
    return trees, kids, entries


@_register("SELECT r_name AS tree, c_name AS key, c_custkey AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def name_tree_entries(spark, d):
    return graph.tree_entries(*_name_trees(spark, d))


@_register("SELECT r_name AS tree, c_name AS key, c_custkey AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'")
def name_tree_lookup(spark, d):
    """The names of one market segment looked up in every region's tree."""
    trees, kids, entries = _name_trees(spark, d)
    limits = entries.groupBy("node_id").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    asked = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.explode(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")))).alias("tree"), F.col("c_name").alias("key"))
    return graph.tree_lookup(trees, limits, kids, entries, asked)
