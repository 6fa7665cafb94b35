"""The relational tables seen as a document graph and as document texts.

``object_graph`` turns the star schema into typed nodes and edges: root, regions
(Catalog), nations (Pages), customers (Page), orders (Annotation), line items
(ContentOperator) with Child edges, parts (Font) and suppliers (Image) with
Reference edges. A region is a document. Identifiers come from keys, so no shuffle
is needed to number nodes; only line items, whose keys repeat, are numbered within
their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, *keys: str) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws(".", *(F.col(k).cast("string") for k in keys)))


def _props(**columns: str) -> Column:
    return F.create_map(*(x for k, c in columns.items() for x in (F.lit(k), F.col(c))))


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return lines.withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(customers, orders) with the region that is their document."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("doc_id"))
    customers = table(spark, sf_dir, "customer").join(nations, "c_nationkey")
    orders = table(spark, sf_dir, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), "doc_id"), "o_custkey")
    return customers, orders


def object_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, node_id, node_type, obj, props): shared parts and suppliers have no document, the root has -1."""
    customers, orders = _regions(spark, sf_dir)
    lines = _numbered_lines(spark, sf_dir).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "doc_id"), "l_orderkey")
    none = F.lit(None).cast("long")

    def nodes(df: DataFrame, doc: Column, ident: Column, kind: str, obj: Column, props: Column) -> DataFrame:
        return df.select(doc.cast("long").alias("doc_id"), ident.alias("node_id"), F.lit(kind).alias("node_type"), obj.cast("long").alias("obj"), props.alias("props"))

    root = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("root").alias("node_id"), F.lit("Root").alias("node_type"), none.alias("obj"), F.create_map().cast("map<string,string>").alias("props"))
    parts = [
        nodes(table(spark, sf_dir, "region"), F.col("r_regionkey"), _id("r", "r_regionkey"), "Catalog", F.col("r_regionkey"), _props(Name="r_name")),
        nodes(table(spark, sf_dir, "nation"), F.col("n_regionkey"), _id("n", "n_nationkey"), "Pages", F.col("n_nationkey"), _props(Name="n_name")),
        nodes(customers, F.col("doc_id"), _id("c", "c_custkey"), "Page", F.col("c_custkey"), _props(Name="c_name", Segment="c_mktsegment")),
        nodes(orders, F.col("doc_id"), _id("o", "o_orderkey"), "Annotation", F.col("o_orderkey"), _props(Status="o_orderstatus", Priority="o_orderpriority")),
        nodes(lines, F.col("doc_id"), _id("l", "l_orderkey", "ord"), "ContentOperator", F.col("l_orderkey"), _props(ReturnFlag="l_returnflag", LineStatus="l_linestatus")),
        nodes(table(spark, sf_dir, "part"), none, _id("p", "p_partkey"), "Font", F.col("p_partkey"), _props(Name="p_name", Brand="p_brand")),
        nodes(table(spark, sf_dir, "supplier"), none, _id("s", "s_suppkey"), "Image", F.col("s_suppkey"), _props(Name="s_name")),
    ]
    out = root
    for part in parts:
        out = out.unionByName(part)
    return out


def object_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, edge_type, ord) of the same graph."""
    lines = _numbered_lines(spark, sf_dir)

    def edges(df: DataFrame, src: Column, dst: Column, kind: str, place: Column) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), place.cast("long").alias("ord"))

    parts = [
        edges(table(spark, sf_dir, "region"), F.lit("root"), _id("r", "r_regionkey"), "Child", F.col("r_regionkey")),
        edges(table(spark, sf_dir, "nation"), _id("r", "n_regionkey"), _id("n", "n_nationkey"), "Child", F.col("n_nationkey")),
        edges(table(spark, sf_dir, "customer"), _id("n", "c_nationkey"), _id("c", "c_custkey"), "Child", F.col("c_custkey")),
        edges(table(spark, sf_dir, "orders"), _id("c", "o_custkey"), _id("o", "o_orderkey"), "Child", F.col("o_orderkey")),
        edges(lines, _id("o", "l_orderkey"), _id("l", "l_orderkey", "ord"), "Child", F.col("ord")),
        edges(lines, _id("l", "l_orderkey", "ord"), _id("p", "l_partkey"), "Reference", F.lit(0)),
        edges(lines, _id("l", "l_orderkey", "ord"), _id("s", "l_suppkey"), "Reference", F.lit(1)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: What is added to a text by ``doc_id % 11``, so that every rule fires on some rows and not on others.
INJECTED = [
    " var s = eval(unescape(x)); submitForm",
    " http://10.0.0.1/setup?data=1",
    " https://bit.ly/abc?user=me",
    " invoice.pdf.exe",
    " cmd.exe /launch powershell",
    " new Array(4096); for(i=0;i<9;i++) { String(x.length) }",
    " report.doc",
    " ftp://files.example.tk/../x",
    " app.launchURL('file://x') this.exportDataObject",
    " eval(unescape(y)); http://10.0.0.9/setup?data=2 report.pdf.exe",
]


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents with the injected snippets."""
    docs = table(spark, sf_dir, "documents")
    snippet = F.lit("")
    for k, text in reversed(list(enumerate(INJECTED))):
        snippet = F.when(F.col("doc_id") % 11 == k, F.lit(text)).otherwise(snippet)
    return docs.select("doc_id", F.concat("text", snippet).alias("text"))


def text_chunks(texts: DataFrame, size: int = 1024, overlap: int = 128) -> DataFrame:
    """(doc_id, seq, offset, data): characters in chunks of ``size`` that repeat the last ``overlap`` of the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(step))
    each = texts.select("doc_id", "text", F.posexplode(starts).alias("seq", "offset"))
    return each.select("doc_id", "seq", F.col("offset").cast("long"), F.expr(f"substring(text, offset + 1, {size})").alias("data"))
