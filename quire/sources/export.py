"""Sinks: the graph and reports as JSON, XML, CBOR, YAML and plain text, and saved graphs read back."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0.0"
GRAPH = "version string, node_id string, node_type string, props map<string,string>, edges array<struct<dst:string,edge_type:string,ord:bigint>>"


def stable_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One record a node: id, type, properties with sorted keys, out-edges in order, schema version."""
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "dst", "edge_type"))).alias("e"))
    props = F.map_from_entries(F.array_sort(F.map_entries("props")))
    joined = nodes.join(out, "node_id", "left")
    each = F.transform(F.coalesce("e", F.array().cast("array<struct<ord:bigint,dst:string,edge_type:string>>")), lambda x: F.struct(x["dst"].alias("dst"), x["edge_type"].alias("edge_type"), x["ord"].alias("ord")))
    return joined.select(F.lit(SCHEMA_VERSION).alias("version"), "node_id", "node_type", props.alias("props"), each.alias("edges"))


def to_json_lines(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))


def to_xml_lines(records: DataFrame, columns: list[str]) -> DataFrame:
    return records.select(F.to_xml(F.struct(*columns), {"rowTag": "node"}).alias("value"))


def load_json_lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Saved records back as rows; lines that do not parse give null records."""
    return lines.select(F.from_json("value", GRAPH).alias("r")).select("r.*")


def _cbor(value) -> bytes:
    def head(major: int, n: int) -> bytes:
        for limit, mark, code in ((24, None, None), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I"), (1 << 64, 27, ">Q")):
            if n < limit:
                return bytes([major << 5 | (n if mark is None else mark)]) + (struct.pack(code, n) if code else b"")
        raise OverflowError(n)

    if value is None or isinstance(value, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[value]
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return head(3, len(raw)) + raw
    if isinstance(value, (list, tuple)):
        return head(4, len(value)) + b"".join(map(_cbor, value))
    return head(5, len(value)) + b"".join(_cbor(k) + _cbor(v) for k, v in value.items())


def _uncbor(data: bytes, at: int = 0):
    first, at = data[at], at + 1
    major, low = first >> 5, first & 31
    if major == 7:
        if low == 27:
            return struct.unpack_from(">d", data, at)[0], at + 8
        return {20: False, 21: True, 22: None}[low], at
    if low >= 24:
        size = 1 << low - 24
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    else:
        n = low
    if major in (0, 1):
        return (n if major == 0 else -1 - n), at
    if major in (2, 3):
        raw = data[at : at + n]
        return (raw.decode() if major == 3 else raw), at + n
    items = []
    for _ in range(n * (2 if major == 5 else 1)):
        item, at = _uncbor(data, at)
        items.append(item)
    return (dict(zip(items[::2], items[1::2])) if major == 5 else items), at


@F.pandas_udf(T.BinaryType())
def json_to_cbor(lines: pd.Series) -> pd.Series:
    import json

    return lines.map(lambda s: None if s is None else _cbor(json.loads(s)))


@F.pandas_udf(T.StringType())
def cbor_to_json(blobs: pd.Series) -> pd.Series:
    import json

    return blobs.map(lambda b: None if b is None else json.dumps(_uncbor(bytes(b))[0], ensure_ascii=False, separators=(",", ":")))


@F.pandas_udf(T.StringType())
def json_to_yaml(lines: pd.Series) -> pd.Series:
    import json

    import yaml

    return lines.map(lambda s: None if s is None else yaml.safe_dump(json.loads(s), sort_keys=True, allow_unicode=True))


def report_text(risks: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, report): a summary line and a line for each finding, ordered."""
    lines = findings.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("[%s] %s", "severity", "rule"))), "\n").alias("lines"))
    head = F.format_string("score %d (%s)", "score", "level")
    return risks.join(lines, "doc_id").select("doc_id", F.concat_ws("\n", head, "lines").alias("report"))


def envelope(report: Column, at: Column) -> Column:
    return F.struct(F.lit("1.0").alias("report_format_version"), at.alias("generated_at"), report.alias("report"))


def migrate(records: DataFrame) -> DataFrame:
    """Records of schema 0.9.0 to 1.0.0: ids get their type as a suffix."""
    old = F.col("version") == "0.9.0"
    return records.withColumn("node_id", F.when(old, F.concat_ws(":", "node_id", "node_type")).otherwise(F.col("node_id"))).withColumn("version", F.lit(SCHEMA_VERSION))


def write_json(records: DataFrame, path: str, by: str | None = None) -> None:
    writer = records.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)




def _toml_text(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def report_toml(risks: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, report): a security report as TOML, its findings as an array of tables in order; texts without findings have none."""
    table = F.concat(F.lit("[[findings]]\nseverity = "), _toml_text(F.col("severity")), F.lit("\nrule = "), _toml_text(F.col("rule")))
    tables = findings.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(table)), "\n\n").alias("tables"))
    head = F.concat(F.lit("score = "), F.col("score").cast("string"), F.lit("\nlevel = "), _toml_text(F.col("level")), F.lit("\nis_safe = "), F.col("safe").cast("string"))
    return risks.join(tables, "doc_id", "left").select("doc_id", F.concat_ws("\n\n", head, "tables").alias("report"))


def diff_reports(changes: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, report): pages that changed (doc_id, page, change), counted and listed, below the similarity from ``totals`` (doc_id, n_pages).

    Pages that stayed the same are counted in ``n_pages`` alone.
    """
    differ = changes.where("change <> 'Same'")
    line = F.struct("page", F.format_string("- page %s: %s", F.col("page").cast("string"), "change").alias("line"))
    count = lambda name: F.count_if(F.col("change") == name).alias(name)
    by = differ.groupBy("doc_id").agg(count("Added"), count("Removed"), count("Modified"), F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    both = totals.join(by, "doc_id", "left").na.fill(0, ["Added", "Removed", "Modified"])
    n = F.col("Added") + F.col("Removed") + F.col("Modified")
    like = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - n / (F.col("n_pages") + 10)))
    head = F.format_string("similarity %.2f%%\nchanges %d\nadded %d\nremoved %d\nmodified %d", like * 100, n, "Added", "Removed", "Modified")
    return both.select("doc_id", F.concat_ws("\n", head, F.array_join("lines", "\n")).alias("report"))


#: JSON types of the types that have one.
JSON_TYPES = {T.StringType: "string", T.BooleanType: "boolean", T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer", T.FloatType: "number", T.DoubleType: "number", T.DecimalType: "number"}


def json_schema(kind: T.DataType, title: str | None = None) -> dict:
    """The draft-07 schema of what ``to_json_lines`` writes for a type: null fields are left out there and so not required here."""
    if isinstance(kind, T.StructType):
        out: dict = {"type": "object", "required": [f.name for f in kind if not f.nullable], "properties": {f.name: json_schema(f.dataType) for f in kind}}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType)}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    else:  # dates, times and bytes (base64) are strings
        out = {"type": JSON_TYPES.get(type(kind), "string")}
    return {"$schema": "http://json-schema.org/draft-07/schema#", "title": title, **out} if title else out
