"""Facts of forms, colour profiles, sounds, models, long-term validation data and inline images, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

#: Elements of a form template that hold scripts, and leading bytes of sounds and models.
SCRIPT_ELEMENTS = ["script", "event", "calculate", "validate", "execute", "exec", "init", "preSubmit", "postSubmit", "preOpen", "postOpen"]
SOUNDS = [("WAV", b"RIFF"), ("MP3", b"ID3"), ("OGG", b"OggS"), ("FLAC", b"fLaC")]
MODELS = [("U3D", b"U3D\x00"), ("PRC", b"PRC")]


def _number(data: Column, start: int, length: int) -> Column:
    return F.conv(F.hex(F.substring(data, start + 1, length)), 16, 10).cast("long")


def _tag(data: Column, start: int) -> Column:
    return F.trim(F.decode(F.substring(data, start + 1, 4), "ISO-8859-1"))


def profile_header(data: Column) -> Column:
    """Fields of a colour profile's 128-byte header; null if it is shorter or has no ``acsp`` mark."""
    fields = F.struct(
        _number(data, 0, 4).alias("size"),
        F.concat_ws(".", _number(data, 8, 1).cast("string"), F.shiftright(_number(data, 9, 1).cast("int"), 4).cast("string")).alias("version"),
        _tag(data, 12).alias("device_class"),
        _tag(data, 16).alias("color_space"),
        _tag(data, 20).alias("connection_space"),
    )
    return F.when((F.octet_length(data) >= 128) & (F.substring(data, 37, 4) == F.lit(b"acsp")), fields)


def leading_format(data: Column, known: list[tuple[str, bytes]]) -> Column:
    out = F.lit(None).cast("string")
    for name, magic in known:
        out = F.when(F.substring(data, 1, len(magic)) == F.lit(magic), name).otherwise(out)
    return out


def script_counts(templates: DataFrame) -> DataFrame:
    """(doc_id, n_elements, n_scripts) of form templates (doc_id, xml): all elements, and those that are or carry scripts."""
    opened = F.regexp_extract_all("xml", F.lit(r"<([A-Za-z][^\s/>]*(?:\s[^>]*)?)/?>"), 1)
    named = F.transform(opened, lambda e: F.regexp_extract(e, r"^(?:[^:\s]+:)?([^\s/]+)", 1))
    scripted = F.filter(opened, lambda e: F.regexp_extract(e, r"^(?:[^:\s]+:)?([^\s/]+)", 1).isin(*SCRIPT_ELEMENTS) | e.rlike(r'\s(?:runAt|script)="[^"]'))
    return templates.select("doc_id", F.size(named).cast("long").alias("n_elements"), F.size(scripted).cast("long").alias("n_scripts"))


def field_counts(fields: DataFrame) -> DataFrame:
    """(form, n_fields, n_leaves, n_signatures) of (form, field, parent, kind): the Kids closure from fields without a parent."""
    edges = fields.where("parent is not null").select(F.col("parent").alias("src"), F.col("field").alias("dst"))
    reached = graph.walk(edges, fields.where("parent is null").select(F.col("field").alias("node_id"))).select(F.col("node_id").alias("field")).distinct()
    inner = edges.select(F.col("src").alias("field")).distinct().withColumn("inner", F.lit(True))
    own = fields.join(reached, "field", "left_semi").join(inner, "field", "left")
    return own.groupBy("form").agg(F.count(F.lit(1)).alias("n_fields"), F.count_if(F.col("inner").isNull()).alias("n_leaves"), F.count_if(F.col("kind") == "Sig").alias("n_signatures"))


def validation_data(stores: DataFrame) -> DataFrame:
    """(doc_id, n_certs, n_ocsps, n_crls, has_any) of security stores (doc_id, value JSON)."""
    size = lambda key: F.coalesce(F.json_array_length(F.get_json_object("value", f"$.{key}")), F.lit(0)).cast("long")
    out = stores.select("doc_id", size("Certs").alias("n_certs"), size("OCSPs").alias("n_ocsps"), size("CRLs").alias("n_crls"))
    return out.withColumn("has_any", F.col("n_certs") + F.col("n_ocsps") + F.col("n_crls") > 0)


def inline_images(streams: DataFrame) -> DataFrame:
    """(doc_id, place, width, height, bits, space) of the inline images in content (doc_id, ops), abbreviations spelt out."""
    pattern = r"(?s)\bBI\b(.*?)\bID\b"
    heads = streams.select("doc_id", F.posexplode(F.regexp_extract_all("ops", F.lit(pattern), 1)).alias("place", "head"))
    entry = lambda *keys: F.regexp_extract("head", rf"/(?:{'|'.join(keys)})\s+/?(\w+)", 1)
    names = F.create_map(*(F.lit(x) for x in ("G", "DeviceGray", "RGB", "DeviceRGB", "CMYK", "DeviceCMYK", "I", "Indexed")))
    space = entry("CS", "ColorSpace")
    return heads.select("doc_id", "place", entry("W", "Width").cast("int").alias("width"), entry("H", "Height").cast("int").alias("height"), entry("BPC", "BitsPerComponent").cast("int").alias("bits"), F.coalesce(names[space], space).alias("space"))


def font_inventory(fonts: DataFrame) -> DataFrame:
    """(doc_id, name, subtype, encoding, embedded) of font dictionaries (doc_id, value JSON); subset prefixes are dropped."""
    entry = lambda key, other: F.regexp_replace(F.coalesce(F.get_json_object("value", f"$.{key}"), F.lit(other)), "^/", "")
    return fonts.select("doc_id", F.regexp_replace(entry("BaseFont", "Unknown"), "^[A-Z]{6}\\+", "").alias("name"), entry("Subtype", "Type1").alias("subtype"), entry("Encoding", "StandardEncoding").alias("encoding"), F.col("value").rlike("FontFile[23]?").alias("embedded"))


def template_packets(parts: DataFrame) -> DataFrame:
    """(doc_id, ord, name, root, n_bytes) of the named parts of form templates (doc_id, ord, name, xml): empty ones are none, a part without a name is a packet."""
    root = F.regexp_extract("xml", r"<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)", 1)
    return parts.where("length(xml) > 0").select("doc_id", "ord", F.coalesce("name", F.lit("packet")).alias("name"), root.alias("root"), F.octet_length("xml").cast("long").alias("n_bytes"))


def hybrid_forms(packets: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id) of documents that have both template packets and form fields of the older kind."""
    return packets.select("doc_id").distinct().join(fields.select("doc_id"), "doc_id", "left_semi")
