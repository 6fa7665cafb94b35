"""Conformance rules, indicators and facts over parsed documents, each rule set folded into one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import pdf
from ..sources.shared import stored, together
from . import graph

#: Code, severity.
CODES = {
    "CATALOG_MISSING": "Critical",
    "MULTIPLE_CATALOGS": "Error",
    "TRAILER_ROOT_MISSING": "Error",
    "TRAILER_SIZE_MISSING": "Error",
    "PAGES_TREE_MISSING": "Critical",
    "PAGES_NO_KIDS": "Error",
    "PAGES_COUNT_MISMATCH": "Warning",
    "CATALOG_PAGES_MISSING": "Error",
    "TRAILER_ID_MISSING": "Warning",
    "ENCRYPTION_NOT_ALLOWED": "Error",
    "JAVASCRIPT_NOT_ALLOWED": "Error",
    "EXTERNAL_REFERENCE_NOT_ALLOWED": "Error",
    "EMBEDDED_FILE_NOT_ALLOWED": "Error",
    "FONT_NOT_EMBEDDED": "Error",
    "NO_TAGGED_STRUCTURE": "Error",
    "TRANSPARENCY_NOT_ALLOWED": "Error",
    "TRIM_BOX_MISSING": "Warning",
    "LANG_MISSING": "Error",
    "OUTPUT_INTENTS_MISSING": "Error",
    "ALT_TEXT_MISSING": "Error",
    "STRUCT_TREE_ROOT_MISSING": "Error",
    "ACCESSIBILITY_METADATA_MISSING": "Error",
    "PAGES_NO_COUNT": "Error",
    "PAGES_COUNT_MISSING": "Warning",
    "CATALOG_VERSION_MISSING": "Warning",
    "CATALOG_VERSION_MISMATCH": "Warning",
    "XREF_MISSING": "Error",
    "TRAILER_SIZE_INCONSISTENT": "Warning",
    "TRAILER_ID_INVALID": "Warning",
    "METADATA_NOT_STREAM": "Warning",
    "METADATA_SUBTYPE_INVALID": "Warning",
    "FONT_ENCODING_MISSING": "Warning",
    "DEVICE_RGB_DISALLOWED": "Error",
    "IMAGE_DEVICE_RGB_DISALLOWED": "Error",
    "LANG_EMPTY": "Error",
    "STRUCT_ELEM_MISSING": "Error",
    "METADATA_STREAM_INVALID": "Error",
    "XMP_PACKET_MISSING": "Warning",
    "READING_ORDER_INCOMPLETE": "Error",
}
#: Rules of each profile.
PROFILES = {
    "PDF-2.0": [
        "CATALOG_MISSING", "MULTIPLE_CATALOGS", "TRAILER_ROOT_MISSING", "TRAILER_SIZE_MISSING", "PAGES_TREE_MISSING", "PAGES_NO_KIDS", "PAGES_NO_COUNT", "PAGES_COUNT_MISMATCH", "PAGES_COUNT_MISSING", "CATALOG_PAGES_MISSING",
        "TRAILER_ID_MISSING", "TRAILER_ID_INVALID", "CATALOG_VERSION_MISSING", "CATALOG_VERSION_MISMATCH", "XREF_MISSING", "TRAILER_SIZE_INCONSISTENT", "METADATA_NOT_STREAM", "METADATA_SUBTYPE_INVALID", "FONT_ENCODING_MISSING",
    ],
    "PDF/A-1b": ["CATALOG_MISSING", "PAGES_TREE_MISSING", "ENCRYPTION_NOT_ALLOWED", "JAVASCRIPT_NOT_ALLOWED", "EXTERNAL_REFERENCE_NOT_ALLOWED", "FONT_NOT_EMBEDDED", "TRANSPARENCY_NOT_ALLOWED", "EMBEDDED_FILE_NOT_ALLOWED"],
    "PDF/X": ["CATALOG_MISSING", "PAGES_TREE_MISSING", "ENCRYPTION_NOT_ALLOWED", "JAVASCRIPT_NOT_ALLOWED", "FONT_NOT_EMBEDDED", "OUTPUT_INTENTS_MISSING", "DEVICE_RGB_DISALLOWED", "IMAGE_DEVICE_RGB_DISALLOWED", "TRIM_BOX_MISSING"],
    "PDF/UA": [
        "CATALOG_MISSING", "PAGES_TREE_MISSING", "NO_TAGGED_STRUCTURE", "LANG_MISSING", "LANG_EMPTY", "STRUCT_ELEM_MISSING", "ALT_TEXT_MISSING", "STRUCT_TREE_ROOT_MISSING", "READING_ORDER_INCOMPLETE",
        "ACCESSIBILITY_METADATA_MISSING", "METADATA_STREAM_INVALID", "XMP_PACKET_MISSING",
    ],
}

#: The least version that a profile supports.
LEAST = {"PDF-2.0": 1.4, "PDF/A-1b": 1.4, "PDF/X": 1.3, "PDF/UA": 1.7}


def _entry(name: str) -> Column:
    return F.get_json_object("value", f"$.{name}")


def document_facts(rows: DataFrame) -> DataFrame:
    """One row a document: counts over its objects that all rules draw on, and its own facts, in one aggregation over one parse.

    What the catalog refers to is looked up among the ids of the few objects that can be
    it: metadata streams, and dictionaries that have both parts of a structure tree.
    """
    whole = pdf.type_of(F.col("value"), F.col("stream"))
    nodes = rows.where("kind in ('doc', 'object')").withColumn("node_type", F.when(F.col("kind") == "object", whole))
    is_type = lambda *names: F.coalesce(F.col("node_type").isin(*names), F.lit(False))
    catalog, inner = is_type("Catalog"), F.col("kind") == "object"
    ident, stream = F.concat_ws(" ", "obj", "gen"), F.col("stream").isNotNull()
    xml = stream & (_entry("Subtype") == "/XML")
    ids = lambda cond: F.collect_set(F.when(F.coalesce(inner & cond, F.lit(False)), ident))
    rgb = lambda path: F.coalesce(F.contains(_entry(path), F.lit("/DeviceRGB")), F.lit(False))
    out = nodes.groupBy("doc_id").agg(
        F.count_if(inner).alias("n_objects"),
        F.count_if(catalog).alias("n_catalogs"),
        F.count_if(is_type("Page")).alias("n_pages"),
        F.count_if(is_type("Pages")).alias("n_page_trees"),
        F.count_if(is_type("Pages") & _entry("Kids").isNull()).alias("n_without_kids"),
        F.max(F.when(is_type("Pages"), _entry("Count").cast("long"))).alias("count"),
        F.count_if(is_type("JavaScriptAction")).alias("n_scripts"),
        F.count_if(is_type("URIAction", "LaunchAction")).alias("n_external"),
        F.count_if(is_type("Filespec", "EmbeddedFile")).alias("n_files"),
        F.count_if(is_type("Font") & ~F.col("value").rlike("FontFile")).alias("n_bare_fonts"),
        F.count_if(is_type("Page") & (_entry("Group.S") == "/Transparency")).alias("n_transparent"),
        F.count_if(is_type("Page") & _entry("TrimBox").isNull()).alias("n_untrimmed"),
        F.count_if(inner & _entry("S").isin("/Figure", "/Formula", "/Table") & _entry("Alt").isNull()).alias("n_without_alt"),
        F.count_if(is_type("Pages") & _entry("Count").isNull()).alias("n_without_count"),
        F.count_if(is_type("Page") & rgb("Resources.ColorSpace")).alias("n_rgb_pages"),
        F.count_if(is_type("Image") & rgb("ColorSpace")).alias("n_rgb_images"),
        F.count_if(is_type("Font") & _entry("Encoding").isNull() & _entry("ToUnicode").isNull()).alias("n_unencoded_fonts"),
        F.count_if(inner & (_entry("Type") == "/StructElem")).alias("n_elements"),
        F.max(F.when(inner, F.col("obj"))).alias("last_object"),
        F.max(F.when(catalog, _entry("Version"))).alias("catalog_version"),
        F.max(F.when(catalog, _entry("Lang"))).alias("lang"),
        F.max(F.when(catalog, _entry("Metadata.R"))).alias("metadata"),
        F.max(F.when(catalog, _entry("StructTreeRoot.R"))).alias("tree"),
        F.bool_or(catalog & _entry("StructTreeRoot.K").isNotNull() & _entry("StructTreeRoot.ParentTree").isNotNull()).alias("whole_tree"),
        ids(_entry("K").isNotNull() & _entry("ParentTree").isNotNull()).alias("trees"),
        ids(xml | (stream & (_entry("Type") == "/Metadata"))).alias("metadata_streams"),
        ids(xml).alias("xml_subtypes"),
        ids(xml & F.coalesce(_entry("Type") == "/Metadata", F.lit(True))).alias("xml_streams"),
        ids(xml & F.contains(F.decode("stream", "ISO-8859-1"), F.lit("x:xmpmeta"))).alias("packets"),
        F.bool_or(catalog & _entry("Pages").isNotNull()).alias("has_pages"),
        F.bool_or(catalog & _entry("OpenAction").isNotNull()).alias("has_open_action"),
        F.bool_or(catalog & _entry("MarkInfo").isNotNull()).alias("tagged"),
        F.bool_or(catalog & _entry("Lang").isNotNull()).alias("has_lang"),
        F.bool_or(catalog & _entry("OutputIntents").isNotNull()).alias("has_intents"),
        F.bool_or(catalog & _entry("StructTreeRoot").isNotNull()).alias("has_structure"),
        F.bool_or(catalog & _entry("Metadata").isNotNull()).alias("has_metadata"),
        F.bool_or(F.coalesce(F.decode("stream", "ISO-8859-1").rlike(r"(?s)\bBT\b[^\x00]*?\x00.*?\bET\b"), F.lit(False))).alias("has_nulls"),
        F.max(F.when(F.col("kind") == "doc", F.col("value"))).alias("doc"),
    )
    return out.select("*", *pdf.document_facts(F.col("doc"))).drop("doc")


def _rules(profile: str) -> Column:
    """The rules of ``profile`` that a row of ``document_facts`` breaks."""
    n = lambda name: F.coalesce(name, F.lit(0))
    lacks = lambda name: (~F.coalesce(name, F.lit(False))).cast("long")
    within = lambda name, sets: F.coalesce(F.array_contains(sets, F.col(name)), F.lit(False))
    named, of_two = F.coalesce("has_metadata", F.lit(False)), F.coalesce(F.split("version", r"\.")[0].cast("int") >= 2, F.lit(False))
    is_two = F.coalesce(F.col("catalog_version").isin("/2.0", "(2.0"), F.lit(False))
    xml = within("metadata", "xml_streams")
    whole = within("tree", "trees") | F.coalesce("whole_tree", F.lit(False))
    counts = {
        "CATALOG_MISSING": (n("n_catalogs") == 0).cast("long"),
        "MULTIPLE_CATALOGS": (n("n_catalogs") > 1).cast("long"),
        "TRAILER_ROOT_MISSING": F.col("root").isNull().cast("long"),
        "TRAILER_SIZE_MISSING": F.col("trailer_size").isNull().cast("long"),
        "PAGES_TREE_MISSING": (n("n_page_trees") == 0).cast("long"),
        "PAGES_NO_KIDS": n("n_without_kids"),
        "PAGES_COUNT_MISMATCH": F.coalesce(F.col("count") != n("n_pages"), F.lit(False)).cast("long"),
        "CATALOG_PAGES_MISSING": lacks("has_pages"),
        "TRAILER_ID_MISSING": lacks("has_id"),
        "ENCRYPTION_NOT_ALLOWED": F.col("encrypted").cast("long"),
        "JAVASCRIPT_NOT_ALLOWED": n("n_scripts"),
        "EXTERNAL_REFERENCE_NOT_ALLOWED": n("n_external"),
        "EMBEDDED_FILE_NOT_ALLOWED": n("n_files"),
        "FONT_NOT_EMBEDDED": n("n_bare_fonts"),
        "NO_TAGGED_STRUCTURE": lacks("tagged"),
        "TRANSPARENCY_NOT_ALLOWED": n("n_transparent"),
        "TRIM_BOX_MISSING": n("n_untrimmed"),
        "LANG_MISSING": lacks("has_lang"),
        "OUTPUT_INTENTS_MISSING": lacks("has_intents"),
        "ALT_TEXT_MISSING": n("n_without_alt"),
        "STRUCT_TREE_ROOT_MISSING": lacks("has_structure"),
        "ACCESSIBILITY_METADATA_MISSING": lacks("has_metadata"),
        "PAGES_NO_COUNT": n("n_without_count"),
        "PAGES_COUNT_MISSING": F.col("count").isNull().cast("long"),
        "CATALOG_VERSION_MISSING": (of_two & ~is_two).cast("long"),
        "CATALOG_VERSION_MISMATCH": (~of_two & is_two).cast("long"),
        "XREF_MISSING": (n("entries") == 0).cast("long"),
        "TRAILER_SIZE_INCONSISTENT": F.coalesce(F.col("trailer_size") < n("last_object") + 1, F.lit(False)).cast("long"),
        "TRAILER_ID_INVALID": (F.col("has_id") & ~F.col("two_ids")).cast("long"),
        "METADATA_NOT_STREAM": (named & ~within("metadata", "metadata_streams")).cast("long"),
        "METADATA_SUBTYPE_INVALID": (within("metadata", "metadata_streams") & ~within("metadata", "xml_subtypes")).cast("long"),
        "FONT_ENCODING_MISSING": n("n_unencoded_fonts"),
        "DEVICE_RGB_DISALLOWED": n("n_rgb_pages"),
        "IMAGE_DEVICE_RGB_DISALLOWED": n("n_rgb_images"),
        "LANG_EMPTY": F.coalesce(F.col("lang") == "(", F.lit(False)).cast("long"),
        "STRUCT_ELEM_MISSING": (n("n_elements") == 0).cast("long"),
        "METADATA_STREAM_INVALID": (named & ~xml).cast("long"),
        "XMP_PACKET_MISSING": (xml & ~within("metadata", "packets")).cast("long"),
        "READING_ORDER_INCOMPLETE": (F.coalesce("has_structure", F.lit(False)) & ~whole).cast("long"),
    }
    found = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(CODES[c]).alias("severity"), counts[c].alias("n")) for c in PROFILES[profile]))
    return F.filter(found, lambda x: x["n"] > 0)


def issues(rows: DataFrame, profile: str) -> DataFrame:
    """(doc_id, code, severity, n) of the rules of ``profile`` that a document breaks."""
    return document_facts(rows).select("doc_id", F.explode(_rules(profile)).alias("f")).select("doc_id", "f.*")


def report(rows: DataFrame, profile: str) -> DataFrame:
    """(doc_id, failed, passed, is_valid): rules broken and kept; valid without Error or Critical."""
    out = document_facts(rows).select("doc_id", _rules(profile).alias("broken"))
    failed = F.size("broken").cast("long")
    grave = F.exists("broken", lambda x: x["severity"].isin("Error", "Critical"))
    return out.select("doc_id", failed.alias("failed"), (F.lit(len(PROFILES[profile])) - failed).cast("long").alias("passed"), (~grave).alias("is_valid"))


def all_reports(rows: DataFrame, least: dict[str, float] = LEAST) -> DataFrame:
    """(doc_id, profile, failed, passed, is_valid) by every profile whose least version a document has, in one pass over it."""
    one = lambda p, fit: F.when(fit, F.struct(F.lit(p).alias("profile"), _rules(p).alias("broken"), F.lit(len(PROFILES[p])).alias("n")))
    each = document_facts(rows).select("doc_id", F.explode(F.array_compact(F.array(*(one(p, F.col("version").cast("double") >= v) for p, v in least.items())))).alias("r"))
    failed = F.size("r.broken").cast("long")
    grave = F.exists("r.broken", lambda x: x["severity"].isin("Error", "Critical"))
    return each.select("doc_id", "r.profile", failed.alias("failed"), (F.col("r.n") - failed).cast("long").alias("passed"), (~grave).alias("is_valid"))


def indicators(rows: DataFrame) -> DataFrame:
    """(doc_id, check, status) of what a document can do by itself; a single pass row where nothing was found."""
    facts = document_facts(rows)
    checks = [("JavaScriptAction", "Fail", F.coalesce("n_scripts", F.lit(0)) > 0), ("ExternalAction", "Warning", F.coalesce("n_external", F.lit(0)) > 0), ("EmbeddedFile", "Warning", F.coalesce("n_files", F.lit(0)) > 0), ("OpenAction", "Warning", F.coalesce("has_open_action", F.lit(False))), ("TrailingData", "Warning", F.col("has_trailing")), ("RevisionHistory", "Warning", F.col("revisions") > 1)]
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(name).alias("check"), F.lit(status).alias("status"))) for name, status, c in checks)), lambda x: x.isNotNull())
    none = F.array(F.struct(F.lit("Security").alias("check"), F.lit("Pass").alias("status")))
    return facts.select("doc_id", F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("f")).select("doc_id", "f.*")


def health(rows: DataFrame) -> DataFrame:
    """(doc_id, integrity, score, level): the share of integrity checks kept (end mark, no null bytes in text, objects found for those
    declared), less what structure is missing and what is corrupt: missing objects are an error, mostly broken references critical."""
    from ..functions.rules import health_level

    nodes = pdf.objects(rows).select("doc_id", "node_id", "value")
    refs = pdf.object_references(nodes).join(nodes.select("doc_id", F.col("node_id").alias("dst"), F.lit(1).alias("there")), ["doc_id", "dst"], "left")
    refs = refs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("there").isNull()).alias("n_broken"))
    facts = document_facts(rows).join(refs, "doc_id", "left")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    missing = (F.col("declared") > 0) & (F.col("n_objects") < F.floor(F.col("declared") / 2))
    integrity = 1 - (one(~F.col("ends")) + one(F.col("has_nulls")) + one(missing)) / 3
    structure = one(~F.col("header")) * 2 + one(F.col("n_catalogs") == 0) * 3 + one(F.col("n_page_trees") == 0) * 2 + one(~F.col("has_xref")) + one(~F.col("has_trailer"))
    corrupt = one(F.col("n_broken") > F.floor(F.col("n_refs") / 2)) * 2 + one(missing)
    score = integrity - (structure + corrupt) / 10
    return facts.select("doc_id", integrity.cast("double").alias("integrity"), score.cast("double").alias("score"), health_level(score).alias("level"))


def content_operators(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, place, op): operators of content streams in order, operands left out."""
    # possessive groups loop; others recurse once a repetition and end the stack on a long string
    inner = r"[^\\()]++|\\."
    plain = F.regexp_replace(F.decode("stream", "ISO-8859-1"), rf"(?s)<[0-9A-Fa-f\s]*+>|\((?:{inner}|\((?:{inner})*+\))*+\)|/\S+|\[|\]", " ")
    ops = F.filter(F.split(F.trim(plain), r"\s+"), lambda t: t.rlike(r"^[A-Za-z'\"*][A-Za-z0-9'\"*]*$"))
    return nodes.where((F.col("node_type") == "ContentStream") & F.col("stream").isNotNull()).select("doc_id", "node_id", F.posexplode(ops).alias("place", "op"))


#: The fonts that every reader has.
STANDARD_FONTS = ["Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic", "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique", "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique", "Symbol", "ZapfDingbats"]
#: Codes of the archive validator, their severities; the last ones only where it is strict.
ARCHIVE_CODES = {
    "PDF_A_VERSION": "Error", "PDF_A_COLOR_SPACE": "Error", "PDF_A_FONT_EMBEDDING": "Error", "PDF_A_FONT_ENCODING": "Error", "PDF_A_MULTIMEDIA": "Error", "PDF_A_JAVASCRIPT": "Error", "PDF_A_ANNOTATION_TYPE": "Error",
    "PDF_A_ANNOTATION_APPEARANCE": "Warning", "PDF_A_XFA": "Error", "PDF_A_ENCRYPTION": "Error", "PDF_A_XMP_METADATA": "Error", "PDF_A_TRANSPARENCY": "Error", "PDF_A_EMBEDDED_FILES": "Error", "PDF_A_XREF_FORMAT": "Warning",
    "PDF_A_OUTPUT_INTENT": "Warning", "PDF_A_LZW_DECODE": "Warning", "PDF_A_METADATA_SYNC": "Warning",
}
STRICT_ONLY = ["PDF_A_OUTPUT_INTENT", "PDF_A_LZW_DECODE", "PDF_A_METADATA_SYNC"]


def archive_issues(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, code, severity, n) by the archive validator, over parsed rows, in one aggregation.

    It looks at dictionaries as they are written: resources, forms and actions that lie
    behind a reference are judged where they stand as objects of their own.
    """
    node_type = F.when(F.col("kind") == "object", pdf.type_of(F.col("value"), F.col("stream")))
    nodes = rows.where("kind in ('doc', 'object')").withColumn("node_type", node_type)
    is_ = lambda *names: F.coalesce(F.col("node_type").isin(*names), F.lit(False))
    has = lambda name: _entry(name).isNotNull()
    sub = F.coalesce(F.substring(_entry("Subtype"), 2, 100), F.lit(""))
    inner, device = F.col("kind") == "object", ("/DeviceRGB", "/DeviceGray", "/DeviceCMYK")
    spaces = F.coalesce(F.map_values(F.from_json(_entry("Resources.ColorSpace"), "map<string,string>")), F.array().cast("array<string>"))
    font, annotation, catalog = is_("Font"), is_("Annotation"), is_("Catalog")
    embedded = has("FontFile") | has("FontFile2") | has("FontFile3") | (F.coalesce(F.json_array_length(_entry("DescendantFonts")), F.lit(0)) > 0)
    bare = sub.isin("Type1", "MMType1", "TrueType") & ~has("Encoding") & ~F.coalesce(F.substring(_entry("BaseFont"), 2, 100).isin(STANDARD_FONTS), F.lit(False))
    script = F.coalesce(_entry("S") == "/JavaScript", F.lit(False))
    group = F.coalesce((_entry("Type") == "/Group") & (_entry("S") == "/Transparency"), F.lit(False))
    clear = inner & F.col("value").startswith("{") & (has("BM") | has("CA") | has("ca") | has("SMask"))
    any_script = (catalog & (has("Names.JavaScript") | F.coalesce(_entry("OpenAction.S") == "/JavaScript", F.lit(False)))) | (is_("Annotation", "Action", "JavaScriptAction") & script & F.coalesce(_entry("Type").isin("/Action", "/Annot"), F.lit(False)))
    filters = F.coalesce(_entry("Filter"), F.lit(""))
    lzw = is_("Image") & ((filters == "/LZWDecode") | F.contains(filters, F.lit('"/LZWDecode"')))
    facts = nodes.groupBy("doc_id").agg(
        F.max(((is_("Image") & F.coalesce(_entry("ColorSpace").isin(*device), F.lit(False))) | (is_("Page") & F.exists(spaces, lambda s: s.isin(*device)))).cast("int")).alias("device"),
        F.coalesce(F.max((catalog & has("OutputIntents")).cast("int")), F.lit(0)).alias("intents"),
        F.count_if(font & ~embedded).alias("fonts"),
        F.count_if(font & (sub != "Type3") & bare).alias("encodings"),
        F.max((annotation & sub.isin("Movie", "Sound", "Screen", "RichMedia")).cast("int")).alias("media"),
        (F.count_if(is_("JavaScriptAction")) + F.max(any_script.cast("int"))).alias("scripts"),
        F.count_if(annotation & sub.isin("Movie", "Sound", "FileAttachment")).alias("kinds"),
        F.count_if(annotation & (sub != "") & ~has("AP") & (sub != "Popup")).alias("looks"),
        F.max((catalog & has("AcroForm.XFA")).cast("int")).alias("xfa"),
        F.coalesce(F.max((catalog & has("Metadata")).cast("int")), F.lit(0)).alias("metadata"),
        (F.count_if(clear) + F.count_if(inner & group) + F.count_if(inner & F.coalesce(_entry("Group.S") == "/Transparency", F.lit(False)))).alias("transparent"),
        F.count_if(is_("Filespec", "EmbeddedFile")).alias("files"),
        F.count_if(is_("XRef")).alias("streams"),
        F.count_if(lzw).alias("lzw"),
        F.max(F.when(F.col("kind") == "doc", F.col("value"))).alias("doc"),
    )
    whole = facts.select("*", *pdf.document_facts(F.col("doc"))).drop("doc")
    n, one = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long"), lambda c: F.coalesce(c, F.lit(False)).cast("long")
    version = F.split("version", r"\.")
    counts = {
        "PDF_A_VERSION": one((version[0].cast("int") != 1) | (version[1].cast("int") > 4)),
        "PDF_A_COLOR_SPACE": one((n("device") == 1) & (n("intents") == 0)),
        "PDF_A_FONT_EMBEDDING": n("fonts"),
        "PDF_A_FONT_ENCODING": n("encodings"),
        "PDF_A_MULTIMEDIA": n("media"),
        "PDF_A_JAVASCRIPT": n("scripts"),
        "PDF_A_ANNOTATION_TYPE": n("kinds"),
        "PDF_A_ANNOTATION_APPEARANCE": n("looks"),
        "PDF_A_XFA": n("xfa"),
        "PDF_A_ENCRYPTION": one(F.col("encrypted")),
        "PDF_A_XMP_METADATA": one(n("metadata") == 0),
        "PDF_A_TRANSPARENCY": n("transparent"),
        "PDF_A_EMBEDDED_FILES": one(n("files") > 0),
        "PDF_A_XREF_FORMAT": one((n("streams") > 0) & F.col("has_trailer")),
        "PDF_A_OUTPUT_INTENT": one(n("intents") == 0),
        "PDF_A_LZW_DECODE": n("lzw"),
        "PDF_A_METADATA_SYNC": F.lit(1).cast("long"),
    }
    found = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), counts[c].alias("n")) for c, s in ARCHIVE_CODES.items() if strict or c not in STRICT_ONLY))
    return whole.select("doc_id", F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("f")).select("doc_id", "f.*")


#: Codes about what refers to what.
LINK_CODES = {"CYCLIC_STRUCTURE": "Error", "TOUNICODE_NOT_STREAM": "Warning", "STRUCT_TREE_ROOT_INVALID": "Error"}


def link_issues(objects: DataFrame) -> DataFrame:
    """(doc_id, code, severity, n) of stored ``objects``: documents whose links lead back to where they come from, fonts whose map is no stream, structure trees that are no dictionary.

    Links are those of ``pdf.typed_edges`` that lead down: a reference to a parent or to
    something aside closes no cycle. A reference to nothing is no map and no tree.
    """
    down = pdf.typed_edges(objects).where("edge_type not in ('Parent', 'Reference')")
    whole = lambda c: F.concat_ws("|", F.col("doc_id"), F.col(c))
    # what is left of an edge table once all that ends somewhere is peeled off lies on a cycle or leads into one
    left = graph.cyclic(down.select(whole("src").alias("src"), whole("dst").alias("dst")).distinct())
    cycles = left.select(F.substring_index("src", "|", 1).cast("long").alias("doc_id")).distinct().select("doc_id", F.lit("CYCLIC_STRUCTURE").alias("code"), F.lit(1).cast("long").alias("n"))
    ref = lambda name: F.get_json_object("value", f"$.{name}.R")
    there = objects.select("doc_id", F.col("node_id").alias("to"), F.col("stream").isNotNull().alias("is_stream"), (F.col("value").startswith("{") & F.col("stream").isNull()).alias("is_dict"))
    maps = objects.where("node_type = 'Font'").select("doc_id", ref("ToUnicode").alias("to")).where("to is not null").join(there, ["doc_id", "to"]).where("not is_stream")
    maps = maps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit("TOUNICODE_NOT_STREAM").alias("code"), "n")
    roots = objects.where("node_type = 'Catalog'").select("doc_id", F.get_json_object("value", "$.StructTreeRoot").alias("given"), ref("StructTreeRoot").alias("to")).where("given is not null")
    wrong = roots.join(there, ["doc_id", "to"], "left").where(F.when(F.col("to").isNull(), ~F.col("given").startswith("{")).otherwise(~F.coalesce("is_dict", F.lit(False))))
    trees = wrong.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit("STRUCT_TREE_ROOT_INVALID").alias("code"), "n")
    table = F.create_map(*(F.lit(x) for kv in LINK_CODES.items() for x in kv))
    return cycles.unionByName(maps).unionByName(trees).select("doc_id", "code", table[F.col("code")].alias("severity"), "n")


#: The trees of a name dictionary.
NAME_TREES = ["Dests", "EmbeddedFiles", "JavaScript", "Pages", "Templates", "AlternatePresentations", "Renditions"]


def _tree_rows(objects: DataFrame, roots: DataFrame, entries: str) -> DataFrame:
    """(doc_id, tree, key, value) below ``roots`` (doc_id, tree, node_id or null, value): a level of all trees at a time, a node once a tree."""
    held = objects.select("doc_id", "node_id", "value")
    level, levels = roots, []
    while True:
        level = stored(level, "trees")
        levels.append(level)
        if level.isEmpty():
            break
        kids = level.select("doc_id", "tree", F.explode(F.regexp_extract_all(F.get_json_object("value", "$.Kids"), F.lit(r'"R":\s*"(\d+ \d+)"'), 1)).alias("node_id")).distinct()
        seen = together(levels).select("doc_id", "tree", "node_id").where("node_id is not null")
        level = kids.join(seen, ["doc_id", "tree", "node_id"], "left_anti").join(held, ["doc_id", "node_id"]).select(*roots.columns)
    pairs = together(levels).select("doc_id", "tree", F.from_json(F.get_json_object("value", f"$.{entries}"), "array<string>").alias("a"))
    each = pairs.where("size(a) > 1").select("doc_id", "tree", "a", F.explode(F.sequence(F.lit(0), F.floor(F.size("a") / 2).cast("int") * 2 - 2, F.lit(2))).alias("i"))
    return each.select("doc_id", "tree", F.get("a", F.col("i")).alias("key"), F.get("a", F.col("i") + 1).alias("value"))


def _roots(objects: DataFrame, named: DataFrame) -> DataFrame:
    """``named`` (doc_id, tree, given) with the node behind ``given`` or its own dictionary."""
    to = F.get_json_object("given", "$.R")
    held = objects.select("doc_id", F.col("node_id").alias("to"), F.col("value").alias("behind"))
    return named.withColumn("to", to).join(held, ["doc_id", "to"], "left").select("doc_id", "tree", F.col("to").alias("node_id"), F.coalesce("behind", F.when(F.col("to").isNull(), F.col("given"))).alias("value")).where("value is not null")


def name_trees(objects: DataFrame) -> DataFrame:
    """(doc_id, tree, key, value JSON) of all seven trees of every catalog's name dictionary, each direct or behind references; cycles end."""
    catalogs = objects.where("node_type = 'Catalog'").select("doc_id", F.lit("Names").alias("tree"), F.get_json_object("value", "$.Names").alias("given")).where("given is not null")
    names = _roots(objects, catalogs)
    each = names.select("doc_id", F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), F.get_json_object("value", f"$.{t}").alias("given")) for t in NAME_TREES))).alias("t")).select("doc_id", "t.*").where("given is not null")
    found = _tree_rows(objects, _roots(objects, each), "Names")
    return found.select("doc_id", "tree", F.regexp_replace("key", r"^\(", "").alias("key"), "value")


def number_trees(objects: DataFrame) -> DataFrame:
    """(doc_id, tree, key, value JSON) of every catalog's page labels and its structure tree's parent tree."""
    catalogs = objects.where("node_type = 'Catalog'")
    labels = catalogs.select("doc_id", F.lit("PageLabels").alias("tree"), F.get_json_object("value", "$.PageLabels").alias("given")).where("given is not null")
    tops = catalogs.select("doc_id", F.lit("StructTreeRoot").alias("tree"), F.get_json_object("value", "$.StructTreeRoot").alias("given")).where("given is not null")
    parents = _roots(objects, tops).select("doc_id", F.lit("ParentTree").alias("tree"), F.get_json_object("value", "$.ParentTree").alias("given")).where("given is not null")
    found = _tree_rows(objects, _roots(objects, labels.unionByName(parents)), "Nums")
    return found.select("doc_id", "tree", F.col("key").try_cast("long").alias("key"), "value").where("key is not null")
