"""What a document's makers, signatures, states and damage say: profiles, statistics, built-in analyses and repairs.

Dictionaries come as the JSON the reader gives: names begin with "/", strings with "(",
references are ``{"R": "number generation"}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

#: A maker, and what its producer or creator entry contains.
MAKERS = {"Adobe": ["adobe"], "Apple": ["apple", "quartz", "mac os x"], "MuPDF": ["mupdf"], "Ghostscript": ["ghostscript"]}
#: Signature types that belong to the baseline profile.
BASELINE = ["adbe.pkcs7.detached", "adbe.pkcs7.sha1", "adbe.x509.rsa_sha1"]
VERDICTS = {"valid": "Pass", "invalid": "Fail", "unknown": "Warning"}
DIGESTS = {"SHA-1": 160, "SHA-256": 256, "SHA-384": 384, "SHA-512": 512}
DEVICE_SPACES = ["DeviceGray", "DeviceRGB", "DeviceCMYK"]
ARRAY_SPACES = ["ICCBased", "CalGray", "CalRGB", "Lab", "Separation", "DeviceN", "Indexed", "Pattern"]
#: Entry of a graphics state, its property and the kind of value that counts.
STATES = {
    "LW": ("line_width", "real"), "LC": ("line_cap", "integer"), "LJ": ("line_join", "integer"), "ML": ("miter_limit", "number"),
    "RI": ("rendering_intent", "name"), "OP": ("overprint", "boolean"), "op": ("overprint_fill", "boolean"), "OPM": ("overprint_mode", "integer"),
    "FL": ("flatness", "number"), "SM": ("smoothness", "number"), "TK": ("text_knockout", "boolean"),
    "CA": ("alpha_stroke", "number"), "ca": ("alpha_fill", "number"), "AIS": ("alpha_is_shape", "boolean"),
}
KINDS = {"real": r"^-?\d+\.\d+(E-?\d+)?$", "integer": r"^-?\d+$", "number": r"^-?\d+(\.\d+(E-?\d+)?)?$", "boolean": "^(true|false)$", "name": "^/"}
TABLE_TYPES, LIST_TYPES, FORM_TYPES = ["Table", "THead", "TBody", "TFoot", "TR", "TH", "TD"], ["L", "LI", "Lbl", "LBody"], ["Form", "Widget"]
#: Repairs, their priority, and the ones of each level.
PRIORITIES = {"BasicStructure": 90, "StructureRepair": 85, "XRefRebuild": 80, "DataRecovery": 75, "Reference": 70, "StreamRepair": 70, "Stream": 60, "Encoding": 40, "Heuristic": 30, "FuzzyMatching": 20, "Experimental": 10}
_MODERATE = ["BasicStructure", "StructureRepair", "XRefRebuild", "Reference", "Stream", "StreamRepair", "DataRecovery", "Encoding"]
LEVELS = {
    "Conservative": ["BasicStructure", "Reference", "StructureRepair"],
    "Moderate": _MODERATE,
    "Aggressive": [*_MODERATE, "Heuristic", "FuzzyMatching"],
    "Experimental": [*_MODERATE, "Heuristic", "FuzzyMatching", "Experimental"],
}
#: Misspelt keywords.
TYPOS = {"obje": "obj", "endobje": "endobj", "stram": "stream", "endstram": "endstream"}
#: Keywords that a word with one wrong character stands for.
KEYWORDS = ["obj", "endobj", "stream", "endstream", "xref", "trailer", "startxref", "Type", "Catalog", "Pages", "Page", "Font"]


def _entry(name: str, value: str = "value") -> Column:
    return F.get_json_object(value, f"$.{name}")


def producer_quirks(documents: DataFrame) -> DataFrame:
    """(doc_id, maker) of documents (doc_id, producer, creator): every maker whose files are known to be peculiar. Nulls name nobody."""
    both = F.lower(F.concat_ws(" ", "producer", "creator"))
    named = [F.when(F.greatest(*(F.contains(both, F.lit(p)) for p in [*parts, parts[0]])), F.lit(maker)) for maker, parts in MAKERS.items()]
    return documents.select("doc_id", F.explode(F.array_compact(F.array(*named))).alias("maker"))


def signature_profiles(documents: DataFrame, signatures: DataFrame, store_needed: bool = False) -> DataFrame:
    """(doc_id, profile, status) of documents (doc_id, has_store) and their signatures (doc_id, filter, validity, stamp_valid).

    One row for every signature of the two profiles that are judged one by one, one for
    all baseline signatures of a document, and a warning where a document has none of the
    three. ``stamp_valid`` is null for a time stamp that was not read.
    """
    verdict = F.lit(None).cast("string")
    for validity, status in VERDICTS.items():
        verdict = F.when(F.col("validity") == validity, status).otherwise(verdict)
    stamp = F.when(F.col("stamp_valid"), "Pass").when(~F.col("stamp_valid"), "Fail").otherwise("Warning")
    known = signatures.where(F.col("filter").isin("ETSI.CAdES.detached", "ETSI.RFC3161", *BASELINE))
    single = known.select("doc_id", F.when(F.col("filter") == "ETSI.CAdES.detached", F.struct(F.lit("CAdES").alias("profile"), verdict.alias("status"))).when(F.col("filter") == "ETSI.RFC3161", F.struct(F.lit("RFC3161").alias("profile"), stamp.alias("status"))).alias("p"))
    single = single.where("p is not null").select("doc_id", "p.*")
    counts = known.groupBy("doc_id").agg(F.count_if(F.col("filter").isin(BASELINE)).alias("baseline"))
    of = documents.join(counts, "doc_id", "left")
    missing = F.when(F.col("has_store"), "Pass").otherwise("Fail" if store_needed else "Warning")
    whole = F.when(F.col("baseline").isNull(), F.struct(F.lit("none").alias("profile"), F.lit("Warning").alias("status"))).when(F.col("baseline") > 0, F.struct(F.lit("PAdES-LTV").alias("profile"), missing.alias("status")))
    return single.unionByName(of.select("doc_id", whole.alias("p")).where("p is not null").select("doc_id", "p.*"))


def pinned(fingerprint: Column, allowed: list[str], blocked: list[str]) -> Column:
    """Whether a time stamp authority may be trusted: null without lists, else not blocked and, if some are named, among the allowed; any case."""
    if not allowed and not blocked:
        return F.lit(None).cast("boolean")
    low = F.lower(fingerprint)
    listed = lambda names: low.isin([n.lower() for n in names]) if names else F.lit(False)
    return ~listed(blocked) & (listed(allowed) if allowed else F.lit(True))


def signature_format(data: Column) -> Column:
    """What the bytes of a signature look like, by their length and first bytes."""
    size, der, starts = F.octet_length(data), F.substring(data, 1, 1) == F.lit(b"\x30"), lambda b: F.substring(data, 1, len(b)) == F.lit(b)
    return (
        F.when(data.isNull() | (size < 10), "Unknown")
        .when(der & (size > 50), "PKCS7")
        .when(starts(b"-----BEGIN PKCS7"), "PKCS7 PEM")
        .when(starts(b"-----BEGIN CERTIFICATE"), "Certificate PEM")
        .when(der & (size > 20), "Time stamp")
        .otherwise("Unknown")
    )


def digest(data: Column, algorithm: Column) -> Column:
    """Lowercase hex digest by the algorithm's name; null for an unknown one."""
    out = F.lit(None).cast("string")
    for name, bits in DIGESTS.items():
        out = F.when(algorithm == name, F.sha1(data) if bits == 160 else F.sha2(data, bits)).otherwise(out)
    return out


def color_space(value: Column) -> Column:
    """The kind of a colour space value: a device name, the family of an array, Reference, else null."""
    device, family = F.regexp_extract(value, r"^\"?/(\w+)\"?$", 1), F.regexp_extract(value, r"^\s*\[\s*\"/(\w+)\"", 1)
    return F.when(device.isin(DEVICE_SPACES), device).when(family.isin(ARRAY_SPACES), family).when(value.rlike(r'^\{\s*"R"'), "Reference")


def page_color_spaces(pages: DataFrame) -> DataFrame:
    """(doc_id, node_id, name, space) of the colour spaces in the resources of pages (doc_id, node_id, value)."""
    entries = F.map_entries(F.from_json(_entry("Resources.ColorSpace"), "map<string,string>"))
    each = pages.select("doc_id", "node_id", F.explode(entries).alias("e"))
    return each.select("doc_id", "node_id", F.col("e.key").alias("name"), color_space(F.col("e.value")).alias("space")).where("space is not null")


def graphics_states(states: DataFrame) -> DataFrame:
    """(doc_id, node_id, property, setting) of graphics state dictionaries (doc_id, node_id, value); entries of another kind than theirs do not count."""
    row = lambda name, value: F.struct(F.lit(name).alias("property"), value.alias("setting"))
    raw = F.from_json("value", "map<string,string>")
    plain = [F.when(raw[key].rlike(KINDS[kind]), row(name, F.ltrim(raw[key], F.lit("/")) if kind == "name" else raw[key])) for key, (name, kind) in STATES.items()]
    mode, mask, transfer = raw["BM"], raw["SMask"], raw["TR"]
    first = F.regexp_extract(mode, r'^\[\s*"/(\w+)"', 1)
    blend = F.when(mode.startswith("/"), F.ltrim(mode, F.lit("/"))).when(first != "", first).otherwise("Normal")
    soft = F.when(mask == "/None", "None").when(mask.rlike(r'^\{\s*"R"'), "Reference").when(mask.startswith("{"), "Present")
    moved = F.when(transfer == "/Identity", "Identity").when(transfer.rlike(r'^\{\s*"R"'), "Reference")
    more = [F.when(mode.isNotNull(), row("blend_mode", blend)), F.when(soft.isNotNull(), row("soft_mask", soft)), F.when(moved.isNotNull(), row("transfer", moved))]
    return states.select("doc_id", "node_id", F.explode(F.array_compact(F.array(*plain, *more))).alias("p")).select("doc_id", "node_id", "p.*")


def accessibility_attributes(elements: DataFrame) -> DataFrame:
    """(doc_id, node_id, part, alt, actual_text, expansion, lang, title, headers, row_span, col_span, scope) of structure elements (doc_id, node_id, value).

    ``part`` is the group of attributes that an element's type or the owner of its
    attributes has: table, list, form or none.
    """
    text = lambda c: F.regexp_replace(c, r"^[/(]", "")
    kind, owner = text(_entry("S")), text(_entry("A.O"))
    part = F.when(kind.isin(TABLE_TYPES) | (owner == "Table"), "table").when(kind.isin(LIST_TYPES) | (owner == "List"), "list").when(kind.isin(FORM_TYPES), "form").otherwise("none")
    table = lambda c: F.when(part == "table", c)
    headers = F.transform(F.from_json(_entry("A.Headers"), "array<string>"), text)
    lang = F.coalesce(text(_entry("A.Lang")), text(_entry("Lang")))
    return elements.select(
        "doc_id", "node_id", part.alias("part"), text(_entry("Alt")).alias("alt"), text(_entry("ActualText")).alias("actual_text"), text(_entry("E")).alias("expansion"), lang.alias("lang"), text(_entry("A.Title")).alias("title"),
        table(headers).alias("headers"), table(_entry("A.RowSpan").cast("int")).alias("row_span"), table(_entry("A.ColSpan").cast("int")).alias("col_span"), table(text(_entry("A.Scope"))).alias("scope"),
    )


def query_nodes(nodes: DataFrame, edges: DataFrame, roots: DataFrame, types: list[str] | None = None, errors: bool | None = None, warnings: bool | None = None, max_depth: int | None = None) -> DataFrame:
    """(node_id, depth) of nodes (node_id, node_type, errors, warnings) that a walk over Child edges reaches and that meet every condition given."""
    reached = graph.walk(edges.where(F.col("edge_type") == graph.CHILD), roots, max_depth).groupBy("node_id").agg(F.min("depth").alias("depth"))
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    fit = F.lit(True)
    for wanted, column in ((errors, "errors"), (warnings, "warnings")):
        if wanted is not None:
            fit &= some(column) == F.lit(wanted)
    if types:
        fit &= F.col("node_type").isin(types)
    return nodes.where(fit).join(reached, "node_id").select("node_id", "depth")


def security_statistics(nodes: DataFrame, edges: DataFrame, depths: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_references, n_targets, most_references, max_depth) of a graph; ``depths`` are (node_id, depth) of a walk.

    References are counted on the side of the document that makes them; ``most_references``
    are those to one target.
    """
    own = nodes.where("doc_id is not null").select("doc_id", "node_id", "node_type")
    to = edges.where(F.col("edge_type") == graph.REFERENCE).join(own.select("doc_id", F.col("node_id").alias("src")), "src").groupBy("doc_id", "dst").agg(F.count(F.lit(1)).alias("n"))
    counts = to.groupBy("doc_id").agg(F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_targets"), F.max("n").alias("most_references"))
    facts = own.join(depths, "node_id", "left").groupBy("doc_id").agg(F.count_if(F.col("node_type") == "Page").alias("n_pages"), F.max("depth").alias("max_depth"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return facts.join(counts, "doc_id", "left").select("doc_id", "n_pages", *map(zero, ("n_references", "n_targets", "most_references", "max_depth")))


def structure_analysis(nodes: DataFrame, depths: DataFrame, many: int = 10_000, deep: int = 50) -> DataFrame:
    """(doc_id, n_nodes, max_depth, has_root, warnings): size, depth and whether a document has a Catalog."""
    facts = nodes.where("doc_id is not null").join(depths, "node_id", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.bool_or(F.col("node_type") == "Catalog").alias("has_root"))
    warnings = F.array_compact(F.array(F.when(F.col("n_nodes") > many, "many nodes"), F.when(F.col("max_depth") > deep, "deep nesting")))
    return facts.withColumn("warnings", warnings)


def node_warnings(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, level, message) of nodes (doc_id, node_id, node_type, props) that act or carry files."""
    kind = F.col("node_type")
    row = lambda level, message: F.struct(F.lit(level).alias("level"), F.lit(message).alias("message"))
    found = (
        F.when(kind.isin("JavaScriptAction", "EmbeddedJS"), row("warning", "JavaScript"))
        .when(kind == "LaunchAction", row("warning", "Launch action"))
        .when((kind == "URIAction") & F.col("props")["URI"].startswith("http://"), row("warning", "Insecure address"))
        .when(kind == "EmbeddedFile", row("info", "Embedded file"))
    )
    return nodes.select("doc_id", "node_id", found.alias("f")).where("f is not null").select("doc_id", "node_id", "f.*")


def widget_scripts(annotations: DataFrame) -> DataFrame:
    """(doc_id, node_id, event, script) of the scripts that a widget's own additional actions hold."""
    widgets = annotations.where(_entry("Subtype") == "/Widget")
    each = widgets.select("doc_id", "node_id", F.explode(F.map_entries(F.from_json(_entry("AA"), "map<string,string>"))).alias("e"))
    action = each.where(_entry("S", "e.value") == "/JavaScript").select("doc_id", "node_id", F.col("e.key").alias("event"), F.expr("substring(get_json_object(e.value, '$.JS'), 2)").alias("script"))
    return action.where("script is not null")


def compliance(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, profile, n_violations, status) by the two short profiles: fonts embedded and no actions (archive), structure tree and language (accessible).

    ``nodes`` are (doc_id, node_type, value); every document of ``documents`` gets a row of either profile.
    """
    kind, entry = F.col("node_type"), lambda name: _entry(name).isNotNull()
    archive = ((kind == "Font") & ~(entry("FontFile") | entry("FontFile2") | entry("FontFile3"))) | kind.endswith("Action")
    catalog = kind == "Catalog"
    accessible = (catalog & ~entry("StructTreeRoot")).cast("int") + (catalog & ~entry("Lang")).cast("int")
    counts = nodes.groupBy("doc_id").agg(F.count_if(archive).alias("archive"), F.sum(accessible).alias("accessible"))
    both = documents.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), F.coalesce(p, F.lit(0)).cast("long").alias("n_violations")) for p in ("archive", "accessible")))).alias("p"))
    return both.select("doc_id", "p.*", F.when(F.col("p.n_violations") > 0, "NonCompliant").otherwise("Compliant").alias("status"))


def linearization(content: Column, within: int = 1024) -> Column:
    """(version, length, hint_offset, hint_length, objects, first_page, first_page_end, main_table) of a file whose first object says it is linearized; else null.

    Only the first ``within`` bytes may hold that object, by the format's rule. A missing entry, but for
    the version (then 1.0) and the hints' length, makes the whole null.
    """
    head = F.decode(F.substring(content, 1, within), "ISO-8859-1")
    body = F.regexp_extract(head, r"(?s)\b1 0 obj\s*<<(.*?)>>", 1)
    number = lambda key: F.regexp_extract(body, rf"/{key}\s+(-?[\d.]+)", 1)
    whole = lambda c: F.when(c != "", c.cast("long"))
    hint, hint_length = F.regexp_extract(body, r"/H\s*\[\s*(\d+)", 1), F.regexp_extract(body, r"/H\s*\[\s*\d+\s+(\d+)", 1)
    needed = {"length": whole(number("L")), "hint_offset": whole(hint), "objects": whole(number("N")), "first_page": whole(number("O")), "first_page_end": whole(number("E")), "main_table": whole(number("T"))}
    ok = F.contains(body, F.lit("/Linearized"))
    for c in needed.values():
        ok &= c.isNotNull()
    version = F.when(number("Linearized") != "", number("Linearized").cast("double")).otherwise(1.0)
    return F.when(ok, F.struct(version.alias("version"), needed["length"].alias("length"), needed["hint_offset"].alias("hint_offset"), whole(hint_length).alias("hint_length"), *(needed[k].alias(k) for k in ("objects", "first_page", "first_page_end", "main_table"))))


def strategies(level: str) -> list[str]:
    """The repairs of a level, most urgent first."""
    return sorted(LEVELS[level], key=lambda s: -PRIORITIES[s])


def repaired(files: DataFrame, level: str = "Aggressive") -> DataFrame:
    """(doc_id, text, actions) of files (doc_id, text): header, trailer and end mark, references, stream bounds, control characters, misspelt keywords and brackets mended.

    ``text`` holds one character a byte (ISO-8859-1). ``actions`` names what changed the
    text, in the order of the level's priorities; what a level leaves out is not tried. A
    null text stays null. Every step is an expression over whole texts.
    """
    none = F.array().cast("array<string>")
    out = files.select("doc_id", "text", none.alias("actions"))
    for name in strategies(level):
        if name in MENDS:
            better = out.withColumn("mended", MENDS[name](F.col("text")))
            changed = F.when(F.col("mended") != F.col("text"), F.array(F.lit(name))).otherwise(none)
            out = better.select("doc_id", F.col("mended").alias("text"), F.concat("actions", changed).alias("actions"))
    return out


def _basic_structure(t: Column) -> Column:
    at = F.locate("%PDF-", t)
    headed = F.when(at == 0, F.concat(F.lit("%PDF-1.4\n"), t)).otherwise(F.expr("substring(text, greatest(1, locate('%PDF-', text)))"))
    trailed = F.when(F.contains(headed, F.lit("trailer")), headed).otherwise(F.concat(headed, F.lit("trailer\n<<\n/Size 2\n/Root 1 0 R\n>>\nstartxref\n0\n")))
    return F.when(trailed.endswith("%%EOF") | trailed.endswith("%%EOF\n"), trailed).otherwise(F.concat(trailed, F.lit("\n%%EOF")))


def _references(t: Column) -> Column:
    return F.regexp_replace(t, r"\b(\d+)\s+(\d+)R\b", "$1 $2 R")


def _streams(t: Column) -> Column:
    return F.regexp_replace(t, r"(?s)\bstream(?:\r?\n)?(.*?)\n?endstream", "stream\n$1\nendstream")


def _keywords(t: Column) -> Column:
    """Words that are no keyword but one edit away from one become the first such keyword; white space stays."""
    near = lambda w: F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.levenshtein(w, k, 1) == 1)
    right = lambda w: F.when((F.length(w) > 10) | w.isin(KEYWORDS), w).otherwise(F.coalesce(F.get(near(w), 0), w))
    return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"[ \t\n\r]+|[^ \t\n\r]+"), 0), right), "")


def _encoding(t: Column) -> Column:
    return F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")


def _heuristic(t: Column) -> Column:
    for typo, word in TYPOS.items():
        t = F.regexp_replace(t, rf"\b{typo}\b", word)
    count = lambda c: F.length(t) - F.length(F.translate(t, c, ""))
    missing = count("[(<") - count("])>")
    return F.when(missing > 0, F.concat(t, F.repeat(F.lit("]"), missing))).otherwise(t)


def outside_streams(t: Column, mend) -> Column:
    """``t`` with ``mend`` on all that is not between ``stream`` and ``endstream``."""
    pieces = F.split(t, r"(?=\bstream\b)|(?<=endstream)")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("stream"), p).otherwise(mend(p))), "")


def _data(t: Column) -> Column:
    """Outside of streams: null characters become spaces, lone carriage returns line breaks of two characters, letters stuck to a decimal number go."""
    return outside_streams(t, lambda p: F.regexp_replace(F.regexp_replace(F.translate(p, "\0", " "), r"\r(?!\n)", "\r\n"), r"(?<![\w.])(\d++\.\d*+)[A-Za-z]++", "$1"))


#: Repairs that are one expression over a whole text; those by tokens are in ``recovery``.
MENDS = {"BasicStructure": _basic_structure, "DataRecovery": _data, "Reference": _references, "Stream": _streams, "Encoding": _encoding, "Heuristic": _heuristic, "FuzzyMatching": _keywords}


def stage_statistics(events: DataFrame) -> DataFrame:
    """(stage, n_items, n_errors, ms, rate) of processed items (stage, ms, failed): items a second of time spent, 0 where none was."""
    by = events.groupBy("stage").agg(F.count(F.lit(1)).alias("n_items"), F.count_if("failed").alias("n_errors"), F.sum("ms").alias("ms"))
    return by.withColumn("rate", F.when(F.col("ms") > 0, F.col("n_items") / (F.col("ms") / 1000)).otherwise(0.0))


def completion(tasks: DataFrame, key: str) -> DataFrame:
    """(key, n, share) of tasks (key, done): the share that is done."""
    return tasks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("done"), F.lit(False)).cast("double")).alias("share"))


def textual_values(values: DataFrame) -> DataFrame:
    """(doc_id, node_id, text) of every key, name and string, however deep, in values (doc_id, node_id, value); references are no text."""
    plain = F.regexp_replace("value", r'\{"R":\s*"\d+ \d+"\}', "null")
    quoted = F.regexp_extract_all(plain, F.lit(r'("(?:[^"\\]++|\\.)*+")'), 1)
    texts = F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")
    return values.select("doc_id", "node_id", F.explode(texts).alias("text")).withColumn("text", F.regexp_replace("text", "^[/(]", ""))


def timeline(changes: DataFrame) -> DataFrame:
    """(doc_id, rev, previous, n_changes, grown) of changes (doc_id, rev): each revision beside the one before it, null for the first.

    ``grown`` is how many more changes it has than the one before.
    """
    own = Window.partitionBy("doc_id").orderBy("rev")
    by = changes.groupBy("doc_id", "rev").agg(F.count(F.lit(1)).alias("n_changes"))
    return by.select("doc_id", "rev", F.lag("rev").over(own).alias("previous"), "n_changes", (F.col("n_changes") - F.lag("n_changes").over(own)).alias("grown"))


def minima(ranges: list[tuple[float, float]]) -> Column:
    """A calculator function's values: the least of each range, whatever the input, as program text is not run."""
    return F.array(*(F.lit(float(low)) for low, _ in ranges))


def apply_batch(nodes: DataFrame, edges: DataFrame, batch: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the given changes in order; each is a kind and the table of all changes of that kind: replace, insert, remove, move, merge."""
    for kind, changes in batch:
        if kind == "replace":
            nodes = graph.replace_nodes(nodes, changes)
        elif kind == "insert":
            nodes, edges = graph.insert_nodes(nodes, edges, changes)
        elif kind == "remove":
            nodes, edges = graph.remove_subtree(nodes, edges, changes)
        elif kind == "move":
            edges = graph.move_subtree(edges, changes)
        elif kind == "merge":
            nodes, edges = graph.merge_nodes(nodes, edges, changes)
        else:
            raise ValueError(f"no change of kind {kind}")
    return nodes, edges
