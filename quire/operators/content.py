"""What content holds and where it comes from: threats, strings, media facts, provenance, codec choices, merged trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

#: Words that make a content stream suspicious, and those that make it a script.
SUSPECT = [
    "eval", "unescape", "fromCharCode", "String.fromCharCode", "document.write", "innerHTML", "createElement", "appendChild",
    "exec", "system", "shell", "cmd", "powershell", "bash", "ActiveXObject", "WScript", "Shell.Application",
    "getAnnots", "print", "mailDoc", "importDataObject", "launch", "submitForm", "resetForm", "exportValues",
    "/F ", "/FT ", "/Ff ", "/V ", "/DV ", "/AA ", "/OpenAction", "/Names", "/AcroForm", "/XFA",
]
SCRIPT = ["function", "var", "let", "const", "if", "for", "while", "try", "catch", "throw", "return", "new", "this", "app.", "doc.", "field.", "event.", "util.", "AFNumber_Format", "AFPercent_Format", "AFDate_Format"]
#: How well each algorithm does, and which ones suit a kind of content.
SCORES = {"Flate": 0.8, "LZW": 0.7, "RunLength": 0.5, "DCT": 0.9, "JPX": 0.95}
SUITED = {"Text": ["Flate", "LZW"], "Image": ["DCT", "JPX", "Flate"], "Vector": ["Flate", "LZW"], "Binary": ["LZW", "Flate"], "Structured": ["Flate"]}
#: What to do about a kind of damage: (priority from 3, action, expected success).
REPAIRS = {"StructuralDamage": (3, "StructureRepair", 0.8), "InvalidReferences": (2, "ReferenceResolution", 0.7), "StreamCorruption": (2, "StreamReconstruction", 0.6), "EncodingIssues": (1, "EncodingFix", 0.9)}
OTHER_REPAIR = (2, "DataRecovery", 0.5)


def keyword_risk(pattern: Column) -> Column:
    return F.when(pattern.rlike("eval|exec|shell|ActiveX|launch|system"), "High").when(pattern.rlike("JavaScript|unescape"), "Medium").otherwise("Low")


def content_threats(texts: DataFrame) -> DataFrame:
    """(doc_id, kind, pattern, risk) of texts: scripts, each suspicious word, and addresses and paths that lead outside. Null texts hold none."""
    t = F.col("text")
    words = F.size(F.filter(F.array(*map(F.lit, SCRIPT)), lambda w: F.contains(t, w)))
    row = lambda kind, pattern, risk: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), risk.alias("risk"))
    flag = lambda kind, pattern, cond: F.when(cond, row(kind, F.lit(pattern), F.lit("High" if kind == "external" else "Medium")))
    flags = F.array(
        flag("script", "javascript", (words >= 2) | rules.any_of(t, ["function", "eval"])),
        flag("external", "URL", rules.any_of(t, ["http://", "https://"])),
        flag("external", "FilePath", rules.any_of(t, ["file://", "\\\\", "C:\\"])),
    )
    suspect = F.transform(F.filter(F.array(*map(F.lit, SUSPECT)), lambda w: F.contains(t, w)), lambda w: row("suspicious", w, keyword_risk(w)))
    return texts.where(t.isNotNull()).select("doc_id", F.explode(F.concat(F.filter(flags, lambda x: x.isNotNull()), suspect)).alias("f")).select("doc_id", "f.*")


def printable_strings(texts: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, place, string): runs of at least ``least`` printable ASCII characters; a run that the text's end cuts does not count.

    A match only begins where a run does and gives nothing back, so that the time is linear on texts of one long line.
    """
    runs = F.regexp_extract_all("text", F.lit(rf"(?<![ -~])([ -~]{{{least},}}+)[^ -~]"), 1)
    return texts.select("doc_id", F.posexplode(runs).alias("place", "string"))


def throughput(samples: DataFrame, key: str) -> DataFrame:
    """(key, n, rate) of (key, bytes, ms): megabytes a second over all samples of a key; 0 where no time passed."""
    by = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("ms").alias("ms"))
    return by.select(key, "n", F.when(F.col("ms") == 0, 0.0).otherwise(F.col("bytes") / 1048576 / (F.col("ms") / 1000)).alias("rate"))


def format_counts(items: DataFrame) -> DataFrame:
    """(format, n) of items whose format is known."""
    return items.where("format is not null").groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def visible_items(outlines: DataFrame) -> DataFrame:
    """(doc_id, n_items, n_visible) of outline items (doc_id, count): a negative count marks a closed item."""
    return outlines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("count") >= 0).alias("n_visible"))


def recommendations(indicators: DataFrame) -> DataFrame:
    """(doc_id, place, action, priority, success) of damage indicators (doc_id, ord, damage): gravest first, else as found."""
    row = lambda p, a, s: F.struct(F.lit(p).alias("priority"), F.lit(a).alias("action"), F.lit(s).alias("success"))
    repair = row(*OTHER_REPAIR)
    for damage, known in REPAIRS.items():
        repair = F.when(F.col("damage") == damage, row(*known)).otherwise(repair)
    of = indicators.withColumn("r", repair)
    own = Window.partitionBy("doc_id").orderBy(F.desc("r.priority"), "ord", "damage")
    names = F.element_at(F.array(*map(F.lit, ("Low", "Medium", "High"))), F.col("r.priority"))
    return of.select("doc_id", (F.row_number().over(own) - 1).alias("place"), "r.action", names.alias("priority"), "r.success")


def ranked_algorithms(kind: Column) -> Column:
    """The algorithms that suit a kind of content, best score first; null for an unknown kind."""
    out = F.lit(None).cast("array<string>")
    for name, suited in SUITED.items():
        out = F.when(kind == name, F.array(*map(F.lit, sorted(suited, key=lambda a: -SCORES[a])))).otherwise(out)
    return out


def best_ratios(results: DataFrame, key: str) -> DataFrame:
    """(key, algorithm, ratio) of tries (key, ord, algorithm, original, compressed): the least ratio, of equals the first try. Failed tries are null."""
    ratio = F.col("compressed") / F.col("original")
    tries = results.select(key, "ord", F.struct("algorithm", ratio.alias("ratio")).alias("t")).where("t.ratio is not null")
    return tries.groupBy(key).agg(F.min_by("t", F.struct("t.ratio", "ord", "t.algorithm")).alias("t")).select(key, "t.*")


def unique_in_order(items: DataFrame, key: str) -> DataFrame:
    """(key, place, value) of (key, place, value): each value of a key once, where it comes first."""
    return items.groupBy(key, "value").agg(F.min("place").alias("place")).select(key, "place", "value")


def merged_entries(entries: DataFrame) -> DataFrame:
    """(tree, num, value) of number-tree entries (tree, part, num, value): of a number in several parts the last part counts."""
    return entries.groupBy("tree", "num").agg(F.max_by("value", F.struct("part", "value")).alias("value"))


def merged_limits(entries: DataFrame) -> DataFrame:
    """(tree, low, high): limits that hold all parts of a tree."""
    return entries.groupBy("tree").agg(F.min("num").alias("low"), F.max("num").alias("high"))


def sampled(x: Column, samples: list[float], domain: tuple[float, float], encode: tuple[float, float], decode: tuple[float, float]) -> Column:
    """A sampled function of one variable: clipped to its domain, between two samples in proportion, decoded from 0..1."""
    at = encode[0] + (F.least(F.greatest(x, F.lit(domain[0])), F.lit(domain[1])) - domain[0]) / (domain[1] - domain[0]) * (encode[1] - encode[0])
    at = F.least(F.greatest(at, F.lit(0.0)), F.lit(float(len(samples) - 1)))
    low, table = F.floor(at).cast("int"), F.array(*map(F.lit, samples))
    a, b = F.get(table, low), F.get(table, F.least(low + 1, F.lit(len(samples) - 1)))
    return decode[0] + (a + (at - low) * (b - a)) * (decode[1] - decode[0])


#: What a provenance query asks of (revisions array, repairs array, container).
PROVENANCE = {
    "Incremental": "size(revisions) > 0",
    "Recovered": "size(repairs) > 0",
    "Inferred": "exists(repairs, r -> r in ('StructureReconstruction', 'ObjectRepair'))",
}


def by_provenance(nodes: DataFrame, asked: str, container: int | None = None, revision: int | None = None) -> DataFrame:
    """The rows of ``nodes`` (revisions, repairs, container, …) with a provenance: a key of ``PROVENANCE``, FromObjectStream or Revision."""
    if asked == "FromObjectStream":
        return nodes.where(F.col("container") == container)
    if asked == "Revision":
        return nodes.where(F.array_contains("revisions", revision))
    return nodes.where(PROVENANCE[asked])


def with_errors(nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (errors array, …) that have an error; a null array has none."""
    return nodes.where(F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0)


def resolved_dicts(values: DataFrame, objects: DataFrame) -> DataFrame:
    """``values`` (dict, ref, …) with the dictionary itself or the one that ``objects`` (obj, dict) hold under the reference; else null."""
    held = objects.select(F.col("obj").alias("ref"), F.col("dict").alias("held"))
    return values.join(held, "ref", "left").select(*(c for c in values.columns if c not in ("dict", "ref")), F.coalesce("dict", "held").alias("dict"))


def named_scripts(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """(tree, name, script) of name-tree entries (tree, key, value) whose object (obj, dict map) is a script."""
    of = objects.select(F.col("obj").alias("value"), F.col("dict")["JS"].alias("script")).where("script is not null")
    return entries.join(of, "value").select("tree", F.col("key").alias("name"), "script")


def embedded_files(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """(tree, name, file_name, size, mime) of name-tree entries whose object (obj, dict map) is a file specification; UF goes before F."""
    d = F.col("dict")
    specs = objects.select(F.col("obj").alias("value"), F.coalesce(d["UF"], d["F"]).alias("file_name"), d["Size"].cast("long").alias("size"), F.regexp_replace(d["Subtype"], "^/", "").alias("mime"), d["EF"].alias("file"))
    return entries.join(specs.where("file is not null"), "value").select("tree", F.col("key").alias("name"), "file_name", "size", "mime")


def rich_media(annotations: DataFrame) -> DataFrame:
    """(doc_id, n_assets, asset_names, n_configurations, n_scripts) of annotations (doc_id, content JSON, settings JSON); names in order, each once."""
    names = F.coalesce(F.from_json(F.get_json_object("content", "$.Assets.Names"), "array<string>"), F.array().cast("array<string>"))
    size = lambda c, path: F.coalesce(F.json_array_length(F.get_json_object(c, path)), F.lit(0)).cast("long")
    unique = F.array_distinct(names)
    return annotations.select("doc_id", F.size(unique).cast("long").alias("n_assets"), unique.alias("asset_names"), size("content", "$.Configurations").alias("n_configurations"), size("settings", "$.Scripts").alias("n_scripts"))


def properties_of(properties: DataFrame, namespace: str) -> DataFrame:
    """The metadata properties (key, …) of one namespace prefix."""
    return properties.where(F.col("key").startswith(namespace))
