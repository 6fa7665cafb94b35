"""Security findings, scores, diffs, text statistics and recovery rules as DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.shared import stored

URL = r"(?:https?|ftp|file)://[^\s')]+"


def urls(texts: DataFrame) -> DataFrame:
    """(doc_id, url): every address in a text, one row each."""
    return texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({URL})"), 1)).alias("url"))


def threats(texts: DataFrame) -> DataFrame:
    """(doc_id, rule, severity, subject): what a text's scripts, every address and every name in it say; a rule counts once a subject."""
    t = F.col("text")
    script = rules.is_javascript(t)
    of_text: list[tuple[str, Column | str, Column]] = [
        ("javascript", F.when(rules.is_suspicious_script(t), "High").otherwise("Medium"), script),
        ("obfuscated javascript", "High", script & (rules.js_features(t) >= 3)),
        ("suspicious pattern", "Medium", rules.is_suspicious(t)),
        ("heap spray", "Critical", rules.is_heap_spray(t)),
        ("shellcode", "Critical", rules.is_shellcode(t)),
        ("hidden executable", "Critical", rules.is_hidden_executable(t)),
    ]
    of_url = lambda u: [("outbound connection", F.when(rules.is_threat_url(u), "High").otherwise("Medium"), F.lit(True)), ("suspicious url", "High", rules.is_suspicious_url(u)), ("exfiltration url", "High", rules.is_exfiltration_url(u))]
    of_name = lambda n: [("double extension", "High", rules.has_double_extension(n)), ("executable name", "Critical", rules.is_executable_name(n))]

    def rows(checks, subject: Column) -> Column:
        lit = lambda s: F.lit(s) if isinstance(s, str) else s
        each = (F.when(c, F.struct(F.lit(rule).alias("rule"), lit(severity).alias("severity"), subject.alias("subject"))) for rule, severity, c in checks)
        return F.filter(F.array(*each), lambda x: x.isNotNull())

    addresses = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({URL})"), 1))
    names = F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w.contains(".")))
    found = F.concat(rows(of_text, F.lit("")), F.flatten(F.transform(addresses, lambda u: rows(of_url(u), u))), F.flatten(F.transform(names, lambda n: rows(of_name(n), n))))
    return texts.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


def combinations(found: DataFrame) -> DataFrame:
    """(doc_id, rule, severity): several grave findings; scripts with addresses; programs with scripts."""
    has = lambda *names: F.bool_or(F.col("rule").isin(*names))
    agg = found.groupBy("doc_id").agg(
        (F.count_if(F.col("severity").isin("High", "Critical")) > 2).alias("many"),
        (has("javascript") & has("outbound connection")).alias("network"),
        (has("hidden executable", "executable name") & has("javascript")).alias("dropper"),
    )
    names = {"many": ("several grave findings", "Critical"), "network": ("script with network access", "High"), "dropper": ("program with script", "Critical")}
    rows = F.filter(F.array(*(F.when(F.col(c), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for c, (n, s) in names.items())), lambda x: x.isNotNull())
    return agg.select("doc_id", F.explode(rows).alias("f")).select("doc_id", "f.*")


def all_threats(texts: DataFrame) -> DataFrame:
    """(doc_id, rule, severity): the findings and what their combinations add. The rules run once; their rows are stored for both."""
    found = stored(threats(texts).select("doc_id", "rule", "severity"), "threats")
    return found.unionByName(combinations(found))


def risk(found: DataFrame) -> DataFrame:
    """(doc_id, score, level, safe) of all threats: severities added up, capped at 1000 (the scale's end)."""
    score = F.least(F.sum(rules.severity_score(F.col("severity"))), F.lit(1000))
    out = found.groupBy("doc_id").agg(score.cast("long").alias("score"), F.bool_or(F.col("severity").isin("High", "Critical")).alias("grave"))
    return out.select("doc_id", "score", rules.risk_level(F.col("score")).alias("level"), ((F.col("score") <= 20) & ~F.col("grave")).alias("safe"))


def entropy(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, entropy) in bits a character, from counts a character with map-side combining."""
    chars = texts.select(key, F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy(key, "c").agg(F.count(F.lit(1)).alias("n"))
    total = chars.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(key, (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def extraction_totals(texts: DataFrame) -> DataFrame:
    t = F.col("text")
    words = F.when(F.trim(F.regexp_replace(t, r"\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")))
    return texts.select("doc_id", words.cast("long").alias("n_words"), F.octet_length(t).cast("long").alias("n_bytes"), F.size(F.split(t, "\n")).cast("long").alias("n_lines"))


def keywords(texts: DataFrame, most: int = 100) -> DataFrame:
    """(doc_id, place, keyword): the first words of three bytes or more, lower-cased."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.octet_length(w) >= 3)
    return texts.select("doc_id", F.posexplode(F.slice(words, 1, most)).alias("place", "keyword"))


def search(texts: DataFrame, query: str) -> DataFrame:
    """(doc_id, line, text) of lines that hold ``query`` in any case."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.where(F.lower("text").contains(query.lower()))


def shortest_edit(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """(line of a, line of b) that stay, in order, by Myers' greedy search for the least edit script: time grows with the edits."""
    best, trail = {1: 0}, []
    for d in range(len(a) + len(b) + 1):
        trail.append(dict(best))
        for k in range(-d, d + 1, 2):
            x = best[k + 1] if k == -d or (k != d and best.get(k - 1, -1) < best.get(k + 1, -1)) else best[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            best[k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    same, x, y = [], len(a), len(b)
    for d in range(len(trail) - 1, -1, -1):
        seen, k = trail[d], x - y
        before = k + 1 if k == -d or (k != d and seen.get(k - 1, -1) < seen.get(k + 1, -1)) else k - 1
        to = seen[before]
        while x > max(to, 0) and y > max(to - before, 0) and (x > to + (before < k) or d == 0) and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
            same.append((x, y))
        x, y = to, to - before
    return same[::-1]


def line_diff(pairs: DataFrame) -> DataFrame:
    """(keys, change, old_line, new_line, old, new) of text pairs (keys, old, new): lines removed and added by the least edit script.

    In a stretch of both, the first removed line and the first added one are one
    Modified line, and so on; null texts have no line.
    """
    keys = [c for c in pairs.columns if c not in ("old", "new")]
    names = [*keys, "change", "old_line", "new_line", "old", "new"]

    def changes(old: str | None, new: str | None):
        a, b = ([] if t is None else t.split("\n") for t in (old, new))
        i = j = 0
        for x, y in [*shortest_edit(a, b), (len(a), len(b))]:
            both = min(x - i, y - j)
            yield from (("Modified", i + k, j + k, a[i + k], b[j + k]) for k in range(both))
            yield from (("Removed", k, None, a[k], None) for k in range(i + both, x))
            yield from (("Added", None, k, None, b[k]) for k in range(j + both, y))
            i, j = x + 1, y + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(k, *c) for k, (old, new) in enumerate(zip(part.column(len(keys)).to_pylist(), part.column(len(keys) + 1).to_pylist())) for c in changes(old, new)]
                if found:
                    owner, *cols = zip(*found)
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(owner)) for c in range(len(keys))), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    schema = ", ".join([*(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys), "change string, old_line long, new_line long, old string, new string"])
    return pairs.select(*keys, "old", "new").mapInArrow(rows, schema)


def similarity(changes: Column, nodes: Column, pages: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - changes / (nodes + pages + 10)))


def revision_delta(revisions: DataFrame) -> DataFrame:
    """(doc_id, rev, obj, change) of (doc_id, rev, obj, mark) rows: what each revision adds, modifies or, by leaving out, deletes."""
    own = Window.partitionBy("doc_id", "obj").orderBy("rev")
    seen = revisions.withColumn("before", F.lag("rev").over(own)).withColumn("was", F.lag("mark").over(own)).withColumn("after", F.lead("rev").over(own))
    last = revisions.groupBy("doc_id").agg(F.max("rev").alias("last"))
    changed = seen.where(F.col("before").isNull() | (F.col("before") < F.col("rev") - 1) | (F.col("was") != F.col("mark")))
    changed = changed.select("doc_id", "rev", "obj", F.when(F.col("before") == F.col("rev") - 1, "modified").otherwise("added").alias("change"))
    gone = seen.join(last, "doc_id").where((F.col("rev") < F.col("last")) & (F.col("after").isNull() | (F.col("after") > F.col("rev") + 1)))
    return changed.unionByName(gone.select("doc_id", (F.col("rev") + 1).alias("rev"), "obj", F.lit("deleted").alias("change")))


def merge_lines(spans: DataFrame, gap: float = 3.0, tolerance: float = 0.3) -> DataFrame:
    """(page, line, text) of spans (page, x, y, height, space, width, text): a span joins the line before it if its
    baseline is within ``tolerance`` of its height and it starts within ``gap`` spaces of the line's end."""
    own = Window.partitionBy("page").orderBy("y", "x")
    dy, dx = F.abs(F.col("y") - F.lag("y").over(own)), F.col("x") - F.lag(F.col("x") + F.col("width")).over(own)
    new = F.when((dy <= tolerance * F.col("height")) & (dx < gap * F.col("space")), 0).otherwise(1)
    numbered = spans.withColumn("new", new).withColumn("line", F.sum("new").over(own))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), " ")
    return numbered.groupBy("page", "line").agg(text.alias("text"))


def compression_stats(sizes: DataFrame) -> DataFrame:
    """(algorithm, n, original, compressed, best, worst) of (algorithm, original, compressed) rows."""
    ratio = F.col("compressed") / F.col("original")
    return sizes.groupBy("algorithm").agg(F.count(F.lit(1)).alias("n"), F.sum("original").alias("original"), F.sum("compressed").alias("compressed"), F.min(ratio).alias("best"), F.max(ratio).alias("worst"))


def performance_breakdown(samples: DataFrame) -> DataFrame:
    """(op, n, total, mean, least, most, share) of (op, value) samples."""
    by = samples.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return by.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))


def compare_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, page, change): pages (doc_id, page, mark) of two versions that are Added, Removed, Modified or the Same; a page that repeats counts once, by its least mark."""
    one = lambda df, name: df.groupBy("doc_id", "page").agg(F.min("mark").alias(name), F.lit(True).alias(f"in_{name}"))
    both = one(a, "a").join(one(b, "b"), ["doc_id", "page"], "full")
    change = F.when(F.col("in_a").isNull(), "Added").when(F.col("in_b").isNull(), "Removed").when(F.col("a").eqNullSafe(F.col("b")), "Same").otherwise("Modified")
    return both.select("doc_id", "page", change.alias("change"))


def success_rates(chunks: DataFrame, key: str) -> DataFrame:
    """(key, n, success_rate) of chunks (key, n_errors): the share without errors."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("n_errors") == 0, 1.0).otherwise(0.0)).alias("success_rate"))


def type_statistics(items: DataFrame) -> DataFrame:
    """(kind, n, bytes) of media items (kind, size)."""
    return items.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def predominant(items: DataFrame, key: str) -> DataFrame:
    """(key, predominant): the kind that most items (key, kind) have; of equals the first by alphabet."""
    counts = items.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("predominant"))


def action_threats(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, action, severity) of parsed actions: what a script holds, where an address leads, what else acts outside the document."""
    entry = lambda name: F.coalesce(F.expr(f"substring(get_json_object(value, '$.{name}'), 2)"), F.lit(""))
    action = entry("S")
    severity = (
        F.when(action.isin("JavaScript", "JS"), F.when(rules.is_suspicious_script(entry("JS")), "High").otherwise("Medium"))
        .when(action == "Launch", "Critical")
        .when((action == "URI") & (entry("URI") != ""), F.when(rules.is_threat_url(entry("URI")), "High").otherwise("Medium"))
        .when(((action == "SubmitForm") & (entry("F") != "")) | (action == "ImportData"), "High")
        .when(action == "GoToR", "Low")
    )
    return nodes.select("doc_id", "node_id", action.alias("action"), severity.alias("severity")).where("severity is not null")
