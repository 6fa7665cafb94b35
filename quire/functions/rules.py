"""Text, URL, file-name and script rules as column expressions; all but ``checksum`` stay in the JVM."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings, suffixes and thresholds of the rules.
JAVASCRIPT = ["javascript", "eval(", "unescape(", "fromcharcode", "app.launchurl", "this.exportdataobject", "submitform"]
SUSPICIOUS = ["/openaction", "/aa", "/launch", "/uri", "/xfa", "cmd.exe", "powershell", "javascript:", "file://", "http://", "https://"]
SUSPICIOUS_SCRIPT = ["eval(", "document.write", "unescape(", "ActiveXObject", "WScript.Shell", "new Array(", "fromCharCode", "shellcode", "exploit", "payload", "app.launchURL", "this.print", "app.execDialog"]
BAD_TLDS = [".tk", ".ml", ".ga", ".cf", ".cc", ".info", ".biz"]
SHORTENERS = ["bit.ly", "tinyurl", "t.co", "goo.gl", "ow.ly", "is.gd"]
BAD_PATHS = ["/download", "/exe", "/install", "/setup", "/update"]
LEAKS = ["?data=", "&data=", "?info=", "&info=", "?user=", "&user="]
LOCAL = ["..", "localhost", "127.0.0.1", "192.168.", "10."]
DOCUMENT_SUFFIXES = ["txt", "pdf", "doc", "jpg", "png", "zip"]
PROGRAM_SUFFIXES = ["exe", "scr", "bat", "com", "pif"]
EXECUTABLES = ["exe", "com", "bat", "cmd", "scr", "pif", "dll", "jar", "class", "sh", "ps1", "vbs", "js"]
WEIGHTS = {"Catalog": 1.0, "Metadata": 0.9, "Page": 0.8, "ContentStream": 0.6}
VECTOR_OPS = ["m ", "l ", "c ", "v ", "y ", "h ", "re ", "S ", "s ", "f ", "F ", "B "]
STRUCTURE_MARKS = ["<<", ">>", "[", "]", "/", "obj", "endobj"]
TEXT_MARKS = ["BT", "ET", "Tf", "TJ", "Tj"]
IMAGE_MAGIC = ["FFD8FF", "89504E470D0A1A0A", "474946383761", "474946383961"]
SEVERITY = {"Critical": 100, "High": 50, "Medium": 20, "Low": 5}


def any_of(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def _sum(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (f.cast("int") for f in flags))


def is_javascript(text: Column) -> Column:
    return any_of(F.lower(text), JAVASCRIPT)


def is_suspicious(text: Column) -> Column:
    return any_of(F.lower(text), SUSPICIOUS)


def is_suspicious_script(text: Column) -> Column:
    """Whether the lower-cased script holds a pattern as it stands in the list; those with capitals never do."""
    return any_of(F.lower(text), SUSPICIOUS_SCRIPT)


def js_features(text: Column) -> Column:
    """How many of the seven obfuscation features a script shows; three or more count as obfuscated."""
    special = F.length(F.regexp_replace(text, r"[\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]", ""))
    return _sum([
        special > F.octet_length(text) * 0.4,
        text.contains("var "),
        text.rlike(r"[a-zA-Z_$][a-zA-Z0-9_$]{20,}"),
        F.regexp_count(text, F.lit(r"\\x")) > 10,
        F.regexp_count(text, F.lit(r"\\u")) > 5,
        F.regexp_count(text, F.lit(r" \+ ")) > 20,
        text.contains("eval(") & (text.contains("unescape(") | text.contains("fromCharCode")),
    ])


def is_shellcode(text: Column) -> Column:
    hexes = F.regexp_count(text, F.lit(r"\\x[0-9a-fA-F]{2}"))
    kinds = _sum([hexes > 0, text.rlike(r"\\u[0-9a-fA-F]{4}"), text.contains("String.fromCharCode"), text.contains("unescape("), text.contains("eval(")])
    return (hexes > 50) & (kinds >= 2)


def is_heap_spray(text: Column) -> Column:
    large = text.contains("new Array(") & (text.contains("0x") | text.rlike("[0-9]{4,}"))
    loop = text.contains("for(") | text.contains("while(")
    return large & loop & (_sum([text.contains(t) for t in ("new Array", ".length", "for(", "String(")]) >= 3)


def is_suspicious_url(url: Column) -> Column:
    low = F.lower(url)
    return low.rlike(r"https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}") | any_of(low, BAD_TLDS + SHORTENERS + BAD_PATHS)


def is_exfiltration_url(url: Column) -> Column:
    """A parameter that carries data, or a long query (what stands between the first two question marks) of letters, digits, = and &."""
    query = F.coalesce(F.get(F.split(url, r"\?"), F.lit(1)), F.lit(""))
    long = url.contains("=") & (F.octet_length(url) > 100) & (F.octet_length(query) > 50) & query.rlike("^[A-Za-z0-9=&]+$")
    return any_of(F.lower(url), LEAKS) | long


def is_threat_url(url: Column) -> Column:
    low = F.lower(url)
    return low.rlike("^(ftp://|file://|javascript:|data:)") | any_of(low, SHORTENERS + LOCAL) | (F.regexp_count(low, F.lit(r"\.")) > 6)


def has_double_extension(name: Column) -> Column:
    return F.lower(name).rlike(rf"\.({'|'.join(DOCUMENT_SUFFIXES)})\.({'|'.join(PROGRAM_SUFFIXES)})$")


def is_hidden_executable(name: Column) -> Column:
    return F.lower(name).contains(" .exe") | name.contains("‮")


def is_executable_name(name: Column) -> Column:
    return F.lower(name).rlike(rf"\.({'|'.join(EXECUTABLES)})$")


def truncate_evidence(text: Column, most: int = 200) -> Column:
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def uri_status(url: Column) -> Column:
    """Fail for plain, file and share addresses, else Warning."""
    return F.when(url.rlike(r"^(http://|ftp://|file://)") | url.contains("\\\\"), "Fail").otherwise("Warning")


def is_language_code(code: Column) -> Column:
    return code.rlike("^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8}+)*+$")  # possessive: no recursion on long codes


def parse_version(text: Column) -> Column:
    """struct(major, minor) of ``major.minor``, null where it is not one."""
    ok = text.rlike(r"^\d{1,3}\.\d{1,3}$")
    return F.when(ok, F.struct(F.split(text, r"\.")[0].cast("int").alias("major"), F.split(text, r"\.")[1].cast("int").alias("minor")))


def pdf_date(text: Column) -> Column:
    """Timestamp of ``D:YYYYMMDDHHmmSS``; what follows is ignored."""
    return F.try_to_timestamp(F.regexp_extract(text, r"^D:(\d{14})", 1), F.lit("yyyyMMddHHmmss"))


def plain_name(name: Column) -> Column:
    """A name without its leading slash."""
    return F.regexp_replace(name, "^/", "")


def permission_flags(p: Column) -> Column:
    """The eight named bits of a permission number."""
    bits = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill_forms": 9, "extract": 10, "assemble": 11, "print_high": 12}
    return F.struct(*((F.shiftright(p, bit - 1).bitwiseAND(F.lit(1)) == 1).alias(name) for name, bit in bits.items()))


def checksum(data: Column) -> Column:
    """``acc * 31 + byte`` over the bytes of a binary or of a text in UTF-8, modulo 2^32."""

    @F.pandas_udf("long")
    def sums(data: pd.Series) -> pd.Series:
        parts = [b"" if x is None else bytes(x) for x in data]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        powers = np.ones(int(sizes.max(initial=0)) + 1, np.uint32)
        np.cumprod(np.full(len(powers) - 1, 31, np.uint32), out=powers[1:], dtype=np.uint32)
        each = [np.dot(np.frombuffer(x, np.uint8).astype(np.uint32), powers[n - 1 :: -1]) if (n := len(x)) else 0 for x in parts]
        return pd.Series([None if x is None else int(n) for x, n in zip(data, each)], dtype="Int64")

    return sums(data.cast("binary"))


def media_format(name: Column) -> Column:
    """Format by file suffix, null if unknown."""
    known = {"mp4": "MP4", "m4v": "MP4", "mov": "QuickTime", "avi": "AVI", "wmv": "WMV", "flv": "FLV", "webm": "WebM", "mkv": "MKV", "mp3": "MP3", "wav": "WAV"}
    out = F.lit(None).cast("string")
    for suffix, label in known.items():
        out = F.when(F.lower(name).endswith("." + suffix), label).otherwise(out)
    return out


def exponential(x: Column, c0: float, c1: float, n: float) -> Column:
    """c0 + x^n (c1 - c0) with x clipped to 0..1."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.lit(c0) + F.pow(clipped, F.lit(n)) * (c1 - c0)


def stitched(x: Column, bounds: list[float], parts: list[tuple[float, float, float]]) -> Column:
    """Exponential pieces over 0..1 divided at ``bounds``, each piece scaled to 0..1."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    edges = [0.0, *bounds, 1.0]
    out = exponential((clipped - edges[-2]) / (edges[-1] - edges[-2]), *parts[-1])
    for k in range(len(parts) - 2, -1, -1):
        out = F.when(clipped < edges[k + 1], exponential((clipped - edges[k]) / (edges[k + 1] - edges[k]), *parts[k])).otherwise(out)
    return out


def transform_point(x: Column, y: Column, m: list[float]) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return x * a + y * c + e, x * b + y * d + f


def index_weight(node_type: Column) -> Column:
    out = F.lit(0.5)
    for kind, weight in WEIGHTS.items():
        out = F.when(node_type == kind, weight).otherwise(out)
    return out


def _marks(data: Column, marks: list[str]) -> Column:
    """How often any of the byte strings occurs, overlaps included (none of them overlaps itself)."""
    return _sum([(F.octet_length(data) - F.octet_length(F.replace(data, F.lit(m), F.lit("")))) / len(m) for m in marks])


def content_kind(data: Column) -> Column:
    """What the bytes of a text are taken for: image signature, then ASCII share of the first 1000 bytes or a text operator, then vector operators, then structure marks."""
    start = F.substring(F.hex(data.cast("binary")), 1, 2000)
    size = F.octet_length(data)
    beyond = F.length(F.regexp_replace(F.regexp_replace(start, "..", "$0 "), "[0-7][0-9A-F] ", "")) / 3
    text = (size > 0) & (((F.least(size, F.lit(1000)) - beyond) / F.least(size, F.lit(1000)) > 0.8) | any_of(data, TEXT_MARKS))
    image = reduce(lambda a, b: a | b, (start.startswith(m) for m in IMAGE_MAGIC))
    vector, structured = _marks(data, VECTOR_OPS) > F.floor(size / 100), _marks(data, STRUCTURE_MARKS) > F.floor(size / 50)
    return F.when(image, "Image").when(text, "Text").when(vector, "Vector").when(structured, "Structured").otherwise("Binary")


def is_repetitive(data: Column) -> Column:
    """Whether a text of 1000 bytes or more has a byte over 100 times among its first 1000."""
    pairs = F.split(F.rtrim(F.regexp_replace(F.substring(F.hex(data.cast("binary")), 1, 2000), "..", "$0 ")), " ")
    most = F.array_max(F.transform(F.array_distinct(pairs), lambda b: F.size(F.filter(pairs, lambda x: x == b))))
    return (F.octet_length(data) >= 1000) & (most > 100)


def compression_choice(kind: Column, repetitive: Column) -> Column:
    """The algorithm for a kind of content; for unknown kinds repetition decides."""
    return F.when(kind.isin("Text", "Vector", "Structured"), "Flate").when(kind == "Image", "DCT").when(kind == "Binary", "LZW").otherwise(F.when(repetitive, "LZW").otherwise("Flate"))


def compliance_level(errors: Column, warnings: Column) -> Column:
    return F.when((errors == 0) & (warnings == 0), "AAA").when((errors == 0) & (warnings <= 5), "AA").when(errors <= 2, "A").otherwise("NonCompliant")


def compliance_score(errors: Column, warnings: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - (errors * 0.5 + warnings * 0.2) / 10)


def severity_score(severity: Column) -> Column:
    out = F.lit(0)
    for name, weight in SEVERITY.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out


def risk_level(score: Column) -> Column:
    return F.when(score <= 20, "LOW").when(score <= 100, "MEDIUM").when(score <= 200, "HIGH").otherwise("CRITICAL")


def health_level(integrity: Column) -> Column:
    return F.when(integrity >= 0.9, "Healthy").when(integrity >= 0.7, "PartiallyRecovered").when(integrity >= 0.4, "Damaged").otherwise("SeverelyDamaged")
