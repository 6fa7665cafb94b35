"""Main text of web pages by a site style tree.

The pages of one host are merged by element path: tag, classes and place among
siblings of that name, from the root, for every block of every page. Spark counts
how many different pages have a path, how its contents (the block's words, digits
alike) differ between pages and how its presentation (the sequence of child tags)
does. The importance of a path is the larger of the two entropies, divided by the
largest possible one. A path that fewer than ``PAGES`` different pages show has
importance 1: there is nothing to compare. Elements that are menus, forms, adverts,
comments or the like by their kind or by a whole class, id or role name are one node of
the tree for each kind and name, wherever they stand, of importance 0; such a name is
all that tells an advert that changes from page to page. What lies outside the article
or main element of pages that have one is such a node too. The composite importance of
a path is the greatest of itself and all paths below it.

From each page go the branches whose composite importance is under ``IMPORTANCE``,
and the own text of paths whose importance alone is; what is outside the article only
where the article has text left.

A block is the text between two block-level tags; character references are
decoded, white space inside is one space, blocks are joined by an empty line.
"""

from __future__ import annotations

import html as entities
import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

PAGES, IMPORTANCE = 5, 0.15
#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp math mi mo mn mrow msup msub mfrac msqrt mtext semantics annotation svg g path text tspan object canvas".split())
DROPPED = frozenset("nav footer aside form button dialog menu head input".split())
MAIN = frozenset(["article", "main"])
OUTER = frozenset(["html", "body", "article", "main"])
CLOSES = {
    "p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "tr": frozenset(["tr"]),
    "option": frozenset(["option"]),
}
#: Class, id and role names of what is not the article; each must be the whole name.
MARKS = re.compile(r"(?:(?:site|page|top|main|post|article)[-_]?)?(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo|related|replies|respond|search|share|sharing|sidebar|signup|social|sponsor(?:ed)?|subscribe|toolbar|widget)(?:[-_]?(?:area|bar|block|box|buttons?|container|form|items?|links?|list|menu|notice|panel|posts|section|thread|unit|wrap(?:per)?|[0-9]+))*|(?:site|page|top)[-_]?header|header", re.I)
#: The node of all that lies outside the article of pages that have one.
OUTSIDE = "outside!"
#: A tag ends before the next "<" outside of quotes, and nothing is tried twice: time grows with the page, whatever it holds.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
#: Elements nested deeper than this share the path of the one at this depth.
DEEPEST = 256
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


def _name(tag: str, attributes: str) -> tuple[str, bool]:
    """(tag.classes, whether the names mark it as not the article: then tag.mark)."""
    if not attributes or attributes.isspace():
        return tag, False
    names, mark = tag, None
    for key, value in ATTRIBUTE.findall(attributes):
        value, key = value.strip("\"'"), key.lower()
        if key == "class" and value:
            names += "." + ".".join(sorted(re.sub(r"[>!\[]", "_", v) for v in value.split()))
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            mark = mark or "hidden"
        elif key in ("class", "id", "role"):
            mark = mark or next((v.lower() for v in value.split() if MARKS.fullmatch(v)), None)
    return (f"{tag}.{mark}", True) if mark else (names, False)


class Page:
    """Blocks of one page: (path, text, in the main element); child sequences by path.

    A step of a path is ``name[k]`` for the k-th of that name below its parent, ``name[k]!`` if its
    kind or name rules it out.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, str, bool]] = []
        self.children: dict[str, int] = {}
        self._parts: list[str] = []
        places: dict[str, int] = {}
        stack: list[tuple[str, str, bool]] = [("", "", False)]  # tag, path, in main
        at, n, last = 0, len(html), html.rfind(">")
        raw: str | None = None
        while at < n:
            if raw:
                end = re.compile(rf"</{re.escape(raw)}(?![\w-])[^>]*>", re.I).search(html, at)
                at, raw = (end.end() if end else n), None
                continue
            m = TAG.search(html, at) if at <= last or "<!--" in html[at:] else None
            if m is None:
                self._parts.append(html[at:])
                break
            if m.start() > at:
                self._parts.append(html[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._close(stack, tag)
                continue
            if tag == "br":
                self._parts.append(" ")
                continue
            if tag not in INLINE:
                self._flush(stack)
                while len(stack) > 1:
                    k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] not in INLINE), 0)
                    if k and tag in CLOSES.get(stack[k][0], ()):
                        del stack[k:]
                    else:
                        break
                if tag == "hr":
                    continue
            if tag in VOID:
                continue
            _, path, main = stack[-1]
            if tag not in INLINE:
                name, marked = _name(tag, m[3])
                if tag in OUTER and not (tag == "article" and marked and ".comment" in name):  # readers' comments are articles as well
                    name, marked = tag, False
                self.children[path] = zlib.crc32(tag.encode(), self.children.get(path, 0))
                out = tag in DROPPED or (tag == "header" and not main) or marked
                if len(stack) <= DEEPEST:
                    path = f"{path}>{name}"
                    places[path] = places.get(path, 0) + 1
                    path = f"{path}[{places[path]}]{'!' if out else ''}"
                main = main or (tag in MAIN and not marked)
            if tag in RAW:
                raw = None if m[3].rstrip().endswith("/") else tag
                continue
            stack.append((tag, path, main))
        self._flush(stack)

    def _close(self, stack, tag: str) -> None:
        block = tag not in INLINE
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                if block:
                    self._flush(stack)
                del stack[k:]
                return
            if not block and stack[k][0] not in INLINE:
                return
        if tag == "p" or block:
            self._flush(stack)

    def _flush(self, stack) -> None:
        if self._parts:
            text = " ".join(entities.unescape("".join(self._parts)).split())
            self._parts.clear()
            if text:
                _, path, main = stack[-1]
                self.blocks.append((path, text, main))

    def text(self, low: frozenset[str] = frozenset(), own: frozenset[str] = frozenset()) -> str:
        """The kept blocks; a branch goes with any of its ancestors in ``low``, a block alone with its path in ``own``."""
        below = tuple(p + ">" for p in low if p.startswith(">"))
        kept = [(text, main) for path, text, main in self.blocks if path not in low and path not in own and not path.startswith(below) and not ("!" in path and node_of(path) in low)]
        only = OUTSIDE in low and any(main for _, main in kept)
        return "\n\n".join(text for text, main in kept if main or not only)


def node_of(path: str) -> str:
    """The tree's node of a block's path: the path, or the kind and name of what rules it out."""
    end = path.find("!")
    return path if end < 0 else path[path.rfind(">", 0, end) + 1 : path.rfind("[", 0, end)] + "!"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


FOLD = bytes.maketrans(b"123456789", b"000000000")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, marks of page, content and presentation), the pages of a batch together."""
    for batch in batches:
        seen: dict[tuple[str, str], list[tuple[int, int, int]]] = {}
        for i in range(batch.num_rows):
            host, html = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            page, body = Page(html), html.encode()
            whole = (zlib.crc32(body) << 32 | zlib.adler32(body)) - (1 << 63)
            own: dict[str, int] = {}
            for path, text, _ in page.blocks:
                own[path] = zlib.crc32(text.encode().translate(FOLD), own.get(path, 0))
            if any(main and "!" not in path for path, _, main in page.blocks):
                seen.setdefault((host, OUTSIDE), [])
            for path, mark in own.items():
                if "!" in path:  # ruled out whatever it holds
                    seen.setdefault((host, node_of(path)), [])
                else:
                    seen.setdefault((host, path), []).append((whole, mark, page.children.get(path, 0)))
        if seen:
            ends = pa.array([0, *itertools.accumulate(map(len, seen.values()))], pa.int32())
            flat = [*zip(*(m for marks in seen.values() for m in marks))] or [(), (), ()]
            lists = [pa.ListArray.from_arrays(ends, pa.array(c, pa.int64())) for c in flat]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([p for _, p in seen], pa.string()), *lists], names=["host", "path", "page", "content", "style"])


def style_tree(pages: DataFrame, url: str = "url", html: str = "html", least_pages: int = PAGES) -> DataFrame:
    """(host, path, pages, content, presentation, importance, composite) over all pages; equal pages of a host count once."""
    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    found = stored(rows.mapInArrow(_features, "host string, path string, page array<long>, content array<long>, style array<long>"), "features")
    at = F.xxhash64("path").alias("at")
    each = found.select("host", at, F.explode(F.arrays_zip("page", "content", "style")).alias("m")).select("host", "at", "m.*").distinct()

    def entropy(mark: str) -> DataFrame:
        counts = each.groupBy("host", "at", mark).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("host", "at").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s")).select("host", "at", "pages", F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0).alias(mark))

    both = entropy("content").join(entropy("style").drop("pages"), ["host", "at"])
    paths = found.groupBy("host", "path").agg(F.lit(1).alias("one")).select("host", "path", at)
    out = F.col("path").contains("!")
    importance = F.when(out, 0.0).when(F.col("pages") >= least_pages, F.greatest("content", "style")).otherwise(1.0)
    tree = paths.join(both, ["host", "at"], "left").select("host", "path", F.coalesce("pages", F.lit(0)).alias("pages"), "content", F.col("style").alias("presentation"), importance.alias("importance"))
    steps = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), ">"))
    spread = tree.select("host", F.explode(F.when(F.col("path").startswith(">"), above).otherwise(F.array("path"))).alias("above"), F.struct("path", "pages", "content", "presentation", "importance").alias("own"))
    merged = spread.groupBy("host", F.col("above").alias("path")).agg(F.max(F.when(F.col("above") == F.col("own.path"), F.col("own"))).alias("own"), F.max("own.importance").alias("composite"))
    return merged.where("own is not null").select("host", "path", *(f"own.{c}" for c in ("pages", "content", "presentation", "importance")), "composite")


def extract(pages: DataFrame, url: str = "url", html: str = "html", least_pages: int = PAGES, importance: float = IMPORTANCE) -> DataFrame:
    """Adds ``text`` and ``n_chars`` to every row, dropping ``html``.

    Null html is empty and gives an empty text, as do pages without an article's
    text; a null url is a host of its own name, the empty one. Rows that repeat are
    extracted each; columns named like the added ones are replaced, others are kept
    whatever their names. What a host's pages lose is one row a host, which Spark
    broadcasts only under its own measured limit.
    """
    pages = pages.drop(*({"text", "n_chars"} & set(pages.columns)))
    low = style_tree(pages, url, html, least_pages).where(F.col("importance") < importance)
    branch = F.col("composite") < importance
    low = stored(low.groupBy("host").agg(F.collect_list(F.when(branch, F.col("path"))).alias("low"), F.collect_list(F.when(~branch, F.col("path"))).alias("own")), "low")
    others = [c for c in pages.columns if c != html]
    rows_of = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").cast("string").alias("html"), F.struct(*([F.col(f"`{c}`") for c in others] or [F.lit(0)])).alias("row"))
    joined = rows_of.join(low, "host", "left").select("row", "html", "low", "own")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [Page(h or "").text(frozenset(low or ()), frozenset(own or ())) for h, low, own in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    done = joined.mapInArrow(rows, f"row {joined.schema['row'].dataType.simpleString()}, text string, n_chars long")
    return done.select(*(F.col(f"row.`{c}`").alias(c) for c in others), "text", "n_chars")
