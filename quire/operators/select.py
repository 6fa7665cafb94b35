"""Selectors over the node graph: a small query language compiled to DataFrame plans.

A selector is an expression object; ``nodes(...)`` gives the DataFrame of its node
ids. ``parse`` reads the text form: ``a > b`` (child), ``a b`` (descendant),
``a, b`` (or), ``type``, ``#obj.gen``, ``[key]``, ``[key=value]``, and after a type
``:first``, ``:last``, ``:nth-child(n)`` (0-based) for the position among siblings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

#: Type names of the query language.
TYPES = {"root": "Root", "catalog": "Catalog", "pages": "Pages", "page": "Page", "font": "Font", "image": "Image", "annotation": "Annotation", "form": "Form", "outline": "Outline", "struct": "StructElem"}


@dataclass(frozen=True)
class Selector:
    """One arm of the language; ``args`` are selectors or plain values."""

    kind: str
    args: tuple = ()

    def __and__(self, other: "Selector") -> "Selector":
        return Selector("and", (self, other))

    def __or__(self, other: "Selector") -> "Selector":
        return Selector("or", (self, other))

    def __invert__(self) -> "Selector":
        return Selector("not", (self,))

    def child(self, other: "Selector") -> "Selector":
        return Selector("child", (self, other))

    def descendant(self, other: "Selector") -> "Selector":
        return Selector("descendant", (self, other))


def of_type(name: str) -> Selector:
    return Selector("type", (TYPES.get(name.lower(), name),))


def has(key: str) -> Selector:
    return Selector("has", (key,))


def equals(key: str, value: str) -> Selector:
    return Selector("equals", (key, value))


def matches(key: str, pattern: str) -> Selector:
    return Selector("matches", (key, pattern))


def place(inner: Selector, first: int, end: int | None) -> Selector:
    """Of ``inner``, nodes at places first to end (exclusive) among their siblings; negative places count from the last."""
    return Selector("place", (inner, first, end))


def parse(text: str) -> Selector:
    """Commas bind loosest, then spaces and ``>``; raises ValueError for what is not in the language."""
    arms = [part.strip() for part in text.split(",")]
    if not all(arms):
        raise ValueError(f"empty selector in {text!r}")
    return reduce(lambda a, b: a | b, map(_chain, arms))


def _chain(text: str) -> Selector:
    words = re.findall(r">|[^\s>]+", text)
    out, join = None, "descendant"
    for word in words:
        if word == ">":
            join = "child"
            continue
        one = _simple(word)
        out = one if out is None else Selector(join, (out, one))
        join = "descendant"
    if out is None or words[-1] == ">":
        raise ValueError(f"incomplete selector {text!r}")
    return out


def _simple(word: str) -> Selector:
    found = re.fullmatch(r"(#\d+(?:\.\d+)?|[A-Za-z]*)((?:\[[^\]]+\])*)(:first|:last|:nth-child\((\d+)\))?", word)
    if not found or not word:
        raise ValueError(f"bad selector {word!r}")
    name, keys, where, n = found.groups()
    parts = []
    if name.startswith("#"):
        parts.append(Selector("object", (int(name[1:].split(".")[0]),)))
    elif name:
        parts.append(of_type(name))
    for key in re.findall(r"\[([^\]]+)\]", keys):
        k, eq, v = key.partition("=")
        parts.append(equals(k, v) if eq else has(k))
    if not parts:
        raise ValueError(f"bad selector {word!r}")
    out = reduce(lambda a, b: a & b, parts)
    if where == ":first":
        return place(out, 0, 1)
    if where == ":last":
        return place(out, -1, None)
    return place(out, int(n), int(n) + 1) if where else out


def _predicate(s: Selector) -> Column | None:
    """A filter for what one pass over the nodes can decide."""
    if s.kind == "type":
        return F.col("node_type") == s.args[0]
    if s.kind == "object":
        return F.col("obj") == s.args[0]
    if s.kind == "has":
        return F.map_contains_key("props", s.args[0])
    if s.kind == "equals":
        return F.coalesce(F.col("props")[s.args[0]] == s.args[1], F.lit(False))
    if s.kind == "matches":
        return F.coalesce(F.col("props")[s.args[0]].rlike(s.args[1]), F.lit(False))
    if s.kind in ("and", "or"):
        both = [_predicate(a) for a in s.args]
        return None if any(b is None for b in both) else (both[0] & both[1] if s.kind == "and" else both[0] | both[1])
    if s.kind == "not":
        inner = _predicate(s.args[0])
        return None if inner is None else ~inner
    return None


def select(s: Selector, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id) of the nodes that ``s`` selects, each once; arms without joins stay one filtered scan."""
    predicate = _predicate(s)
    if predicate is not None:
        return nodes.where(predicate).select("node_id")
    child = edges.where(F.col("edge_type") == graph.CHILD)
    if s.kind == "and":
        return select(s.args[0], nodes, edges).join(select(s.args[1], nodes, edges), "node_id", "left_semi")
    if s.kind == "or":
        return select(s.args[0], nodes, edges).union(select(s.args[1], nodes, edges)).distinct()
    if s.kind == "not":
        return nodes.select("node_id").join(select(s.args[0], nodes, edges), "node_id", "left_anti")
    if s.kind == "place":
        inner, first, end = s.args
        placed = graph.siblings(edges).select("node_id", "of", (F.col("place") - 1).alias("at"))
        if first < 0:
            last = child.groupBy(F.col("src").alias("of")).agg(F.count(F.lit(1)).alias("n"))
            placed = placed.join(last, "of").where(F.col("at") == F.col("n") + first)
        else:
            placed = placed.where((F.col("at") >= first) & (F.col("at") < end if end is not None else F.lit(True)))
        return select(inner, nodes, edges).join(placed.select("node_id"), "node_id", "left_semi")
    left, right = (select(a, nodes, edges) for a in s.args)
    if s.kind == "child":
        under = child.join(left.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node_id"))
        return right.join(under, "node_id", "left_semi")
    if s.kind == "descendant":
        return right.join(graph.descendants(edges, left).select("node_id").distinct(), "node_id", "left_semi")
    if s.kind == "parent":
        over = child.join(left.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node_id"))
        return right.join(over, "node_id", "left_semi")
    if s.kind == "ancestor":
        return right.join(graph.ancestors(edges, left).select("node_id").distinct(), "node_id", "left_semi")
    if s.kind == "sibling":
        mine = child.join(left.select(F.col("node_id").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.min("dst").alias("a"), F.max("dst").alias("b"))
        others = child.join(mine, "src").where((F.col("dst") != F.col("a")) | (F.col("dst") != F.col("b"))).select(F.col("dst").alias("node_id"))
        return right.join(others, "node_id", "left_semi")
    raise ValueError(f"unknown selector {s.kind!r}")
