"""Graph operators over ``nodes`` and ``edges`` tables.

A walk goes level by level: the frontier is joined with the stored edges, what was
seen before is left out by an anti join, and the new level is stored, until a level
is empty. No depth is fixed, cycles end by themselves, and a node that many ways lead
to is visited once. Rows never meet in one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, stored, together

CHILD, REFERENCE = "Child", "Reference"


def children(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, node_type, ord) along Child edges."""
    return edges.where(F.col("edge_type") == CHILD).join(nodes.select(F.col("node_id").alias("dst"), "node_type"), "dst").select("src", "dst", "node_type", "ord")


def references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, node_type) of references whose target exists."""
    return edges.where(F.col("edge_type") == REFERENCE).join(nodes.select(F.col("node_id").alias("dst"), "node_type"), "dst").select("src", "dst", "node_type")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """References whose target does not exist."""
    return edges.where(F.col("edge_type") == REFERENCE).join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_anti").select("src", "dst")


def parents(edges: DataFrame) -> DataFrame:
    """(node_id, parent): the source of a node's first incoming Child edge."""
    return edges.where(F.col("edge_type") == CHILD).groupBy(F.col("dst").alias("node_id")).agg(F.min_by("src", F.struct("ord", "src")).alias("parent"))


def siblings(edges: DataFrame) -> DataFrame:
    """(node_id, place, of): 1-based position among the children of its parent."""
    own = Window.partitionBy("src").orderBy("ord", "dst")
    return edges.where(F.col("edge_type") == CHILD).select(F.col("dst").alias("node_id"), F.row_number().over(own).alias("place"), F.col("src").alias("of"))


def walk(edges: DataFrame, start: DataFrame, max_depth: int | None = None, step: str | None = None) -> DataFrame:
    """(origin, node_id, depth) of everything reachable from ``start`` (node_id), itself at depth 0, each once at its least depth.

    With ``step``, the name of a column of ``edges`` and ``start``, a ``path`` comes too:
    the steps from the origin, slash-separated (of several shortest ways the least).
    Starts and edges that repeat count once.
    """
    extra = [step] if step else []
    kids = stored(edges.select("src", "dst", *(F.col(c).alias("step") for c in extra)).where("src is not null and dst is not null").distinct(), "edges")
    path = [F.col(step).alias("path")] if step else []
    level = stored(start.select(F.col("node_id").alias("origin"), "node_id", F.lit(0).alias("depth"), *path).distinct(), "level")
    levels, depth = [level], 0
    while (max_depth is None or depth < max_depth) and not level.isEmpty():
        depth += 1
        ways = level.select("origin", F.col("node_id").alias("src"), *(F.col("path") for _ in extra)).join(kids, "src")
        path = [F.min(F.concat_ws("/", "path", "step")).alias("path")] if step else []
        found = ways.groupBy("origin", F.col("dst").alias("node_id")).agg(F.lit(depth).alias("depth"), *path)
        level = stored(found.join(together(levels).select("origin", "node_id"), ["origin", "node_id"], "left_anti").select(*level.columns), "level")
        levels.append(level)
    forget(kids)
    return together(levels)


def descendants(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(origin, node_id, depth): the Child closure without the origin itself."""
    return walk(edges.where(F.col("edge_type") == CHILD), start, max_depth).where("depth > 0")


def ancestors(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(origin, node_id, depth): the chain of parents of each start node.

    Many nodes share few parents, so parents are told apart level by level, each node's
    once, and what is above a level is joined with it only when the rows are read. From
    a level that has more than half as many parents as nodes on, they are walked.
    """
    up = edges.where(F.col("edge_type") == CHILD).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if max_depth is not None:
        return walk(up, start, max_depth).where("depth > 0")
    up = stored(up.where("src is not null and dst is not null"), "edges")
    levels, heads = [], start.select("node_id")
    while True:
        by = stored(heads.select(F.col("node_id").alias("src")).join(up, "src").groupBy(F.col("src").alias("origin")).agg(F.collect_set("dst").alias("parents")), "parents")
        heads = stored(by.select(F.explode("parents").alias("node_id")).distinct(), "parents")
        levels.append((by, heads))
        n, more = by.count(), heads.count()
        if not more or more * 2 > n:
            break
    above = walk(up, heads) if more else None
    forget(up)
    for by, heads in reversed(levels):
        own = heads.select(F.col("node_id").alias("origin"), "node_id", F.lit(0).alias("depth"))
        known = own if above is None else above if by is levels[-1][0] else own.unionByName(above)
        pairs = by.select("origin", F.explode("parents").alias("parent"))
        found = pairs.join(known.select(F.col("origin").alias("parent"), "node_id", (F.col("depth") + 1).alias("depth")), "parent").where("node_id <> origin").select("origin", "node_id", "depth")
        if not by.where(F.size("parents") > 1).isEmpty():
            found = found.groupBy("origin", "node_id").agg(F.min("depth").alias("depth"))
        above = found
    return above


def would_create_cycle(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (node_id, new_parent) with ``cycle``: whether the new parent is the node itself or under it."""
    under = walk(edges.where(F.col("edge_type") == CHILD), moves.select("node_id"))
    reached = under.select(F.col("origin").alias("node_id"), F.col("node_id").alias("new_parent"), F.lit(True).alias("cycle"))
    return moves.join(reached, ["node_id", "new_parent"], "left").select(*moves.columns, F.coalesce("cycle", F.lit(False)).alias("cycle"))


def page_numbers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, page, page_number) for every node at or under a Page: the nearest one and its place among its siblings."""
    pages = nodes.where(F.col("node_type") == "Page").select("node_id")
    under = walk(edges.where(F.col("edge_type") == CHILD), pages).groupBy("node_id").agg(F.min_by("origin", F.struct("depth", "origin")).alias("page"))
    return under.join(siblings(edges).select(F.col("node_id").alias("page"), F.col("place").alias("page_number")), "page").select("node_id", "page", F.col("page_number").cast("long"))


def cyclic(edges: DataFrame) -> DataFrame:
    """Edges that lie on or lead into no sink: what stays when nodes without out-edges are peeled off again and again.

    Each round is a semi join; an acyclic graph is empty after as many rounds as it
    is deep. The loop ends as soon as a round takes nothing.
    """
    left = stored(edges.select("src", "dst"), "peeled")
    before = left.count()
    while before:
        rest = stored(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "peeled")
        now = rest.count()
        forget(left)
        left = rest
        if now == before:
            break
        before = now
    return left


def remove_subtree(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the given roots and all under them."""
    gone = walk(edges.where(F.col("edge_type") == CHILD), roots).select("node_id").distinct()
    kept = nodes.join(gone, "node_id", "left_anti")
    ends = edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return kept, ends.select(*edges.columns)


def move_subtree(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """``edges`` with every node of ``moves`` (node_id, new_parent) under its new parent, after the children it has."""
    moved = moves.select(F.col("node_id").alias("dst"), "new_parent")
    out = edges.join(moved, "dst", "left")
    child = (F.col("edge_type") == CHILD) & F.col("new_parent").isNotNull()
    return out.select(F.when(child, F.col("new_parent")).otherwise(F.col("src")).alias("src"), "dst", "edge_type", "ord")


def merge_nodes(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with each ``source`` of ``merges`` (source, target) gone and its edges given to ``target``."""
    kept = nodes.join(merges.select(F.col("source").alias("node_id")), "node_id", "left_anti")
    a = merges.select(F.col("source").alias("src"), F.col("target").alias("new_src"))
    b = merges.select(F.col("source").alias("dst"), F.col("target").alias("new_dst"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "edge_type", "ord")
    return kept, moved.where("src <> dst").dropDuplicates(["src", "dst", "edge_type"])


def content_ids(nodes: DataFrame) -> DataFrame:
    """(node_id, content_id): a digest of type and properties with sorted keys, equal for equal content."""
    pairs = F.array_sort(F.map_entries("props"))
    text = F.concat_ws("|", "node_type", F.expr("array_join(transform(array_sort(map_entries(props)), e -> concat(e.key, '=', e.value)), ';')"))
    return nodes.where(F.size(pairs) >= 0).select("node_id", F.sha2(text, 256).alias("content_id"))


def replace_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with those of ``new`` (node_id, node_type, props) in place of theirs; unknown ids change nothing, children stay."""
    given = new.select("node_id", F.col("node_type").alias("new_type"), F.col("props").alias("new_props"), F.lit(True).alias("given"))
    out = nodes.join(given, "node_id", "left")
    swap = {"node_type": F.when(F.col("given"), F.col("new_type")).otherwise(F.col("node_type")), "props": F.when(F.col("given"), F.col("new_props")).otherwise(F.col("props"))}
    return out.select(*(swap.get(c, F.col(c)).alias(c) for c in nodes.columns))


def insert_nodes(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the rows of ``new`` (parent and the columns of ``nodes``) added below parents that exist, after the children they have."""
    fit = new.join(nodes.select(F.col("node_id").alias("parent")), "parent", "left_semi").join(nodes.select("node_id"), "node_id", "left_anti")
    last = edges.where(F.col("edge_type") == CHILD).groupBy(F.col("src").alias("parent")).agg(F.max("ord").alias("last"))
    place = F.row_number().over(Window.partitionBy("parent").orderBy("node_id"))
    placed = fit.join(last, "parent", "left").select(F.col("parent").alias("src"), F.col("node_id").alias("dst"), F.lit(CHILD).alias("edge_type"), (F.coalesce("last", F.lit(-1)) + place).cast("long").alias("ord"))
    return nodes.unionByName(fit.select(*nodes.columns)), edges.unionByName(placed)


def clone_subtrees(nodes: DataFrame, edges: DataFrame, clones: DataFrame, suffix: str = "'") -> tuple[DataFrame, DataFrame]:
    """The nodes and edges to add for copies of subtrees: ``clones`` (node_id, new_parent); a copy's id is the old one and ``suffix``.

    A node that several clones hold, because they overlap or one is asked for twice, gets
    as many suffixes as its place among them (by clone and new parent). Child edges inside
    a subtree are copied with its nodes; references keep their targets.
    """
    asked = clones.select(F.col("node_id").alias("origin"), "new_parent").distinct()
    under = walk(edges.where(F.col("edge_type") == CHILD), clones.select("node_id")).select("origin", "node_id").join(asked, "origin")
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy("origin", "new_parent"))
    copied = stored(under.withColumn("copy", F.concat("node_id", F.repeat(F.lit(suffix), nth))), "copies")
    copies = nodes.join(copied.select("node_id", "copy"), "node_id").withColumn("node_id", F.col("copy")).select(*nodes.columns)
    own = copied.select("origin", "new_parent", F.col("node_id").alias("src"), F.col("copy").alias("new_src")).join(edges, "src")
    target = copied.select("origin", "new_parent", F.col("node_id").alias("dst"), F.col("copy").alias("new_dst"))
    joined = own.join(target, ["origin", "new_parent", "dst"], "left")
    inner = joined.select(F.col("new_src").alias("src"), F.when(F.col("edge_type") == CHILD, F.col("new_dst")).otherwise(F.col("dst")).alias("dst"), "edge_type", "ord")
    outer = copied.where("node_id = origin").select(F.col("new_parent").alias("src"), F.col("copy").alias("dst"), F.lit(CHILD).alias("edge_type"), F.lit(0).cast("long").alias("ord"))
    return copies, inner.unionByName(outer).select(*edges.columns)


#: Which types a parent takes below it, as far as a rule names them.
ALLOWED = {"Catalog": ["Pages", "Outline", "Metadata", "Other"], "Pages": ["Pages", "Page"]}


def validate_moves(nodes: DataFrame, edges: DataFrame, moves: DataFrame) -> DataFrame:
    """(node_id, new_parent, problem) of the moves that may not be made: an end that does not exist, a cycle, a type that does not belong there."""
    types = lambda name: nodes.select(F.col("node_id").alias(name), F.col("node_type").alias(f"{name}_type"))
    checked = would_create_cycle(edges, moves).join(types("node_id"), "node_id", "left").join(types("new_parent"), "new_parent", "left")
    allowed = F.create_map(*(x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("new_parent_type")]
    problem = F.when(F.col("node_id_type").isNull() | F.col("new_parent_type").isNull(), "missing").when(F.col("cycle"), "cycle").when(~F.array_contains(allowed, F.col("node_id_type")), "type")
    return checked.select("node_id", "new_parent", problem.alias("problem")).where("problem is not null")


def tree_entries(trees: DataFrame, kids: DataFrame, entries: DataFrame) -> DataFrame:
    """(tree, key, value) of name or number trees: ``trees`` (tree, node_id of the root), ``kids`` (src, dst), ``entries`` (node_id, key, value).

    Of keys that repeat in a tree the one at the least depth (then of the least node) counts.
    """
    reached = walk(kids, trees.select("node_id"))
    own = reached.join(entries, "node_id").join(trees.select("tree", F.col("node_id").alias("origin")), "origin")
    return own.groupBy("tree", "key").agg(F.min_by("value", F.struct("depth", "node_id")).alias("value"))


def tree_lookup(trees: DataFrame, limits: DataFrame, kids: DataFrame, entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(tree, key, value) of ``asked`` (tree, key), going down only into nodes whose ``limits`` (node_id, low, high) hold the key.

    A node is looked at once for a key, so that trees with cycles end; of several values the least counts.
    """
    at = asked.join(trees, "tree")
    level, levels = at.select("tree", "key", "node_id").distinct(), []
    kids = stored(kids.select(F.col("src").alias("node_id"), "dst").join(limits.withColumnRenamed("node_id", "dst"), "dst", "left"), "limits")
    while True:
        level = stored(level, "lookup")
        levels.append(level)
        if level.isEmpty():
            break
        inside = F.col("low").isNull() | F.col("key").between(F.col("low"), F.col("high"))
        below = level.join(kids, "node_id").where(inside).select("tree", "key", F.col("dst").alias("node_id")).distinct()
        level = below.join(together(levels), ["tree", "key", "node_id"], "left_anti")
    return together(levels).join(entries, ["node_id", "key"]).groupBy("tree", "key").agg(F.min("value").alias("value"))
