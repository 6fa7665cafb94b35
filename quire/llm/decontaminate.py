"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names (capitalised words that do not begin a sentence) and units become
typed placeholders, so a question keeps its template when its values change.
Windows of ``window`` canonical words of every text are hash-joined with those of
the benchmark items (items of four words or more; shorter ones than a window count
as one window of their own length). Whether a sentence's first word counts as a name
depends on what comes before it, so an item's windows are indexed with these words
in both forms. A window with literal words for less than half of its length is
looked for with its slots' values. A text holds an item if the windows found in it
cover ``coverage`` of all the item's windows, or of those that need no values, and,
along the best alignment, the slots are consistent: equal values of the item stand
for equal values of the text (different ones may too). Equal slots mean a verbatim
copy, others a re-parameterised one.

The item windows are the small side; Spark broadcasts them only under its own
measured size limit and shuffles by window hash beyond it. They are one row a
hash, so a window that every text holds does not multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

WINDOW, COVERAGE, LEAST_WORDS = 8, 0.6, 4
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"  # private-use characters, taken out of texts first
SLOTS = f"{NAME}-{UNIT}"
NAMES = r"(?<=[^.!?\s]\s)\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
#: Capitalised words that are names if the text before them says so.
STARTS = rf"(?<![\p{{L}}\p{{N}}{SLOTS}])\p{{Lu}}\p{{Ll}}+(?![\p{{L}}\p{{N}}])"
NUMBERS = r"\p{N}++(?:[.,]\p{N}++)*+"  # possessive: the engine loops; otherwise it recurses once a part
#: Unit words.
UNITS = r"(?i)(?<![\p{L}\p{N}" + SLOTS + r"])(?:km|cm|mm|kg|mg|lbs?|oz|ml|miles?|met(?:er|re)s?|kilomet(?:er|re)s?|inch(?:es)?|feet|yards?|grams?|kilograms?|lit(?:er|re)s?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent)(?![\p{L}\p{N}])"
#: Points and commas part words except between digits.
BREAK = rf"[^\p{{L}}\p{{N}}{SLOTS}.,]+|[.,](?!\p{{N}})|(?<!\p{{N}})[.,]"


def _tagged(text: Column, keep: bool, starts: bool = False) -> Column:
    value = "$0" if keep else ""
    out = F.regexp_replace(F.regexp_replace(text, f"[{SLOTS}]", " "), NAMES, f" {NAME}{value} ")
    if starts:
        out = F.regexp_replace(out, STARTS, f" {NAME}{value} ")
    out = F.regexp_replace(out, UNITS, f" {UNIT}{value} ")
    return F.regexp_replace(out, rf"(?<![{SLOTS}\p{{L}}])" + NUMBERS if keep else NUMBERS, f" {NUMBER}{value} ")


def canonical_words(text: Column, starts: bool = False) -> Column:
    """Lower-case words of ``text`` with a one-letter placeholder for each slot; with ``starts`` sentences' first words are names too."""
    return F.array_remove(F.split(F.lower(_tagged(text, False, starts)), BREAK), "")


def slot_words(text: Column) -> Column:
    """The same words in the same places, slots as their placeholder and value."""
    return F.array_remove(F.split(F.lower(_tagged(text, True)), BREAK), "")


def plain_words(text: Column) -> Column:
    """The same words in the same places, slots as their value alone."""
    return F.transform(slot_words(text), lambda w: F.regexp_replace(w, f"^[{SLOTS}]", ""))


def _literal(words: Column, at: Column, width) -> Column:
    """Whether at least half of the ``width`` words from place ``at`` on are literal."""
    return F.size(F.filter(F.slice(words, at + 1, width), lambda w: ~w.rlike(f"^[{SLOTS}]$"))) * 2 >= width


def window_hashes(words: Column, width: int) -> Column:
    """One hash for every run of ``width`` words, in order."""

    def hashes(w: Column) -> Column:
        places = F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - (width - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.slice(w, i, width)))

    return let(words, hashes)


def _row(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{key}`").alias("key"), body.alias("body")).withColumn("row", F.struct(F.xxhash64("key", "body").alias("r1"), F.hash("body", "key").alias("r2")))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(key, item_id, n_windows, n_found, coverage, offset, n_slots, verbatim, row) of every item held by a row of ``docs``.

    ``coverage`` is the greater of the two shares, of all windows and of those that need no values.
    ``offset`` is the first word of the item within the text's words (best
    alignment; of equals the first). Null or empty texts hold nothing, items with a
    null text or under four words are never held. Rows that repeat are reported
    once; items that repeat are reported each. Other columns of both tables are left
    out, whatever their names.
    """
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("item_text")).distinct()
    items = items.withColumn("words", canonical_words(F.col("item_text"))).where(F.size("words") >= LEAST_WORDS)
    items = items.withColumn("width", F.least(F.lit(window), F.size("words")))
    marked = canonical_words(F.col("item_text"), True)
    items = items.withColumn("marked", F.when(F.size(marked) == F.size("words"), marked).otherwise(F.col("words")))
    items = items.withColumn("first", F.concat(F.slice("marked", 1, 1), F.slice("words", 2, F.size("words"))))
    items = items.withColumn("rest", F.concat(F.slice("words", 1, 1), F.slice("marked", 2, F.size("words"))))
    places = F.sequence(F.lit(0), F.size("words") - F.col("width"))
    valued = F.exists(places, lambda i: ~(_literal(F.col("words"), i, F.col("width")) & _literal(F.col("first"), i, F.col("width"))))
    widths: dict[int, bool] = {}
    for r in items.select("width", valued.alias("valued")).distinct().collect():  # at most two rows for each of `window` numbers
        widths[r["width"]] = widths.get(r["width"], False) or r["valued"]
    rows = _row(docs, key, text)
    found = None
    for width in sorted(widths):
        of_width = items.where(F.col("width") == width)
        own = of_width.select("item_id", "words", F.explode(F.array_distinct(F.array("words", "first", "rest", "marked"))).alias("form"))
        own = own.select("item_id", "words", "form", F.posexplode(window_hashes(F.col("form"), width)).alias("at", "window")).where(_literal(F.col("form"), F.col("at"), width))
        kinds = [(own, canonical_words)]
        if widths[width]:
            own = of_width.select("item_id", "words", "first", F.posexplode(window_hashes(plain_words(F.col("item_text")), width)).alias("at", "window"))
            kinds.append((own.where(~(_literal(F.col("words"), F.col("at"), width) & _literal(F.col("first"), F.col("at"), width))), plain_words))
        for own, as_words in kinds:
            own = own.select("window", "item_id", "at", _literal(F.col("words"), F.col("at"), width).alias("free")).groupBy("window").agg(F.collect_set(F.struct("item_id", "at", "free")).alias("places"))
            parted = rows.select("row", as_words(F.col("body")).alias("words"))
            spread = parted.select("row", F.posexplode(window_hashes(F.col("words"), width)).alias("place", "window"))
            hits = spread.join(own, "window").select("row", "place", F.explode("places").alias("p")).select("row", "p.item_id", "p.at", "p.free", (F.col("place") - F.col("p.at")).alias("offset"))
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = rows.select("row", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("at"), F.lit(False).alias("free"), F.lit(0).alias("offset")).where("false")
    lines = found.groupBy("row", "item_id", "offset").agg(F.collect_set("at").alias("ats"), F.collect_set(F.when(F.col("free"), F.col("at"))).alias("free"))
    held = lines.groupBy("row", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n_found"), F.size(F.array_distinct(F.flatten(F.collect_list("free")))).alias("n_free_found"), F.max_by("offset", F.struct(F.size("ats"), -F.col("offset"))).alias("offset"))
    free = F.size(F.filter(places, lambda i: _literal(F.col("words"), i, F.col("width"))))
    sized = items.select("item_id", "item_text", "marked", (F.size("words") - F.col("width") + 1).alias("n_windows"), free.alias("n_free"))
    share = F.greatest(F.col("n_found") / F.col("n_windows"), F.when(F.col("n_free") > 0, F.col("n_free_found") / F.col("n_free")))
    held = held.join(sized, "item_id").withColumn("share", share).where(F.col("share") >= coverage)

    def aligned(mine: Column, theirs: Column) -> Column:
        """(item's slot, text's slot) where both have a slot of one type; a first word that the text has as a name is a slot."""
        inside = F.filter(F.sequence(F.lit(0), F.size(theirs) - 1), lambda i: (i + F.col("offset") >= 0) & (i + F.col("offset") < F.size(mine)))
        first = lambda i: (F.get("marked", i) == NAME) & ~F.get(theirs, i).rlike(f"^[{SLOTS}]")
        slot = lambda i: F.when(first(i), F.concat(F.lit(NAME), F.get(theirs, i))).otherwise(F.get(theirs, i))
        pairs = F.transform(inside, lambda i: F.struct(slot(i).alias("a"), F.get(mine, i + F.col("offset")).alias("b")))
        return F.filter(pairs, lambda p: p["a"].rlike(f"^[{SLOTS}]") & (F.substring(p["a"], 1, 1) == F.substring(p["b"], 1, 1)))

    both = rows.join(held, "row")
    both = both.withColumn("slots", let(slot_words(F.col("body")), lambda mine: let(slot_words(F.col("item_text")), lambda theirs: aligned(mine, theirs))))
    kinds = F.size(F.array_distinct("slots"))
    consistent = kinds == F.size(F.array_distinct(F.col("slots.a")))
    out = both.where(consistent).dropDuplicates(["row", "item_id", "item_text"])
    return out.select(F.col("key").alias(key), "item_id", F.col("n_windows").cast("long"), F.col("n_found").cast("long"), F.round("share", 4).alias("coverage"), F.col("offset").cast("long"), F.size("slots").cast("long").alias("n_slots"), (~F.exists("slots", lambda p: p["a"] != p["b"])).alias("verbatim"), "row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged whatever their names; null and empty texts stay."""
    bad = contamination(docs, benchmark, key, text, **settings).select("row.*").distinct()
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    keyed = docs.select(whole, F.xxhash64(F.col(f"`{key}`"), body).alias("r1"), F.hash(body, F.col(f"`{key}`")).alias("r2"))
    return keyed.join(bad, ["r1", "r2"], "left_anti").select("whole.*")
