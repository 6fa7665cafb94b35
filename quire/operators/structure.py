"""Structure of documents beyond the node graph: names, outlines, optional content, resources, fonts, metadata, security."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph


def outline_items(items: DataFrame) -> DataFrame:
    """(item, level, path, place) of outline rows (item, parent, ord), roots with a null parent: levels from 0, the items from the root, and the
    places among siblings (by ord, then item) from the root, which sort in reading order."""
    own = Window.partitionBy("parent").orderBy("ord", "item")
    step = F.concat(F.lpad(F.row_number().over(own), 10, "0"), F.lit("\u0001"), "item")
    placed = items.withColumn("step", step)
    edges = placed.where("parent is not null").select(F.col("parent").alias("src"), F.col("item").alias("dst"), "step")
    walked = graph.walk(edges, placed.where("parent is null").select(F.col("item").alias("node_id"), "step"), step="step")
    part = lambda k: F.array_join(F.transform(F.split("path", "/"), lambda x: F.get(F.split(x, "\u0001"), F.lit(k))), "/")
    return walked.select(F.col("node_id").alias("item"), F.col("depth").alias("level"), part(1).alias("path"), part(0).alias("place"))


def inherited(chain: DataFrame) -> DataFrame:
    """(node_id, resources) of (node_id, level, resources): maps merged from level 0 down, the deepest entry of a key wins."""
    each = chain.select("node_id", "level", F.explode("resources").alias("key", "value"))
    last = each.groupBy("node_id", "key").agg(F.max_by("value", "level").alias("value"))
    return last.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("resources"))


def visible_groups(groups: DataFrame) -> DataFrame:
    """(doc_id, group_id) shown of (doc_id, group_id, base_on, listed_on, listed_off, radio): lists override the base state, a radio group shows its first."""
    shown = groups.where((F.col("base_on") & ~F.col("listed_off")) | F.col("listed_on"))
    first = shown.where("radio is not null").groupBy("doc_id", "radio").agg(F.min("group_id").alias("group_id"))
    return shown.where("radio is null").select("doc_id", "group_id").unionByName(first.select("doc_id", "group_id"))


def membership(policy: Column, states: Column) -> Column:
    """Visibility of a membership dictionary from its groups' states."""
    on, off = lambda s: s, lambda s: ~s
    return F.when(policy == "AllOn", F.forall(states, on)).when(policy == "AnyOff", F.exists(states, off)).when(policy == "AllOff", F.forall(states, off)).otherwise(F.exists(states, on))


def cmap_ranges(cmaps: DataFrame) -> DataFrame:
    """(cmap_id, first, last, head, unit) of CMap texts (cmap_id, text): bfrange rows, their arrays element by element, and bfchar rows as ranges of one.

    What a code stands for is UTF-16BE: ``head`` in hex, then the 16-bit ``unit`` to which a code's distance from ``first`` is added.
    """
    hexa = r"<([0-9A-Fa-f]+)>\s*"
    listed = hexa * 2 + r"\[([^\]]*)\]"
    inner = lambda kind: F.array_join(F.regexp_extract_all("text", F.lit(rf"(?s)begin{kind}(.*?)end{kind}"), 1), "\n")
    number = lambda s: F.conv(s, 16, 10).cast("long")

    def each(body: Column, pattern: str) -> DataFrame:
        return cmaps.select("cmap_id", F.explode(F.regexp_extract_all(body, F.lit(f"({pattern})"), 1)).alias("row"))

    part = lambda pattern, k: F.regexp_extract("row", pattern, k)
    plain = each(F.regexp_replace(inner("bfrange"), listed, ""), hexa * 3).select("cmap_id", number(part(hexa * 3, 1)).alias("first"), number(part(hexa * 3, 2)).alias("last"), part(hexa * 3, 3).alias("to"))
    lists = each(inner("bfrange"), listed).select("cmap_id", number(part(listed, 1)).alias("first"), F.posexplode(F.regexp_extract_all(part(listed, 3), F.lit(hexa), 1)).alias("at", "to"))
    lists = lists.select("cmap_id", (F.col("first") + F.col("at")).alias("first"), (F.col("first") + F.col("at")).alias("last"), "to")
    single = each(inner("bfchar"), hexa * 2).select("cmap_id", number(part(hexa * 2, 1)).alias("first"), number(part(hexa * 2, 1)).alias("last"), part(hexa * 2, 2).alias("to"))
    both = plain.unionByName(lists).unionByName(single).withColumn("to", F.when(F.length("to") < 4, F.lpad("to", 4, "0")).otherwise(F.col("to")))
    return both.select("cmap_id", "first", "last", F.expr("substring(to, 1, length(to) - 4)").alias("head"), number(F.expr("substring(to, -4, 4)")).alias("unit"))


def decode_codes(codes: DataFrame, ranges: DataFrame, width: int = 256) -> DataFrame:
    """``codes`` (…, cmap_id, code) with ``char``, null where no range holds the code: a range join on buckets of ``width`` codes, so that it stays an equi-join."""
    spread = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    own = codes.withColumn("bucket", F.floor(F.col("code") / width))
    inside = (own["cmap_id"] == spread["cmap_id"]) & (own["bucket"] == spread["bucket"]) & own["code"].between(spread["first"], spread["last"])
    found = own.join(spread, inside, "left").drop(spread["cmap_id"])
    units = F.concat("head", F.lpad(F.hex(F.col("unit") + F.col("code") - F.col("first")), 4, "0"))
    return found.select(*codes.columns, F.decode(F.unhex(units), "UTF-16BE").alias("char"))


def xmp_properties(packets: DataFrame) -> DataFrame:
    """(doc_id, key, value): properties of XMP packets (doc_id, packet) with their prefixes: plain ones, each item of alternatives, lists and bags, attributes of descriptions."""
    name = r"[A-Za-z_][\w.-]*:[A-Za-z_][\w.-]*"
    simple, items = rf"<({name})(?:\s[^>]*)?>([^<]*)</\1>", rf"(?s)<({name})(?:\s[^>]*)?>\s*<rdf:(?:Alt|Seq|Bag)>(.*?)</rdf:(?:Alt|Seq|Bag)>\s*</\1>"
    item, described, attribute = r"(?s)<rdf:li(?:\s[^>]*)?>(.*?)</rdf:li>", r"(?s)<rdf:Description\s([^>]*)>", rf"({name})\s*=\s*[\"']([^\"']*)[\"']"
    row = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    every = lambda text, pattern, k=0: F.regexp_extract_all(text, F.lit(pattern), k)
    plain = F.transform(every(F.col("packet"), simple), lambda x: row(F.regexp_extract(x, simple, 1), F.regexp_extract(x, simple, 2)))
    listed = F.flatten(F.transform(every(F.col("packet"), items), lambda x: F.transform(every(F.regexp_extract(x, items, 2), item, 1), lambda v: row(F.regexp_extract(x, items, 1), v))))
    given = F.transform(F.flatten(F.transform(every(F.col("packet"), described, 1), lambda x: every(x, attribute))), lambda x: row(F.regexp_extract(x, attribute, 1), F.regexp_extract(x, attribute, 2)))
    each = packets.select("doc_id", F.explode(F.concat(plain, listed, given)).alias("x")).select("doc_id", "x.*").where("key not like 'rdf:%' and key not like 'xmlns:%' and key not like 'xml:%'")
    text = F.col("value")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return each.select("doc_id", "key", text.alias("value"))


#: XMP properties and the Info entries that say the same.
LABELS = {"dc:title": "Title", "dc:creator": "Author", "dc:description": "Subject", "pdf:Keywords": "Keywords", "xmp:CreatorTool": "Creator", "pdf:Producer": "Producer", "xmp:CreateDate": "CreationDate", "xmp:ModifyDate": "ModDate"}


def incoherent(xmp: DataFrame, info: DataFrame) -> DataFrame:
    """(doc_id, label, xmp, info) where both sides have a value and they differ."""
    pairs = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    named = xmp.select("doc_id", pairs[F.col("key")].alias("label"), F.col("value").alias("xmp")).where("label is not null")
    return named.join(info.select("doc_id", "label", F.col("value").alias("info")), ["doc_id", "label"]).where("xmp <> info")


def _rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    return _rc4_from(s, 0, 0, data)


def _rc4_from(s: list[int], i: int, j: int, data: bytes) -> bytes:
    """``data`` under the key stream that the state ``s`` gives from the places ``i`` and ``j`` on."""
    out = bytearray()
    for b in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


#: Keys that are scheduled together, bytes of key streams that are held at once, and how many keys make a common step worth while.
KEYS, HELD, FEW = 2048, 16 << 20, 48


def _rc4_many(keys: list[bytes], data: list[bytes]) -> list[bytes]:
    """``_rc4`` of each of ``data`` under its own key: a step of the key streams is taken for many keys at once, the longest first."""
    out: list = [b""] * len(keys)
    order, at = sorted(range(len(keys)), key=lambda k: -len(data[k])), 0
    while at < len(order):
        longest = len(data[order[at]])
        part = order[at : at + max(1, min(KEYS, HELD // max(1, longest)))]
        at += len(part)
        if len(part) < 16:
            for k in part:
                out[k] = _rc4(keys[k], data[k])
            continue
        n = len(part)
        key = np.frombuffer(b"".join((keys[k] * 256)[:256] for k in part), np.uint8).reshape(n, 256).T.copy()
        state = np.repeat(np.arange(256, dtype=np.uint8), n).reshape(256, n)
        flat, column, j = state.reshape(-1), np.arange(n), np.zeros(n, np.uint8)

        def swapped(i: int, m: int) -> tuple[np.ndarray, np.ndarray]:
            mine, place = state[i, :m].copy(), j[:m].astype(np.int64) * n + column[:m]  # noqa: B023
            other = flat[place]  # noqa: B023
            state[i, :m] = other  # noqa: B023
            flat[place] = mine  # noqa: B023
            return mine, other

        for i in range(256):
            j += state[i]
            j += key[i]
            swapped(i, n)
        j[:] = 0
        sizes = np.array([len(data[k]) for k in part])
        live = n - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
        common = int(np.count_nonzero(live >= FEW)) if n >= FEW else 0  # what is longer than that goes on by itself
        stream = np.zeros((common, n), np.uint8)
        for t in range(common):
            i, m = (t + 1) & 255, int(live[t])
            j[:m] += state[i, :m]
            mine, other = swapped(i, m)
            stream[t, :m] = flat[(mine + other).astype(np.int64) * n + column[:m]]
        for c, (k, row) in enumerate(zip(part, stream.T.copy())):
            head, rest = data[k][:common], data[k][common:]
            out[k] = (np.frombuffer(head, np.uint8) ^ row[: len(head)]).tobytes()
            if rest:
                out[k] += _rc4_from(state[:, c].tolist(), common & 255, int(j[c]), rest)
    return out


#: Fixed value: the padding string of the standard security handler.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def file_key(password: bytes, owner: bytes, permissions: int, file_id: bytes, length: int = 16, revision: int = 3) -> bytes:
    """The file key of the standard security handler, revisions 2 to 4 (2 has 40 bits and no rounds)."""
    length = 5 if revision == 2 else length
    key = hashlib.md5((password + PAD)[:32] + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
    for _ in range(0 if revision == 2 else 50):
        key = hashlib.md5(key[:length]).digest()
    return key[:length]


def _rounds(key: bytes, data: bytes, revision: int, back: bool = False) -> bytes:
    """RC4 with the key, and from revision 3 with 19 keys made of it; ``back`` undoes it."""
    steps = range(1) if revision == 2 else range(20)
    for k in reversed(steps) if back else steps:
        data = _rc4(bytes(b ^ k for b in key), data)
    return data


def _rounds_many(keys: list[bytes], data: list[bytes], revisions: list[int]) -> list[bytes]:
    """``_rounds`` of each of ``data``, there and back alike: all its key streams at once, as each is only added to what is there."""
    steps = [range(1) if r == 2 else range(20) for r in revisions]
    made = iter(_rc4_many([bytes(b ^ k for b in key) for key, s in zip(keys, steps) for k in s], [bytes(len(d)) for d, s in zip(data, steps) for _ in s]))
    out = []
    for d, s in zip(data, steps):
        total = int.from_bytes(d, "big")
        for _ in s:
            total ^= int.from_bytes(next(made), "big")
        out.append(total.to_bytes(len(d), "big"))
    return out


def _owner_key(owner_password: bytes, length: int, revision: int) -> bytes:
    key = hashlib.md5((owner_password + PAD)[:32]).digest()
    for _ in range(0 if revision == 2 else 50):
        key = hashlib.md5(key).digest()
    return key[: 5 if revision == 2 else length]


def owner_entry(owner_password: bytes, user_password: bytes, length: int = 16, revision: int = 3) -> bytes:
    """The /O entry: the padded user password under the owner's key."""
    return _rounds(_owner_key(owner_password or user_password, length, revision), (user_password + PAD)[:32], revision)


def user_entry(key: bytes, file_id: bytes, revision: int = 3) -> bytes:
    """The /U entry of a file key: the padding under it, from revision 3 the digest of padding and file id (16 bytes, filled up with zeros)."""
    if revision == 2:
        return _rounds(key, PAD, 2)
    return _rounds(key, hashlib.md5(PAD + file_id).digest(), revision).ljust(32, b"\0")


def owner_entries(owner_passwords: list[bytes], user_passwords: list[bytes], lengths: list[int], revisions: list[int]) -> list[bytes]:
    """``owner_entry`` of each."""
    keys = [_owner_key(o or u, n, r) for o, u, n, r in zip(owner_passwords, user_passwords, lengths, revisions)]
    return _rounds_many(keys, [(u + PAD)[:32] for u in user_passwords], revisions)


def user_entries(keys: list[bytes], file_ids: list[bytes], revisions: list[int]) -> list[bytes]:
    """``user_entry`` of each."""
    made = _rounds_many(keys, [PAD if r == 2 else hashlib.md5(PAD + i).digest() for i, r in zip(file_ids, revisions)], revisions)
    return [m.ljust(32, b"\0") for m in made]


def tried_passwords(given: list[tuple]) -> list[tuple[bytes, bool, bytes, bool]]:
    """(file key as user, whether it fits, file key as owner, whether it fits) of each (password, owner, user, permissions, file_id, length, revision, extra).

    ``extra`` is what goes into the file key behind the file id.
    """
    revisions = [g[6] for g in given]
    users = _rounds_many([_owner_key(g[0], g[5], g[6]) for g in given], [g[1][:32] for g in given], revisions)
    keys = [file_key(p, g[1], g[3], g[4] + g[7], g[5], g[6]) for p, g in [*((g[0], g) for g in given), *zip(users, given)]]
    entries = user_entries(keys, [g[4] for g in given] * 2, revisions * 2)
    fits = [e[: 32 if g[6] == 2 else 16] == g[2][: 32 if g[6] == 2 else 16] for e, g in zip(entries, [*given, *given])]
    n = len(given)
    return list(zip(keys[:n], fits[:n], keys[n:], fits[n:]))


def is_user_password(password: bytes, owner: bytes, user: bytes, permissions: int, file_id: bytes, length: int = 16, revision: int = 3) -> bool:
    n = 32 if revision == 2 else 16
    return user_entry(file_key(password, owner, permissions, file_id, length, revision), file_id, revision)[:n] == user[:n]


def is_owner_password(password: bytes, owner: bytes, user: bytes, permissions: int, file_id: bytes, length: int = 16, revision: int = 3) -> bool:
    """Whether it opens the /O entry to a user password that fits /U."""
    found = _rounds(_owner_key(password, length, revision), owner, revision, back=True)
    return is_user_password(found, owner, user, permissions, file_id, length, revision)


def checked_passwords(rows: DataFrame) -> DataFrame:
    """Adds ``is_user`` and ``is_owner`` to rows with password, owner, user (binary), permissions, file_id (binary) and revision (2 to 4; nulls and other revisions give null)."""

    @F.pandas_udf("is_user boolean, is_owner boolean")
    def check(password: pd.Series, owner: pd.Series, user: pd.Series, permissions: pd.Series, file_id: pd.Series, revision: pd.Series) -> pd.DataFrame:
        rows = list(zip(password, owner, user, permissions, file_id, revision))
        known = [k for k, x in enumerate(rows) if not (any(v is None for v in x) or x[5] not in (2, 3, 4))]
        out: list = [(None, None)] * len(rows)
        given = [(bytes(p), bytes(o), bytes(u), int(flags), bytes(i), 16, int(r), b"") for p, o, u, flags, i, r in (rows[k] for k in known)]
        for k, (_, as_user, _, as_owner) in zip(known, tried_passwords(given)):
            out[k] = as_user, as_owner
        return pd.DataFrame(out, columns=["is_user", "is_owner"])

    done = rows.withColumn("checked", check("password", "owner", "user", "permissions", "file_id", "revision"))
    return done.select(*rows.columns, "checked.*")


def object_key(key: bytes, obj: int, gen: int) -> bytes:
    return hashlib.md5(key + obj.to_bytes(3, "little") + gen.to_bytes(2, "little")).digest()[: min(16, len(key) + 5)]


def rc4_column(data: Column, obj: Column, key: bytes) -> Column:
    """``data`` through RC4 with each object's own key; the same call encrypts and decrypts."""

    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for body, numbers in batches:
            yield pd.Series([None if b is None else _rc4(object_key(key, int(n), 0), bytes(b)) for b, n in zip(body, numbers)])

    return run(data, obj)


def signed_digest(content: Column, byte_range: Column) -> Column:
    """SHA-256 over the two spans of a signature's byte range [start, length, start, length]."""
    span = lambda k: F.substr(content, byte_range[k].cast("int") + 1, byte_range[k + 1].cast("int"))
    return F.sha2(F.concat(span(0), span(2)), 256)


def first_violation(value: Column, max_length: int = 10_000, forbidden: tuple[str, ...] = ("javascript:", "eval(")) -> Column:
    """What a limit check reports first for a text: its size, then a forbidden pattern; null if it passes."""
    out = F.lit(None).cast("string")
    for pattern in reversed(forbidden):
        out = F.when(F.lower(value).contains(pattern), F.lit(f"pattern {pattern}")).otherwise(out)
    return F.when(F.octet_length(value) > max_length, "size").otherwise(out)


def sanitized(value: Column, forbidden: tuple[str, ...] = ("javascript:", "eval(")) -> Column:
    for pattern in forbidden:
        value = F.replace(value, F.lit(pattern), F.lit("[removed]"))
    return value


def structure_texts(marks: DataFrame, contents: DataFrame) -> DataFrame:
    """(element, text): marked content (page, mcid, text) of structure marks (element, page, mcid), in page order."""
    joined = marks.join(contents, ["page", "mcid"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "mcid", "text"))), lambda x: x["text"])
    return joined.groupBy("element").agg(F.array_join(parts, " ").alias("text"))


def nearest_names(names: DataFrame, known: list[str], most: int = 2) -> DataFrame:
    """(name, nearest, distance): the known word at the least edit distance, up to ``most``; of equals the first by alphabet."""
    options = F.array(*(F.struct(F.levenshtein("name", F.lit(k)).alias("distance"), F.lit(k).alias("nearest")) for k in known))
    best = F.array_min(options)
    return names.withColumn("b", best).where(F.col("b.distance") <= most).select("name", "b.nearest", F.col("b.distance").cast("long").alias("distance"))
