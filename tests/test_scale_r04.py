"""Small tables with what took time, memory or disk on large ones: shared parents, many keys a batch, many edits a file."""

import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions import fax
from quire.operators import graph, recovery, signatures
from quire.plans import recovery_queries
from quire.sources import damage, der
from quire.sources.shared import ensure_checkpoint_dir, row_batches, stored


def test_ancestors_of_nodes_with_shared_and_several_parents_and_of_cycles(spark):
    r = random.Random(5)
    pairs = [(f"l{k}", f"o{k // 4}") for k in range(80)] + [("l3", "o9"), ("l3", "o0"), ("l3", "o0")] + [(f"o{k}", f"c{k // 8}") for k in range(20)] + [("c0", "top"), ("c1", "top"), ("c2", "c0"), ("top", "c2"), ("top", "l5")]
    pairs += [(f"x{r.randrange(12)}", f"x{r.randrange(12)}") for _ in range(30)]
    edges = spark.createDataFrame([(up, down, "Child", 0) for down, up in pairs] + [("l1", "l2", "Reference", 0)], "src string, dst string, edge_type string, ord int")
    for starts in ([f"l{k}" for k in range(80)] + ["l3", "none"], [f"x{k}" for k in range(12)]):
        start = spark.createDataFrame([(s,) for s in starts], "node_id string")
        expected = set()
        for s in set(starts):
            seen, level, depth = {s}, {s}, 0
            while level:
                depth += 1
                level = {up for down, up in pairs if down in level} - seen
                seen |= level
                expected |= {(s, x, depth) for x in level}
        found = [tuple(x) for x in graph.ancestors(edges, start).collect()]
        assert len(found) == len(expected) and set(found) == expected


def test_ancestors_are_stored_a_parent_once_not_a_descendant_once(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    edges = spark.range(4000).select(F.concat(F.lit("o"), F.floor(F.col("id") / 40)).alias("src"), F.concat(F.lit("l"), "id").alias("dst"), F.lit("Child").alias("edge_type"))
    edges = edges.unionByName(spark.range(100).select(F.lit("top").alias("src"), F.concat(F.lit("o"), "id").alias("dst"), F.lit("Child").alias("edge_type")))
    found = graph.ancestors(edges, edges.where("dst like 'l%'").select(F.col("dst").alias("node_id")))
    rows = sum(spark.read.parquet(f"{folder}/{name}").count() for name in set(os.listdir(folder)) - before)
    assert found.count() == 8000 and rows < 4400


def test_many_keys_share_a_batch():
    found = [(k, [(str(k), j) for j in range(k % 4)], 10) for k in range(1000)]
    batches = list(row_batches(iter(found), ["k", "s", "j"], [pa.int64(), pa.string(), pa.int32()], rows=500))
    assert len(batches) == 3 and pa.Table.from_batches(batches).to_pylist() == [{"k": k, "s": s, "j": j} for k, out, _ in found for s, j in out]
    assert len(list(row_batches(iter(found), ["k", "s", "j"], [pa.int64(), pa.string(), pa.int32()], size=1000))) == 8 and not list(row_batches(iter([(1, [], 5)]), ["k"], [pa.int64()]))


def test_small_tables_whose_rows_take_long_are_dealt_out(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    images = spark.range(50).select("id", F.lit(b"body").alias("body")).coalesce(1)
    assert damage.fax_files(images).rdd.getNumPartitions() == n
    sellers = spark.range(20).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), F.lit(1).alias("n_nationkey"), F.lit("n").alias("n_name"), F.lit("r").alias("r_name"), F.lit(1.0).alias("s_acctbal")).coalesce(1)
    assert der.seller_blobs(sellers).rdd.getNumPartitions() == n


def test_signatures_by_both_primes_are_those_of_the_exponent():
    for seed in ("a", "b"):
        n, e, d = der.rsa_key(seed)
        for block in (0, 1, 12345, n - 2, der._parts((n, e, d))[0]):
            assert der._power(block, (n, e, d)) == pow(block, d, n)


def test_signers_have_a_small_plan(spark):
    """What three joins start from is worked out once; without that the driver held all of it three times."""
    blobs = stored(spark.createDataFrame([("1", b"\x30\x00")], "blob string, content binary"), "blobs")
    nodes = stored(signatures.der_nodes(blobs), "der")
    plan = signatures.signers(nodes, blobs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") < 25


def test_fax_codes_of_noise_go_there_and_back():
    r = random.Random(1)
    for k in (-1, 0, 4):
        data = r.randbytes(32 * 40)
        assert fax.decode(fax.encode(data, k, 256), k, 256, 40) == data


def test_many_edits_and_fragments_of_a_file(spark):
    body = "".join(f"{k} 0 obj\n<< /Kids [{k + 1} 0 R] /é ({'ü' * k}) >>\nendobj\n" for k in range(1, 200)).encode("latin-1")
    files = stored(spark.createDataFrame([(1, body), (2, None), (3, b"no object")], "doc_id long, content binary"), "files")
    parts = {p.number: p for p in recovery.fragments(files).collect()}
    assert len(parts) == 199 and all(p.fragment == k and p.body.encode("latin-1") == body[body.index(b"\n", p.start) - 0 : p.stop] for k, p in parts.items())
    at = [p.start for p in parts.values()]
    repairs = spark.createDataFrame([(1, a, 1, "é+", 0, 0, "x") for a in at], "doc_id long, at long, cut long, put string, rank int, `order` long, repair string")
    left, expected = 0, b""
    for a in sorted(at):
        expected, left = expected + body[left:a] + "é+".encode("latin-1"), a + 1
    got = {x.doc_id: x for x in recovery.spliced(files, repairs).collect()}
    assert bytes(got[1].content) == expected + body[left:] and len(got[1].repairs) == 199 and bytes(got[3].content) == b"no object" and got[2].content is None
    plan = recovery.fragments(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline") < plan.index("Window")  # windows go over marks, not over whole files


def test_mended_files_are_not_kept_beside_their_rows(spark, sf):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    recovery_queries.mended_structures(spark, sf)
    left = sorted(name.rpartition("-")[0].split("-")[0] for name in set(os.listdir(folder)) - before)
    assert "files" not in left and "objects" not in left and "tokens" not in left
