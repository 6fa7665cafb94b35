"""Operators over content: threats, strings, provenance, codec choices, merged trees."""

import tomllib

import pytest

from pyspark.sql import functions as F

from quire.operators import content, forms_media
from quire.sources import export


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_threats_of_content(spark):
    texts = spark.createDataFrame([(1, "x = unescape('%u'); system.exec('C:\\a')"), (2, "let it be"), (3, None), (4, ""), (5, "see https://x.org"), (6, "const x")], "doc_id long, text string")
    found = _rows(content.content_threats(texts))
    assert [r for r in found if r[0] == 1] == [(1, "external", "FilePath", "High"), (1, "suspicious", "exec", "High"), (1, "suspicious", "system", "High"), (1, "suspicious", "unescape", "Medium")]
    assert [r for r in found if r[0] != 1] == [(5, "external", "URL", "High")]
    two = spark.createDataFrame([(1, "var x; return x"), (2, "medieval")], "doc_id long, text string")
    assert _rows(content.content_threats(two)) == [(1, "script", "javascript", "Medium"), (2, "script", "javascript", "Medium"), (2, "suspicious", "eval", "High")]


def test_printable_strings(spark):
    texts = spark.createDataFrame([(1, "abcd\nabc\n  xyé tail"), (2, None), (3, ""), (4, "tail only")], "doc_id long, text string")
    assert _rows(content.printable_strings(texts)) == [(1, 0, "abcd"), (1, 1, "  xy")]


def test_recommendations_keep_the_order_of_equals(spark):
    rows = spark.createDataFrame([(1, 0, "EncodingIssues"), (1, 1, "Unknown"), (1, 2, "StructuralDamage"), (1, 3, "StreamCorruption")], "doc_id int, ord int, damage string")
    got = [tuple(r) for r in content.recommendations(rows).orderBy("place").select("action", "priority").collect()]
    assert got == [("StructureRepair", "High"), ("DataRecovery", "Medium"), ("StreamReconstruction", "Medium"), ("EncodingFix", "Low")]


def test_best_ratio_takes_the_first_of_equals(spark):
    tries = spark.createDataFrame([(1, 0, "Flate", 10, 5), (1, 1, "LZW", 10, 5), (2, 0, "Flate", 10, None), (2, 1, "LZW", 10, 12), (3, 0, "Flate", 0, 0)], "k int, ord int, algorithm string, original int, compressed int")
    with_zero = tries.withColumn("original", F.nullif("original", F.lit(0)))
    assert _rows(content.best_ratios(with_zero, "k")) == [(1, "Flate", 0.5), (2, "LZW", 1.2)]


@pytest.mark.parametrize("x,y", [(-5.0, 10.0), (0.0, 10.0), (0.25, 15.0), (0.5, 20.0), (0.75, 15.0), (1.0, 10.0), (9.0, 10.0)])
def test_sampled_function(spark, x, y):
    value = content.sampled(F.lit(x), [0.0, 1.0, 0.0], (0.0, 1.0), (0.0, 2.0), (10.0, 20.0))
    assert spark.range(1).select(value).first()[0] == pytest.approx(y)


def test_merged_trees(spark):
    entries = spark.createDataFrame([("t", 0, 1, "a"), ("t", 1, 1, "b"), ("t", 0, 9, "c"), ("u", 0, 4, "d")], "tree string, part int, num long, value string")
    assert _rows(content.merged_entries(entries)) == [("t", 1, "b"), ("t", 9, "c"), ("u", 4, "d")]
    assert _rows(content.merged_limits(entries)) == [("t", 1, 9), ("u", 4, 4)]


def test_provenance_and_errors(spark):
    nodes = spark.createDataFrame([(1, [7], [], None, None), (2, [], ["ObjectRepair"], 5, []), (3, [], ["StreamRepair"], None, ["bad"])], "node_id int, revisions array<int>, repairs array<string>, container int, errors array<string>")
    hits = lambda *a, **k: [r[0] for r in content.by_provenance(nodes, *a, **k).orderBy("node_id").select("node_id").collect()]
    assert hits("Incremental") == [1] and hits("Recovered") == [2, 3] and hits("Inferred") == [2]
    assert hits("FromObjectStream", container=5) == [2] and hits("Revision", revision=7) == [1]
    assert [r[0] for r in content.with_errors(nodes).select("node_id").collect()] == [3]


def test_dictionaries_and_names_resolve(spark):
    values = spark.createDataFrame([(1, "own", None), (2, None, 8), (3, None, 9)], "k int, dict string, ref int")
    objects = spark.createDataFrame([(8, "held")], "obj int, dict string")
    assert _rows(content.resolved_dicts(values, objects)) == [(1, "own"), (2, "held"), (3, None)]
    entries = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 3)], "tree string, key string, value int")
    held = spark.createDataFrame([(1, {"JS": "x()"}), (2, {"F": "f.txt", "EF": "1", "Size": "3", "Subtype": "/text/plain"}), (3, {"F": "external.txt"})], "obj int, dict map<string,string>")
    assert _rows(content.named_scripts(entries, held)) == [("t", "a", "x()")]
    assert _rows(content.embedded_files(entries, held)) == [("t", "b", "f.txt", 3, "text/plain")]


def test_rich_media_and_throughput(spark):
    made = spark.createDataFrame([(1, '{"Assets": {"Names": ["b", "a", "b"]}, "Configurations": [1, 2]}', '{"Scripts": ["s"]}'), (2, None, None)], "doc_id int, content string, settings string")
    assert _rows(content.rich_media(made)) == [(1, 2, ["b", "a"], 2, 1), (2, 0, [], 0, 0)]
    samples = spark.createDataFrame([("a", 1048576, 500), ("a", 1048576, 500), ("b", 9, 0)], "k string, bytes long, ms long")
    assert _rows(content.throughput(samples, "k")) == [("a", 2, 2.0), ("b", 1, 0.0)]


def test_packets_and_hybrid_forms(spark):
    parts = spark.createDataFrame([(1, 0, "template", "<?xml version='1.0'?><xfa:template a='1'/>"), (1, 1, None, "<data>é</data>"), (2, 0, "x", ""), (3, 0, "y", None)], "doc_id int, ord int, name string, xml string")
    packets = forms_media.template_packets(parts)
    assert _rows(packets) == [(1, 0, "template", "template", 42), (1, 1, "packet", "data", 15)]
    fields = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id int, field string")
    assert _rows(forms_media.hybrid_forms(packets, fields)) == [(1,)]


def test_toml_reports_are_read_back(spark):
    risks = spark.createDataFrame([(1, 70, "MEDIUM", False), (2, 0, "LOW", True)], "doc_id int, score long, level string, safe boolean")
    found = spark.createDataFrame([(1, "b", "High"), (1, 'a "quoted" \\ rule', "Medium")], "doc_id int, rule string, severity string")
    reports = {r.doc_id: tomllib.loads(r.report) for r in export.report_toml(risks, found).collect()}
    assert reports[1] == {"score": 70, "level": "MEDIUM", "is_safe": False, "findings": [{"severity": "High", "rule": "b"}, {"severity": "Medium", "rule": 'a "quoted" \\ rule'}]}
    assert reports[2] == {"score": 0, "level": "LOW", "is_safe": True}


def test_diff_reports(spark):
    changes = spark.createDataFrame([(1, 2, "Modified"), (1, 1, "Added"), (1, 3, "Same"), (2, 1, "Same")], "doc_id int, page int, change string")
    totals = spark.createDataFrame([(1, 10), (2, 1), (3, 0)], "doc_id int, n_pages long")
    got = dict(_rows(export.diff_reports(changes, totals)))
    assert got[1] == "similarity 90.00%\nchanges 2\nadded 1\nremoved 0\nmodified 1\n- page 1: Added\n- page 2: Modified"
    assert got[2] == got[3] == "similarity 100.00%\nchanges 0\nadded 0\nremoved 0\nmodified 0"
