"""Registered queries of the archive validator, of links between objects, and of name and number trees in files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformance
from ..sources import damage, pdf
from ..sources.bridge import table
from ..sources.shared import stored
from .document_queries import ALL, _rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql.replace("@all", ALL)
        return fn

    return add


def _objects(spark, d, kind: str):
    files = damage.damaged_files(table(spark, d, "documents").where("text is not null"), kind)
    return stored(pdf.objects(pdf.parse(files)), "objects")


@_register("""@all, c AS (SELECT doc_id, 'PDF_A_VERSION' AS code, 'Error' AS severity, CAST(1 AS BIGINT) AS n FROM d WHERE doc_id % 4 > 0 UNION ALL SELECT doc_id, 'PDF_A_JAVASCRIPT', 'Error', 1 FROM d WHERE js UNION ALL SELECT doc_id, 'PDF_A_ANNOTATION_APPEARANCE', 'Warning', 1 FROM d WHERE uri
 UNION ALL SELECT doc_id, 'PDF_A_ENCRYPTION', 'Error', 1 FROM d WHERE encrypted UNION ALL SELECT doc_id, 'PDF_A_XMP_METADATA', 'Error', 1 FROM d UNION ALL SELECT doc_id, 'PDF_A_METADATA_SYNC', 'Warning', 1 FROM d UNION ALL SELECT doc_id, 'PDF_A_OUTPUT_INTENT', 'Warning', 1 FROM d UNION ALL SELECT doc_id, 'PDF_A_EMBEDDED_FILES', 'Error', 1 FROM d WHERE file) SELECT * FROM c""")
def archive_rules(spark, d):
    return conformance.archive_issues(_rows(spark, d))


@_register("@all SELECT doc_id, ['CYCLIC_STRUCTURE', 'TOUNICODE_NOT_STREAM', 'STRUCT_TREE_ROOT_INVALID'][1 + doc_id % 5] AS code, ['Error', 'Warning', 'Error'][1 + doc_id % 5] AS severity, CAST(1 AS BIGINT) AS n FROM d WHERE doc_id % 5 < 3")
def link_rules(spark, d):
    """Cycles, maps that are no stream and trees that are no dictionary, where the files have them."""
    return conformance.link_issues(_objects(spark, d, "with_issues"))


@_register("@all SELECT doc_id, 'Dests' AS tree, CAST(n_lines AS BIGINT) AS n, CAST(n_lines * (n_lines - 1) // 2 AS BIGINT) AS total FROM d UNION ALL SELECT doc_id, unnest(['JavaScript', 'Pages', 'Templates', 'AlternatePresentations', 'Renditions', 'EmbeddedFiles']), 1, doc_id FROM d")
def file_name_trees(spark, d):
    """All seven trees of name dictionaries in files, and what their values add up to."""
    found = conformance.name_trees(_objects(spark, d, "with_trees"))
    return found.groupBy("doc_id", "tree").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@_register("@all SELECT doc_id, 'ParentTree' AS tree, CAST(n_lines AS BIGINT) AS n, CAST(n_lines - 1 AS BIGINT) AS last FROM d UNION ALL SELECT doc_id, 'PageLabels', 2, 4 FROM d")
def file_number_trees(spark, d):
    """Page labels and parent trees in files."""
    found = conformance.number_trees(_objects(spark, d, "with_trees"))
    return found.groupBy("doc_id", "tree").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last"))
