"""The archive validator, links and trees on hand-made documents."""

import pytest

from quire.operators import conformance
from quire.sources import pdf
from quire.sources.shared import stored


def document(version=b"1.4", trailer=b"", **objects):
    out = bytearray(b"%PDF-" + version + b"\n")
    for name, body in objects.items():
        out += b"%d 0 obj\n" % int(name[1:]) + body + b"\nendobj\n"
    return bytes(out + b"trailer\n<< /Root 1 0 R /Size 9 %s>>\nstartxref\n0\n%%%%EOF" % trailer)


def rows_of(spark, *files):
    return stored(pdf.parse(spark.createDataFrame([(k, f) for k, f in enumerate(files)], "doc_id long, content binary")), "rows")


def stream(head=b""):
    return b"<< %s /Length 1 >>\nstream\nx\nendstream" % head


CATALOG = b"<< /Type /Catalog /Metadata 3 0 R /OutputIntents [] %s>>"
CASES = {
    "PDF_A_VERSION": document(b"1.7", o1=CATALOG % b""),
    "PDF_A_COLOR_SPACE": document(o1=b"<< /Type /Catalog /Metadata 3 0 R >>", o2=stream(b"/Subtype /Image /ColorSpace /DeviceRGB")),
    "PDF_A_FONT_EMBEDDING": document(o1=CATALOG % b"", o2=b"<< /Type /Font /Subtype /Type3 >>"),
    "PDF_A_FONT_ENCODING": document(o1=CATALOG % b"", o2=b"<< /Type /Font /Subtype /TrueType /BaseFont /Own /FontFile2 3 0 R >>"),
    "PDF_A_MULTIMEDIA": document(o1=CATALOG % b"", o2=b"<< /Type /Annot /Subtype /Screen /AP << >> >>"),
    "PDF_A_JAVASCRIPT": document(o1=CATALOG % b"/Names << /JavaScript << >> >> "),
    "PDF_A_ANNOTATION_TYPE": document(o1=CATALOG % b"", o2=b"<< /Type /Annot /Subtype /FileAttachment /AP << >> >>"),
    "PDF_A_ANNOTATION_APPEARANCE": document(o1=CATALOG % b"", o2=b"<< /Type /Annot /Subtype /Text >>"),
    "PDF_A_XFA": document(o1=CATALOG % b"/AcroForm << /XFA 4 0 R >> "),
    "PDF_A_ENCRYPTION": document(o1=CATALOG % b"", trailer=b"/Encrypt 8 0 R "),
    "PDF_A_XMP_METADATA": document(o1=b"<< /Type /Catalog /OutputIntents [] >>"),
    "PDF_A_TRANSPARENCY": document(o1=CATALOG % b"", o2=b"<< /Type /ExtGState /ca 0.5 >>"),
    "PDF_A_EMBEDDED_FILES": document(o1=CATALOG % b"", o2=b"<< /Type /Filespec >>"),
    "PDF_A_XREF_FORMAT": document(o1=CATALOG % b"", o2=stream(b"/Type /XRef")),
    "PDF_A_LZW_DECODE": document(o1=CATALOG % b"", o2=stream(b"/Subtype /Image /Filter [/ASCIIHexDecode /LZWDecode]")),
}


def test_every_archive_code_has_its_case(spark):
    found = {}
    for r in conformance.archive_issues(rows_of(spark, *CASES.values(), document(o1=CATALOG % b""))).collect():
        found.setdefault(r.doc_id, set()).add(r.code)
    names = list(CASES)
    for k, name in enumerate(names):
        extra = {"PDF_A_OUTPUT_INTENT"} if name == "PDF_A_COLOR_SPACE" else set()
        assert found[k] == {name, "PDF_A_METADATA_SYNC"} | extra, name
    assert found[len(names)] == {"PDF_A_METADATA_SYNC"}
    assert set(conformance.ARCHIVE_CODES) == set(CASES) | {"PDF_A_METADATA_SYNC", "PDF_A_OUTPUT_INTENT"}
    lenient = conformance.archive_issues(rows_of(spark, *CASES.values()), strict=False).select("code").distinct().collect()
    assert {r.code for r in lenient} == set(CASES) - {"PDF_A_LZW_DECODE"}


def test_links_that_lead_back(spark):
    page = b"<< /Type /Page /Parent 2 0 R >>"
    sound = document(o1=b"<< /Type /Catalog /Pages 2 0 R /StructTreeRoot << >> >>", o2=b"<< /Type /Pages /Kids [3 0 R] >>", o3=page, o4=b"<< /Type /Font /ToUnicode 5 0 R >>", o5=stream())
    ring = document(o1=b"<< /Type /Catalog /Pages 2 0 R /StructTreeRoot 4 0 R >>", o2=b"<< /Type /Pages /Kids [3 0 R] >>", o3=b"<< /Type /Pages /Kids [2 0 R] >>", o4=b"<< /K 1 >>")
    wrong = document(o1=b"<< /Type /Catalog /StructTreeRoot 2 0 R >>", o2=stream(), o3=b"<< /Type /Font /ToUnicode 1 0 R >>", o4=b"<< /Type /Font /ToUnicode 99 0 R >>", o5=b"<< /Type /Font /ToUnicode /Identity-H >>")
    lost = document(o1=b"<< /Type /Catalog /StructTreeRoot 99 0 R >>")
    objects = stored(pdf.objects(rows_of(spark, sound, ring, wrong, lost)), "objects")
    assert {(r.doc_id, r.code, r.n) for r in conformance.link_issues(objects).collect()} == {(1, "CYCLIC_STRUCTURE", 1), (2, "TOUNICODE_NOT_STREAM", 1), (2, "STRUCT_TREE_ROOT_INVALID", 1), (3, "STRUCT_TREE_ROOT_INVALID", 1)}
    assert conformance.link_issues(stored(objects.limit(0), "objects")).count() == 0


def test_trees_direct_behind_references_and_in_rings(spark):
    names = document(
        o1=b"<< /Type /Catalog /Names << /Dests 2 0 R /Pages << /Names [(p) << /A 1 >>] >> /Other << /Names [(x) 1] >> >> /PageLabels 7 0 R >>",
        o2=b"<< /Kids [3 0 R 4 0 R] >>",
        o3=b"<< /Kids [2 0 R 4 0 R 99 0 R] >>",
        o4=b"<< /Names [(a) 5 0 R (b) null (odd)] >>",
        o7=b"<< /Nums [0 << >> (no number) 1 7 2] >>",
    )
    none = document(o1=b"<< /Type /Catalog >>")
    objects = stored(pdf.objects(rows_of(spark, names, none)), "objects")
    got = {(r.doc_id, r.tree, r.key, r.value) for r in conformance.name_trees(objects).collect()}
    assert {(d, t, k) for d, t, k, _ in got} == {(0, "Dests", "a"), (0, "Dests", "b"), (0, "Pages", "p")}
    assert {v for _, _, k, v in got if k == "a"} == {'{"R":"5 0"}'} or {v.replace(" ", "") for _, _, k, v in got if k == "a"} == {'{"R":"50"}'}
    assert {(r.tree, r.key) for r in conformance.number_trees(objects).collect()} == {("PageLabels", 0), ("PageLabels", 7)}


@pytest.mark.parametrize("content", [b"", b"junk", None])
def test_no_document_no_issue_of_links(spark, content):
    objects = stored(pdf.objects(rows_of(spark, content)), "objects")
    assert conformance.link_issues(objects).count() == conformance.name_trees(objects).count() == 0
