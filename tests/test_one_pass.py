"""Conversion and rendering as one pass: blocks are shuffled once, by document, and no join brings them to another key."""

import pytest

from vellum.plans import convert
from vellum.queries import outputs

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def plain(spark):
    """No broadcasts, so that each exchange of a larger input shows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_conversion_shuffles_blocks_once(plain):
    """One exchange of blocks, two of documents: for titles, and for front matter."""
    assert exchanges(outputs.e10_converted(plain, DIR)) == 3


def test_files_of_bookmarks_headings_and_nothing(plain):
    """Documents that split, that don't, and without blocks, beside blocks without a document."""
    kinds = "doc_id long, seq int, block_id string, type string, text string, page int, ocr boolean"
    rows = [(1, 0, "a", "paragraph", "before", 1, True), (1, 1, "b", "heading", "1.1 First", 2, False), (1, 2, "c", "paragraph", "see section 2.1 and section 1.1", 2, False), (1, 3, "d", "heading", "2.1 Second", 30, False), (1, 4, "e", "paragraph", "scan", 31, True), (1, 5, "f", "heading", "1.1 Again", 32, False)]
    rows += [(2, 0, "a", "heading", "Head", 1, False), (2, 1, "b", "equation", "x", 1, False), (4, 0, "a", "paragraph", "lost", 1, False)]
    docs = plain.createDataFrame([(1, "Book", 50), (2, None, 3), (3, "Empty", 60)], "doc_id long, title string, page_count int")
    marks = plain.createDataFrame([(1, 0, "One", 1, 0), (1, 1, "Two", 29, 0), (3, 0, "One", 1, 0), (3, 1, "Two", 29, 0)], "doc_id long, seq int, title string, page_index int, level int")
    result = convert.convert(plain.createDataFrame(rows, kinds), docs, bookmarks=marks)
    got = {(r.doc_id, r.file_name): r.body for r in result.files.collect()}
    assert sorted(got) == [(1, "00_front.md"), (1, "01_one.md"), (1, "02_two.md"), (1, "index.md"), (2, "document.md"), (3, "document.md")]
    assert "[section 2.1](02_two.md#21-second) and [section 1.1](#11-first)" in got[1, "01_one.md"]
    assert got[1, "index.md"].endswith("- [Front matter](00_front.md)\n- [One](01_one.md)\n    - [1.1 First](01_one.md#11-first)\n- [Two](02_two.md)\n    - [2.1 Second](02_two.md#21-second)\n    - [1.1 Again](02_two.md#11-again)\n")
    assert all("ocr_scanned_pages: 2" in got[1, n] and "section_source: bookmarks" in got[1, n] for n in ("00_front.md", "01_one.md", "02_two.md", "index.md"))
    assert "section_source: heading_outline\nequations:\n  total: 1\n" in got[2, "document.md"] and "# Document\n\n<!-- page 1 -->" in got[2, "document.md"]
    assert got[3, "document.md"].endswith("---\n\n# Empty\n\n\n") and "equations" not in got[3, "document.md"]
    assert {(r.doc_id, r.lossless, r.dropped) for r in result.report.collect()} == {(1, True, 0), (2, True, 0), (4, True, 1)}


def test_signals_render_once(plain):
    """Bodies and figures of blocks come of the same rendering: one exchange, one read of the documents."""
    df = outputs.a11_signals(plain, DIR)
    assert exchanges(df) == 1 and df._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    r = outputs.rendered(plain, DIR)
    bodies = outputs.emit.files(r, ["doc_id"]).selectExpr("doc_id", "body AS markdown")
    apart = outputs.audit.signals(r, bodies).select(*df.columns)
    assert sorted(df.collect()) == sorted(apart.collect())
