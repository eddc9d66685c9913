"""Enrichment deals boxes, texts and glyphs by document once; rows without a page, a box or a document stay."""

from vellum.operators import enrich
from vellum.plans import convert
from vellum.queries import outputs
from vellum.sources import shared

DIR = "/root/testdata/sf0.001"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_blocks_and_glyphs_are_shuffled_once(spark, monkeypatch):
    """Blocks are finished from what one shuffle by document leaves, which no other shuffle and no join follows."""
    plans, plain = {}, shared.Scratch.table

    def table(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(self, df, name)

    monkeypatch.setattr(shared.Scratch, "table", table)
    outputs.e1_enriched(spark, DIR)
    # the glyphs' other shuffle is none; cells ask for the page of their table
    assert plans["regions"].count("Exchange hashpartitioning(doc_id") - 2 * plans["regions"].count("Join") == 1
    assert "Exchange" not in plans["prepared-blocks"] and "Join" not in plans["prepared-blocks"]


def test_rows_without_page_box_or_document_stay(spark):
    """Words of glyphs without a place or a page are known; equal keys are rows of their own; nothing is shared between documents."""
    box = (0.0, 0.0, 900.0, 800.0)
    glyph = [(1, 1, 0, "lowdin", 0.0, 100.0, 6.0, 110.0, 6.0), (1, None, 1, "diff", 0.0, 1.0, 6.0, 2.0, 6.0), (1, None, 2, "erent", 0.0, 1.0, 6.0, 2.0, 6.0), (1, 2, 0, "office", None, 1.0, 2.0, 3.0, 6.0), (None, 1, 0, "lowdin", 0.0, 100.0, 6.0, 110.0, 6.0)]
    layer = spark.createDataFrame(glyph, "doc_id long, page int, draw_idx long, text string, l double, b double, r double, t double, advance double")
    said = "lo wdin, di ff erent o ffi ce"
    rows = [(1, 0, "a", 1, box), (1, 1, "b", 2, box), (1, 2, "c", 3, box), (1, 3, "d", None, box), (1, 4, "e", 1, None), (1, 5, "a", 1, box), (2, 0, "a", 1, box), (None, 0, "a", 1, box), (None, 1, "b", None, None)]
    blocks = spark.createDataFrame([(*r[:3], "paragraph", said, *r[3:], None) for r in rows], f"doc_id long, seq int, block_id string, type string, text string, page int, bbox {BOX}, confidence double")
    none = [spark.createDataFrame([], kind % "long") for kind in (convert.TABLE, convert.CELL, convert.FIGURE)]
    got = enrich.enrich(blocks, layer, shared.Scratch(spark, "t"), *none)
    found = {(x.doc_id, x.seq): (x.text, x.ocr) for x in got.blocks.collect()}
    whole = "lowdin, different office"
    assert found == {(1, 0): (whole, False), (1, 1): (whole, False), (1, 2): (said, True), (1, 3): (whole, False), (1, 4): (said, False), (1, 5): (whole, False), (2, 0): (said, True), (None, 0): (said, False), (None, 1): (said, False)}
    assert {tuple(x) for x in got.scanned.collect()} == {(1, 3), (1, None), (2, 1), (None, 1), (None, None)}
