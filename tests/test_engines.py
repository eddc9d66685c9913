"""Nested engine output, and the entry points with their exit codes."""

import json

import pytest
from pyspark.sql import functions as F

from vellum import cli
from vellum.plans import convert
from vellum.sources import engine, nested
from vellum.sources.config import Config
from vellum.sources.shared import Scratch


def refs(*names):
    return [{"$ref": n} for n in names]


def at(page, left, top, right, bottom):
    return [{"page_no": page, "bbox": {"l": left, "t": top, "r": right, "b": bottom, "coord_origin": "BOTTOMLEFT"}}]


def cell(text, row, col, rows=1, cols=1, header=False, box=None):
    return {"text": text, "bbox": box, "row_span": rows, "col_span": cols, "start_row_offset_idx": row, "end_row_offset_idx": row + rows, "start_col_offset_idx": col, "end_col_offset_idx": col + cols, "column_header": header, "row_header": False}


TREE = {
    "body": {"children": refs("#/texts/1", "#/groups/0", "#/tables/0", "#/pictures/0", "#/gone/0", "#/texts/6")},
    "groups": [{"self_ref": "#/groups/0", "label": "list", "children": refs("#/texts/3", "#/texts/2")}],
    "texts": [
        {"self_ref": "#/texts/0", "label": "caption", "text": "Figure 1 /Delta1", "prov": at(2, 5, 80, 60, 70), "children": []},
        {"self_ref": "#/texts/1", "label": "section_header", "text": "1 Intro", "level": 2, "prov": at(1, 0, 700, 90, 680), "children": refs("#/texts/4", "#/groups/0", "#/texts/1")},
        {"self_ref": "#/texts/2", "label": "list_item", "text": "second", "prov": at(1, 0, 1, 2, 0)},
        {"self_ref": "#/texts/3", "label": "list_item", "text": "first", "prov": at(1, 0, 1, 2, 0)},
        {"self_ref": "#/texts/4", "label": "text", "text": "inside", "prov": at(1, 0, 1, 2, 0)},
        {"self_ref": "#/texts/5", "label": "text", "text": "in the picture", "prov": at(2, 0, 1, 2, 0)},
        {"self_ref": "#/texts/6", "label": "formula", "text": "x", "prov": []},
        {"self_ref": "#/texts/7", "label": "text", "text": "outside the tree", "prov": at(1, 0, 1, 2, 0)},
    ],
    "tables": [{"self_ref": "#/tables/0", "label": "table", "prov": at(1, 0, 300, 400, 200), "data": {"num_rows": 2, "num_cols": 2, "table_cells": [cell("H", 0, 0, cols=2, header=True), cell("a|<", 1, 0, box={"l": 10, "t": 100, "r": 50, "b": 120, "coord_origin": "TOPLEFT"}), cell("b", 1, 1)]}}],
    "pictures": [{"self_ref": "#/pictures/0", "label": "picture", "prov": at(2, 0, 400, 300, 100), "captions": refs("#/texts/0"), "children": refs("#/texts/5", "#/texts/0")}],
    "pages": {"1": {"size": {"width": 600, "height": 800}}, "2": {"size": {"width": 600, "height": 800}}},
}


@pytest.fixture(scope="module")
def source(spark):
    rows = [("d", "d.pdf", json.dumps(TREE)), ("none", "n.pdf", "no json"), ("bare", "b.pdf", "{}"), ("null", "x.pdf", None)]
    glyphs = spark.createDataFrame([("d", 1, 0, "x", 900.0, 0.0, 905.0, 9.0), ("d", 2, 0, "x", 900.0, 0.0, 905.0, 9.0)], "doc_id string, page int, draw_idx long, ch string, l double, b double, r double, t double")
    return nested.source(spark.createDataFrame(rows, "doc_id string, file_name string, content string"), glyphs, Scratch(spark, "t"))


def test_items_in_reading_order(source):
    """Preorder over groups and children; captions alone below a picture; loops, lost references and items without a place lead nowhere."""
    rows = source.blocks.orderBy("seq").collect()
    assert [(r.block_id, r.type) for r in rows] == [("#/texts/1", "heading"), ("#/texts/4", "paragraph"), ("#/texts/3", "list"), ("#/texts/2", "list"), ("#/texts/3", "list"), ("#/texts/2", "list"), ("#/tables/0", "table"), ("#/pictures/0", "figure"), ("#/texts/0", "caption")]
    assert rows[0].level == 2 and rows[-1].text == "Figure 1 Δ" and tuple(rows[0].bbox) == (0, 700, 90, 680)
    assert {(r.doc_id, r.page_count) for r in source.documents.collect()} == {("d", 2), ("none", 0), ("bare", 0), ("null", 0)}


def test_tables_and_figures_of_the_engine(source):
    t = source.tables.first()
    assert (t.block_id, t.page, t.num_rows, t.num_cols, t.has_spanning_cells) == ("#/tables/0", 1, 2, 2, True)
    assert t.gfm == "| H |  |\n|---|---|\n| a\\|< | b |" and t.html == '<table><tbody><tr><th colspan="2">H</th></tr><tr><td>a|&lt;</td><td>b</td></tr></tbody></table>'
    boxes = {r.text: r.bbox for r in source.cells.collect()}
    assert tuple(boxes["a|<"]) == (10, 700, 50, 680) and boxes["b"] is None
    f = source.figures.first()
    assert (f.caption, tuple(f.caption_bbox), f.page) == ("Figure 1 Δ", (5, 80, 60, 70), 2)
    assert source.pages.where("doc_id = 'd'").count() == 2


def test_nested_documents_are_converted(spark, source):
    unique = source.blocks.dropDuplicates(["doc_id", "block_id"])
    result = convert.run(convert.Source(source.documents, unique, source.glyphs, source.tables, source.cells, source.figures), Scratch(spark, "t"))
    body = {r.doc_id: r.body for r in result.files.collect()}
    assert set(body) == {"d", "none", "bare", "null"}
    assert '<th colspan="2">H</th>' in body["d"] and "## 1 Intro" not in body["d"] and "# 1 Intro" in body["d"] and "figure crop missing" in body["d"]


def test_commands_and_their_exit_codes(spark, tmp_path, capsys, monkeypatch):
    """Convert twice, a bad file, a changed text, prune, coverage, a baseline that gets worse."""

    def make():
        plain = engine.text_engine()

        def run(content):
            if content.startswith(b"bad"):
                raise ValueError("unreadable")
            return plain(content)

        return run

    monkeypatch.setitem(engine.ENGINES, "text", make)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for name, text in {"a.txt": "one\n\ntwo", "b.txt": "bad", "c.txt": "one\n\ntwo", "d.md": "no"}.items():
        (folder / name).write_text(text)

    def run(*arguments):
        code = cli.main([*arguments, "--out", out])
        return code, [x.split("  ", 2) for x in capsys.readouterr().out.splitlines()]

    code, said = run("convert", str(folder), "--pattern", "*.txt")
    assert code == 1 and [(s, p.rsplit("/", 1)[1]) for s, p, *_ in said] == [("ok", "a.txt"), ("failed", "b.txt"), ("ok", "c.txt")] and "ValueError: unreadable" in said[1][2]
    (folder / "b.txt").write_text("good")
    code, said = run("convert", str(folder), "--pattern", "*.txt")
    assert code == 0 and [s for s, *_ in said] == ["cached", "ok", "cached"]
    assert run("convert", str(folder / "a.txt"), "--force")[0] == 0
    assert len(list((tmp_path / "out").glob("*/v2/document.md"))) == 1 and len(list((tmp_path / "out").glob("*/v1/document.md"))) == 2
    assert len(run("prune", "--dry-run")[1]) == 1 and len(run("prune")[1]) == 1 and not run("prune")[1]
    assert len(list((tmp_path / "out").glob("*/v*/provenance.json"))) == 2
    code, said = run("coverage")
    assert code == 0 and sorted(json.loads(c)["emitted"] for _, c in said) == [1, 2]
    base = str(tmp_path / "baseline")
    assert run("audit", "--update", base)[0] == 0 and run("audit", "--check", base)[0] == 0
    worse = spark.read.json(base).withColumn("lossless", F.lit(True)).collect()
    spark.createDataFrame(worse).withColumn("illegible", F.lit(-1)).write.json(base + "2")
    assert run("audit", "--check", base + "2")[0] == 1
    assert cli.main(["version"]) == 0 and Config().engine == "text"
