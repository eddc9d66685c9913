"""Text layers as runs: the same as their glyphs, without a row for each."""

import random

import duckdb
from pyspark.sql import functions as F

from vellum.operators import glyphs
from vellum.queries import trees

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
RUN = "doc_id long, page int, draw_idx long, text string, l double, b double, r double, t double, advance double"
KEYS = ["doc_id", "block_id"]


def test_parts_of_runs_are_measured_as_their_glyphs():
    r = random.Random(5)
    kinds = {True: 0, False: 0}
    for _ in range(3000):
        n, parts = r.randrange(1, 6), []
        odd = r.random() < 0.3
        for k in range(n):
            text = "".join(r.choices("ab c,1\t\u00a0\x1c", k=r.randrange(1, 9))) if r.random() < 0.9 else "   "
            left, pitch = r.choice([0.0, 6.0, 12.0, 3.0]), r.choice([6.0, 5.0]) if odd else 6.0
            b = r.choice([700.0, 690.0, 684.0]) if odd else 700.0 - 15 * k - r.choice([0, 0, 0, 30]) * (k == 3)
            parts.append((k * 100, text, left, b, left + r.choice([5.0, 6.0]) if odd else left + 6.0, b + 10, pitch, r.choice([0, 0, 2])))
        found, own = glyphs.below_each_other(parts), glyphs.spelled(parts)
        kinds[found is None] += 1
        if found is not None:
            assert found == ("".join(map(glyphs.score, glyphs.lines(own))), glyphs.disorder(own), glyphs.layout(own)), parts
    assert min(kinds.values()) > 300


def test_boxes_cut_runs(spark):
    """Runs of many pitches in boxes that cut them, against the same glyphs a row each."""
    r = random.Random(6)
    runs = [(d, p, k * 1000, "".join(r.choices("abc de", k=r.randrange(1, 30))), x, y, x + 5.0, y + 9.0, r.choice([0.3, 5.0, 6.1])) for d in (1, 2) for p in (1, 2) for k in range(60) for x, y in [(r.randrange(0, 800) / 3, float(r.randrange(0, 200)))]]
    boxes = [(r.choice([1, 2, 3]), f"b{k}", r.choice([1, 2]), (x, y, x + r.choice([0, 20, 300]), y + r.choice([5, 40]))) for k in range(100) for x, y in [(float(r.randrange(0, 300)), float(r.randrange(0, 200)))]]
    layer, held = spark.createDataFrame(runs, RUN), spark.createDataFrame(boxes, f"doc_id long, block_id string, page int, bbox {BOX}")
    rows = [(d, p, at + k, c, x + k * a, b, right + k * a, t) for d, p, at, text, x, b, right, t, a in runs for k, c in enumerate(text)]
    single = spark.createDataFrame(rows, "doc_id long, page int, draw_idx long, ch string, l double, b double, r double, t double")
    got = {tuple(x) for x in glyphs.inside(held, layer, KEYS).collect()}
    assert got == {tuple(x) for x in glyphs.inside(held, single, KEYS).collect()} and len(got) > 1000
    assert {tuple(x) for x in glyphs.regions(held, layer).collect()} == {tuple(x) for x in glyphs.regions(held, single).collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_is_a_glyph(spark, tmp_path):
    """Regions of lines shuffle a row a line and box, those of cells nothing; results are whole."""
    text = "\n".join(["one two  three", "", " four" * 300, "x"] * 40)
    spark.createDataFrame([(k, text) for k in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cells, lines, laid = (f(spark, str(tmp_path)) for f in (trees.j8_cells, trees.j8_regions, trees.x18_layouts))
    assert "Exchange" not in plan(cells) and plan(lines).count("Exchange") == 1 and "explode(split(_line" not in plan(laid)
    want = trees.cells(spark, str(tmp_path)).where("text <> ''").select("doc_id", "row", "col", "text")
    assert cells.count() == want.count() and cells.exceptAll(want).isEmpty()
    assert {x.reading for x in lines.where(F.col("doc_id") == 1).collect()} == {x for x in text.split("\n") if x}


def test_layouts_of_odd_lines(spark, tmp_path):
    """Short lines whose steps are half of one width and half of two, lines of blanks alone, tabs, other blanks, control characters: as the SQL has them."""
    texts = ["a bc", "A in", "   ", "\n \n", "a\tb\n\tc", "\t", "\u00a0a\u00a0b\u00a0", "\u3000", "con\x1crm\n  x", "ab c d e", "", None, " a\n  b\n\n\n   c\nd", "x\r\ny"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {x[0:2]: x[2] for x in con.execute(trees.X18).fetchall()}
    assert {(x.doc_id, x.page): x.layout for x in trees.x18_layouts(spark, str(tmp_path)).collect()} == want and want[0, 1] == "a bc"
