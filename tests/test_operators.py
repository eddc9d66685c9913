"""Operators against small cases with known results."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.functions import equations as e
from vellum.functions import headings as h
from vellum.functions import repair
from vellum.functions import text as t
from vellum.operators import audit, coverage, crops, emit, glyphs, structure, versions
from vellum.operators import tables as tb
from vellum.plans import convert
from vellum.queries import scalars, trees
from vellum.sources import outputs

DIR = "/root/testdata/sf0.001"


def one(spark, text, *columns):
    return list(spark.createDataFrame([(text,)], "text string").select(*columns).first())


def glyph(ch, left, b, r, top):
    return {"ch": ch, "l": left, "b": b, "r": r, "t": top}


@pytest.mark.parametrize(("text", "low", "high"), [("The quick fox", 1.0, 1.0), ("①②③④⑤ a", 0.0, 0.2), ("/a114 /a80 /a12", 0.0, 0.0), ("12345", 1.0, 1.0), ("αβγ CSF 1s2", 1.0, 1.0), ("", 1.0, 1.0)])
def test_legibility(spark, text, low, high):
    (found,) = one(spark, text, t.legibility(F.col("text")))
    assert low <= found <= high


def test_text_clean_up(spark):
    (reading,) = one(spark, "con\x1cguration\n and\x15 pract\x02i-cal ", t.clean_reading(F.col("text")))
    assert reading == "configuration and practi-cal"
    (normal,) = one(spark, "/Delta1 and /pictures ́x", repair.normalize(F.col("text")))
    assert normal == "Δ and /pictures x"
    assert one(spark, None, repair.normalize(F.col("text"))) == [None]


def test_scripts():
    water = [glyph("C", 0, 100, 8, 110), glyph("2", 8, 98, 12, 104), glyph("H", 12, 100, 20, 110)]
    assert glyphs.score(water) == " _ "
    power = [glyph("C", 0, 100, 8, 110), glyph("2", 8, 106, 12, 112), glyph("H", 12, 100, 20, 110)]
    assert glyphs.score(power) == " ^ "
    sign = [*water[:1], glyph("-", 8, 105, 10, 107), glyph("1", 10, 106, 12, 112), *water[2:]]
    assert glyphs.score(sign) == " ^^ "
    assert repair.overlay("C2H", "C2H", " _ ") == "C<sub>2</sub>H"
    assert repair.overlay("191.4", "191.4", " ^   ") == "191.4"
    assert repair.overlay("191.469", "191.469", "     ^^") == "191.4<sup>69</sup>"
    assert repair.overlay("a<2", "a<2", "  ^", True) == "a&lt;<sup>2</sup>"


def test_lines_keep_raised_glyphs():
    low = [glyph("a", 0, 0, 5, 10), glyph("2", 5, 6, 8, 12), glyph("b", 0, -20, 5, -10)]
    assert [len(x) for x in glyphs.lines(low)] == [2, 1]


def test_disorder():
    line = [glyph(c, 10 * k, 0, 10 * k + 8, 10) for k, c in enumerate("abcdef")]
    assert glyphs.disorder(line) == 0
    assert glyphs.disorder(line[::-1]) > 0.12
    assert glyphs.disorder(line[:3][::-1]) == 0


@pytest.mark.parametrize(("text", "want"), [("3.5.1 Deep", 3), ("Intro", 2), ("1.1.1.1.1.1.1 x", 6)])
def test_depth(spark, text, want):
    assert one(spark, text, h.depth(F.col("text"), F.lit(2))) == [want]


def test_equations(spark):
    assert one(spark, r"\mathrm{abc} , \max", F.array_sort(e.latex_tokens(F.col("text")))) == [["abc", "max"]]
    (score,) = one(spark, r"\text{abc} de fg", e.agreement(F.col("text"), F.lit("abc de fg")))
    assert score is not None and 0 <= score <= 1
    assert one(spark, "x", e.agreement(F.col("text"), F.lit("a b"))) == [None]
    assert one(spark, r"$ a & b {c $", e.markup(F.col("text"))) == ["$$\n\\begin{aligned}\na & b {c}\n\\end{aligned}\n$$"]
    assert one(spark, r"\left( x", e.balance_delimiters(F.col("text"))) == ["( x"]
    assert one(spark, "<math>x^2</math> and <math> y </math>", e.latex_from_html(F.col("text"))) == ["x^2 y"]
    assert one(spark, "<b>plain</b>", e.latex_from_html(F.col("text"))) == ["plain"]


def test_slug_of_punctuation_is_section(spark):
    assert one(spark, "--!--", h.slug(F.col("text"))) == ["section"]


def test_section_by_page_stops_at_the_first_later_start(spark):
    marks = spark.createDataFrame([("d", k, f"t{k}", p - 1, 0) for k, p in enumerate([1, 5, 3, 9], 1)], "doc_id string, seq int, title string, page_index int, level int")
    blocks = spark.createDataFrame([("d", k, p) for k, p in enumerate([0, 1, 3, 4, 5, 8, 9])], "doc_id string, seq int, page int")
    found = structure.sections_by_page(blocks, structure.from_bookmarks(marks)).orderBy("seq").collect()
    assert [r.section_seq for r in found] == [None, 1, 1, 1, 3, 3, 4]


def test_heading_plan(spark):
    def plan(title, *heads):
        rows = [("d", k, f"b{k}", "heading", x, title) for k, x in enumerate(heads)]
        df = spark.createDataFrame(rows, "doc_id string, seq int, block_id string, type string, text string, title string")
        return [(r.skip, r.merged) for r in structure.heading_plan(df, ["doc_id"]).orderBy("seq").collect()]

    assert plan("Part IV: Issues", "Part IV", "Issues") == [(True, None), (True, None)]
    assert plan("T", "Chapter 1", "Intro") == [(False, "Chapter 1: Intro"), (True, None)]
    assert plan("T", "Part I", "Chapter 1", "Intro") == [(False, "Part I: Chapter 1"), (True, "Chapter 1: Intro"), (True, None)]


def test_tables(spark):
    cells = spark.createDataFrame([("d", "t", 0, 0, 1, 2, True, "H"), ("d", "t", 1, 0, 1, 1, False, "a"), ("d", "t", 1, 1, 1, 1, False, "b")], "doc_id string, block_id string, row int, col int, row_span int, col_span int, header boolean, text string").withColumn("bbox", F.lit(None).cast("string"))
    sizes = spark.createDataFrame([("d", "t", 2, 2)], "doc_id string, block_id string, num_rows int, num_cols int")
    places = tb.grid(cells, sizes)
    assert tb.html(places).first().html == '<table><tbody><tr><th colspan="2">H</th></tr><tr><td>a</td><td>b</td></tr></tbody></table>'
    assert tb.gfm(places).first().gfm == "| H |  |\n|---|---|\n| a | b |"


def test_sample_document(spark):
    rows = [("#/texts/0", "heading", "1 Introduction", 1), ("#/texts/1", "paragraph", "Hello world.", 1), ("#/texts/2", "heading", "1.1 Background", 1), ("#/texts/3", "paragraph", "More text.", 1), ("#/texts/4", "equation", "E = mc^2", 2), ("#/tables/0", "table", "", 2), ("#/pictures/0", "figure", "", 2), ("#/texts/5", "footnote", "a footnote", 2), ("#/texts/6", "paragraph", "", 2)]
    blocks = spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], "doc_id string, seq int, block_id string, type string, text string, page int")
    tables = spark.createDataFrame([("d", "#/tables/0", False, None, "| A |\n|---|\n| 1 |", None)], "doc_id string, block_id string, has_spanning_cells boolean, html string, gfm string, preformatted string")
    figures = spark.createDataFrame([("d", "#/pictures/0", "assets/f.png", "Figure 1", None)], "doc_id string, block_id string, asset_path string, caption string, description string")
    docs = spark.createDataFrame([("d", "A Title", 2, "d.pdf")], "doc_id string, title string, page_count int, file_name string")
    got = convert.convert(convert.with_tables(convert.complete(blocks), tables, figures), docs)
    assert [r.status for r in got.rendered.orderBy("seq").collect()] == ["emitted"] * 6 + ["cropped", "emitted", "dropped"]
    report = got.report.first()
    assert (report.total_blocks, report.emitted, report.cropped, report.dropped, report.lossless) == (9, 7, 1, 1, True)
    body = got.files.first().body
    assert body.startswith("---\n") and "# A Title\n" in body and "## 1.1 Background" in body and "[^fn1]: a footnote" in body and "$$\nE = mc^2\n$$" in body
    assert got.profile.first().confidence == "high"
    assert coverage.unplaced(blocks, got.rendered.where("seq < 8")).count() == 1
    assert coverage.profile_json(got.profile, got.files).count() == 1 and coverage.readme(got.profile).count() == 1


def test_links_skip_front_matter_and_fences():
    text = "---\ntitle: section 1.1\n---\nsee section 1.1 and section 7\n```\nsection 1.1\n```\nSect. 9.2"
    got = emit.link(text, "a.md", {"1.1": ("a.md", "11-x"), "9.2": ("b.md", "92-y")})
    assert got == "---\ntitle: section 1.1\n---\nsee [section 1.1](#11-x) and section 7\n```\nsection 1.1\n```\n[Sect. 9.2](b.md#92-y)\n"


def test_versions(spark):
    v = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, False)], "doc_id string, version int, complete boolean")
    assert [tuple(r) for r in versions.latest(v).orderBy("doc_id").collect()] == [("a", 2, 3), ("b", None, 1)]
    assert {(r.doc_id, r.version) for r in versions.pruned(v, 1).collect()} == {("a", 1), ("a", 3), ("b", 1)}


def test_models_are_asked_once_for_equal_crops(spark):
    rows = [("d", str(k), "figure", "", bytearray(b"x" if k < 2 else b"y")) for k in range(3)]
    shots = spark.createDataFrame(rows, "doc_id string, block_id string, crop_kind string, context string, png binary")
    known = spark.createDataFrame([], "key string, text string")

    def make():
        def model(png, prompt):
            if png == b"y":
                raise ValueError
            return "seen"

        return model

    said, new = crops.describe(shots, known, crops.seam(make), "m")
    assert sorted(str(r.said) for r in said.collect()) == ["None", "seen", "seen"] and new.count() == 1
    assert tuple(crops.tally(said).first()) == (3, 1)


def test_regressions(spark):
    schema = "source string, dropped int, ligature_residual int, unbalanced_eq int, illegible int, illegible_table_rows int, lossless boolean"
    was = spark.createDataFrame([("a", 0, 0, 0, 0, 0, True), ("gone", 0, 0, 0, 0, 0, True)], schema)
    now = spark.createDataFrame([("a", 1, 0, 0, 0, 0, False), ("new", 0, 0, 0, 0, 0, True)], schema)
    assert {(r.source, r.verdict, r.key) for r in audit.compare(now, was).collect()} == {("a", "regressed", "dropped"), ("a", "regressed", "lossless"), ("new", "new", None), ("gone", "missing", None)}


def test_vocabulary_of_all_lines(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    words = {r.doc_id: sorted(set(re.findall("[A-Za-z]+", unicodedata.normalize("NFKC", r.text)))) for r in docs}
    got = {r.doc_id: (r.n, r.digest) for r in scalars.t1_vocabulary(spark, DIR).collect()}
    assert got == {k: (len(w), hashlib.md5(" ".join(w).encode()).hexdigest()) for k, w in words.items() if w}


def test_tables_of_all_words(spark):
    def brute(doc_id, text):
        spans, places, at = doc_id % 4 == 0, {}, 0
        for w in text.replace("\n", " ").split(" "):
            while at % 7 == 5 or (spans and at == 1):
                at += 1
            places[at], at = w, at + 1
        rows = [[3 * r + c for c in range(3)] for r in range(max(places) // 3 + 1)]
        head = [r == 0 or (r == 1 and doc_id % 3 == 0 and any(p in places for p in row)) for r, row in enumerate(rows)]
        tags = ["th" if h else "td" for h in head]
        cell = [["" if spans and p == 1 else f"<{t}{' colspan=' + chr(34) + '2' + chr(34) if spans and p == 0 else ''}>{places[p]}</{t}>" if p in places else "<td></td>" for p in row] for t, row in zip(tags, rows, strict=True)]
        lines = ["| " + " | ".join(places.get(p, "").replace("|", "\\|") for p in row) + " |" for row in rows]
        first = int(len(head) > 1 and head[1])
        html = "<table><tbody>" + "".join(f"<tr>{''.join(c)}</tr>" for c in cell) + "</tbody></table>"
        gfm = "\n".join([lines[first], "|---|---|---|", *lines[:first], *lines[first + 1 :]])
        return html, gfm, hashlib.md5((html if spans else gfm).encode()).hexdigest()

    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    got = {r.doc_id: (r.html, r.gfm, r.rendered) for r in trees.x42_tables(spark, DIR).collect()}
    assert got == {r.doc_id: brute(r.doc_id, r.text) for r in docs}


def test_a_run_that_died_leaves_no_second_copy(spark, tmp_path):
    """Files of a run that wrote no provenance, then the same version again: each file is read once, as last written."""
    root = str(tmp_path / "out")
    files = spark.createDataFrame([("d", 1, "a.md", "old"), ("e", 1, "a.md", "e")], "doc_id string, version int, file_name string, content string")
    again = files.withColumn("content", F.concat("content", F.lit("!")))
    said = files.select("doc_id", "version").distinct()
    outputs.write(files, said.where("doc_id = 'e'"), root)
    outputs.write(again.where("doc_id = 'd'"), said.where("doc_id = 'd'"), root)
    got = {(r.doc_id, r.file_name): r.content for r in outputs.read(spark, root).collect()}
    assert got == {("d", "a.md"): "old!", ("e", "a.md"): "e"} and outputs.read(spark, root).count() == 2
    listed = outputs.export(outputs.read(spark, root), f"file://{tmp_path}/files").collect()
    assert len(listed) == 2 and (tmp_path / "files" / "d" / "v1" / "a.md").read_text() == "old!"


def test_entry_without_a_third_party_module(tmp_path):
    """A module that the training-data part needs is absent: the rest is still registered."""
    import subprocess
    import sys

    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), 'op7_toxicity' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 30 and said[1] == "False"
