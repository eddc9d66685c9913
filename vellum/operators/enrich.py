"""Validated repair of blocks, tables and figures against the glyph layer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import equations as e
from vellum.functions import repair
from vellum.functions import text as t
from vellum.operators import glyphs as gl
from vellum.operators import tables as tb
from vellum.operators import vocabulary
from vellum.sources.shared import Scratch

#: What names a text or a box of a document; row and col are -1 but for cells, and kind says which text of the block it is.
PLACE = ["doc_id", "kind", "block_id", "row", "col"]


def placed(df: DataFrame, kind: str, *columns: Column | str) -> DataFrame:
    """Rows of one kind under PLACE; those that are no cells have no row and col."""
    at = ["row", "col"] if kind == "cell" else [F.lit(-1).alias("row"), F.lit(-1).alias("col")]
    return df.select("doc_id", F.lit(kind).alias("kind"), "block_id", *at, *columns)


def of_kind(df: DataFrame, kind: str, *columns: Column | str) -> DataFrame:
    return df.where(F.col("kind") == kind).select("doc_id", "block_id", *(["row", "col"] if kind == "cell" else []), *columns)


#: What repair makes of blocks; columns of these names are replaced.
MADE = ("ocr", "preformatted", "text_source", "text_layer", "ordered", "reading", "marks", "disorder", "layout")


def rows_of(blocks: DataFrame, tables: DataFrame, cells: DataFrame, figures: DataFrame) -> DataFrame:
    """(PLACE, page, bbox, text, own): all boxes and all texts, own being what else blocks have."""
    own = F.struct(*[c for c in blocks.columns if c not in ("doc_id", "block_id", "page", "bbox", "text", *MADE)]).alias("own")
    rows = placed(blocks, "block", "page", "bbox", "text", own)
    kinds = {f.name: f.dataType for f in rows.schema}
    null = lambda n: F.lit(None).cast(kinds[n]).alias(n)
    celled = cells.join(tables.select(*tb.KEY, "page"), tb.KEY, "left")
    for df, kind, columns in (
        (tables, "table", ("page", "bbox", null("text"))), (celled, "cell", ("page", "bbox", "text")), (figures, "caption", ("page", F.col("caption_bbox").alias("bbox"), F.col("caption").alias("text"))),
        (tables, "gfm", (null("page"), null("bbox"), F.col("gfm").alias("text"))), (tables, "html", (null("page"), null("bbox"), F.col("html").alias("text"))),
    ):
        rows = rows.unionByName(placed(df, kind, *columns, null("own")))
    return rows


def prepared(regions: DataFrame) -> DataFrame:
    """Rows of rows_of with their measures, and `scanned`, as repair of words takes them: text is laid out, refilled or as it was, which is `was`.

    Code is read again from the layout. Prose that is laid out is kept so; other prose, cells and captions are refilled where they are garbage, cells
    then without the pipes that stand for rules. Of readings and marks what finishing reads is kept, of layouts those that differ from the reading.
    """
    kind, text, type_ = F.col("kind"), F.col("text"), F.col("own.type")
    block, boxed, raised = kind == "block", F.col("bbox").isNotNull(), F.coalesce(F.col("marks").rlike(r"[\^_]"), F.lit(False))
    laid, readable = F.coalesce("layout", F.lit("")), ~F.col("scanned") & boxed
    prose, code = F.coalesce(block & readable & type_.isin(*t.PROSE), F.lit(False)), F.coalesce(block & readable & (type_ == "code"), F.lit(False))
    # what one line, or a text that can be read, needs no look at costs nothing
    held = F.when(prose | (kind.isin("cell", "caption") & boxed), text)
    j = regions.withColumns({"_bad": F.coalesce(t.is_garbage(held), F.lit(False)), "_pre": F.when(prose & laid.rlike(r"[\n\r]"), t.is_preformatted(laid)).otherwise(False)})
    j = j.withColumns({"_laid": t.clean_preformatted(F.when(code | F.col("_pre"), laid), repair.unglyph), "_normal": repair.normalize(F.when(F.col("_bad"), F.coalesce("reading", F.lit(""))))})
    better = t.clean_reading(F.col("_normal"))
    j = j.withColumn("_prose", prose & ~F.col("_pre")).withColumn("_filled", F.when(F.col("_bad") & (F.length(better) > 0) & ~t.is_garbage(better), better).otherwise(text))
    filled, reread = F.col("_filled"), code & (F.length("_laid") > 0) & ~t.is_garbage(F.col("_laid"))
    new = F.when(reread | F.col("_pre"), F.col("_laid")).when(F.col("_prose"), filled)
    new = new.when((kind == "cell") & boxed & (filled != text), t.drop_rule_pipes(filled)).when((kind == "caption") & boxed & F.col("reading").isNotNull(), filled).otherwise(text)
    read = F.when(raised | (kind == "table") | (block & (type_ == "equation") & readable), F.col("reading"))
    return j.select(
        *PLACE, "page", "scanned", "bbox", "own", F.when(kind != vocabulary.PAGE, text).alias("was"), new.alias("text"), read.alias("reading"), F.when(raised, F.col("marks")).alias("marks"), "disorder",
        F.when(F.col("layout") != F.col("reading"), F.col("layout")).alias("layout"), "_pre", "_prose", (F.col("_prose") & (filled != text)).alias("_refilled"),
        (kind == vocabulary.PAGE).alias(vocabulary.PAGE), (F.col("_prose") | kind.isin("cell", "caption", "gfm", "html")).alias("_joins"),
    )


def finished_blocks(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks after repair, with ocr, preformatted, text_source, text_layer and ordered.

    On a page without a text layer nothing can be checked: ocr is set, and an equation with a box gets confidence 0. Prose has its words
    joined, and scripts are marked. An equation is scored against the reading, which is kept where they disagree.
    """
    j = regions.where("kind = 'block'")
    ocr, reading, was, own = F.col("scanned"), F.coalesce("reading", F.lit("")), F.col("was"), F.col("own")
    equation = (own["type"] == "equation") & F.col("bbox").isNotNull()
    j = j.withColumn("_agreed", F.when(equation & ~ocr, e.agreement(was, reading)))
    suspect = F.when(equation & ~ocr, e.reading_below(F.col("_agreed"), reading))
    confidence = F.when(equation & ocr, 0.0).when(equation, F.coalesce("_agreed", own["confidence"])).otherwise(own["confidence"])
    ordered = F.when(suspect.isNotNull(), t.is_clean(reading) & (F.coalesce("disorder", F.lit(0.0)) < e.SCRAMBLED_ABOVE))
    new = F.when(F.col("_prose"), repair.apply_scripts(F.col("text"), reading, F.coalesce("marks", F.lit("")))).otherwise(F.col("text"))
    kept = [F.col(c) if c in ("doc_id", "block_id", "page", "bbox") else own[c].alias(c) for c in blocks.columns if c not in ("text", "confidence", *MADE)]
    return j.select(*kept, new.alias("text"), confidence.alias("confidence"), ocr.alias("ocr"), F.col("_pre").alias("preformatted"), F.when(F.col("_refilled"), "glyphs").alias("text_source"), repair.normalize(suspect).alias("text_layer"), ordered.alias("ordered"))


def finished_cells(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells with `repaired` (for markdown) and `repaired_html`: refilled, words joined, scripts marked."""
    j = cells.join(of_kind(regions, "cell", F.col("text").alias("_text"), "reading", "marks"), [*tb.KEY, "row", "col"], "left")
    whole, reading, marks = F.coalesce("_text", "text"), F.coalesce("reading", F.lit("")), F.coalesce("marks", F.lit(""))
    return j.select(*cells.columns, tb.markdown_cell(repair.apply_scripts(whole, reading, marks)).alias("repaired"), repair.apply_scripts(whole, reading, marks, escape=True).alias("repaired_html"))


def finished_tables(tables: DataFrame, cells: DataFrame, layouts: DataFrame, scanned: DataFrame, joined: DataFrame) -> DataFrame:
    """Tables (doc_id, block_id, page, num_rows, num_cols, has_spanning_cells, gfm, html) with their final markup, and `preformatted`.

    cells: finished; layouts: (doc_id, block_id, layout); joined: (doc_id, kind, block_id, text), kinds gfm and html. A table that is
    laid out by characters is kept as it stands. One with a garbage cell or recovered scripts, on a page with a text layer, is built anew
    from its repaired cells (a spanning one in HTML alone); others have their words joined.
    """
    built = tb.grid(cells.withColumn("text", F.col("repaired_html")), tables)
    plain = tb.grid(cells.withColumn("text", F.col("repaired")), tables)
    j = tables.join(layouts.select(*tb.KEY, "layout"), tb.KEY, "left").join(tb.needs_rebuild(cells), tb.KEY, "left")
    j = j.join(scanned.select("doc_id", "page", F.lit(True).alias("_scan")), ["doc_id", "page"], "left")
    j = j.join(tb.html(built).withColumnRenamed("html", "new_html"), tb.KEY, "left").join(tb.gfm(plain).withColumnRenamed("gfm", "new_gfm"), tb.KEY, "left")
    for kind in ("gfm", "html"):
        j = j.join(of_kind(joined, kind, F.col("text").alias(f"joined_{kind}")), tb.KEY, "left")
    readable, layout = F.col("_scan").isNull(), F.coalesce("layout", F.lit(""))
    pre = readable & F.col("bbox").isNotNull() & t.is_preformatted(layout, pipes=True)
    anew, spans = F.coalesce("rebuild", F.lit(False)) & readable & ~pre, F.coalesce("has_spanning_cells", F.lit(False))
    gfm = F.when(anew & spans, "").when(anew, F.col("new_gfm")).when(pre, F.col("gfm")).otherwise(F.coalesce("joined_gfm", "gfm"))
    html = F.when(anew & spans, F.col("new_html")).when(anew, F.lit(None)).when(pre, F.col("html")).otherwise(F.coalesce("joined_html", "html"))
    kept = [c for c in tables.columns if c not in ("gfm", "html", "preformatted")]
    return j.select(*kept, gfm.alias("gfm"), html.alias("html"), F.when(pre, t.clean_preformatted(layout, repair.unglyph)).alias("preformatted"))


def finished_figures(figures: DataFrame, regions: DataFrame) -> DataFrame:
    j = figures.join(of_kind(regions, "caption", F.col("text").alias("_text")), ["doc_id", "block_id"], "left")
    return j.withColumn("caption", F.coalesce("_text", "caption")).drop("_text").select(*figures.columns)


@dataclass
class Enriched:
    blocks: DataFrame
    tables: DataFrame
    figures: DataFrame
    scanned: DataFrame


def enrich(blocks: DataFrame, glyphs: DataFrame, scratch: Scratch, tables: DataFrame, cells: DataFrame, figures: DataFrame) -> Enriched:
    """All repairs of blocks, tables, cells and figures against glyphs (doc_id, page, draw_idx, ch, l, b, r, t).

    Boxes, texts and glyphs meet in one shuffle, by document, and stay where they lie: pages are measured, texts prepared, and then,
    sorted behind the pages of their document, joined to its words. tables: (doc_id, block_id, page, bbox, num_rows, num_cols, has_spanning_cells,
    gfm, html); cells: (doc_id, block_id, row, col, row_span, col_span, header, text, bbox); figures: (doc_id, block_id, page, caption, caption_bbox, ...).
    Empty tables of any of these will do. scanned: the pages (doc_id, page) without a text layer.
    """
    rows = rows_of(blocks, tables, cells, figures)
    keys = [*PLACE[1:], "bbox", "text", "own"]
    pages = gl.whole_pages(rows, glyphs, keys, {"kind": F.lit(vocabulary.PAGE)})
    done = vocabulary.joined(prepared(gl.regions_of_pages(pages, ["doc_id", "page", "scanned", *keys], every=True)), "_joins", "pairs")
    # a text that stayed as it was is kept once
    new = F.when(~F.col("text").eqNullSafe(F.col("was")), F.struct("text"))
    regions = scratch.table(done.withColumn("new", new).drop("text"), "regions")
    regions = regions.withColumn("text", F.when(F.col("new").isNotNull(), F.col("new.text")).otherwise(F.col("was"))).drop("new")
    shown = regions.where(F.col("kind").isin("block", "table", "caption") & (F.col("scanned") | F.col("doc_id").isNull() | F.col("page").isNull()))
    scanned = scratch.table(shown.select("doc_id", "page").distinct(), "scanned")
    scratch.table(regions.select("doc_id", F.explode("pairs").alias("p")).select("doc_id", "p.*").distinct(), "good")
    layouts = of_kind(regions, "table", F.coalesce("layout", "reading").alias("layout"))
    return Enriched(
        scratch.table(finished_blocks(regions, blocks), "prepared-blocks"),
        scratch.table(finished_tables(tables, finished_cells(cells, regions), layouts, scanned, regions), "tables"),
        scratch.table(finished_figures(figures, regions), "figures"),
        scanned,
    )
