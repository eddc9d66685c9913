"""From an engine's items to blocks, cells, tables and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import repair

# The block type for each label of a layout engine; anything else is `other`.
LABELS = {
    "title": "heading", "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "list_item": "list", "table": "table", "picture": "figure",
    "formula": "equation", "code": "code", "caption": "caption", "footnote": "footnote", "page_header": "page_header", "page_footer": "page_footer",
}


def block_type(label: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[label], F.lit("other"))


def first_place(prov: Column) -> Column:
    """The first provenance entry (page, bbox), or null."""
    return F.get(prov, F.lit(0))


def caption_box(captions: Column) -> Column:
    """The box of the first caption that has a place."""
    return F.get(F.get(F.filter(captions, lambda c: F.size(c["prov"]) > 0), F.lit(0))["prov"], F.lit(0))["bbox"]


def flipped(box: Column, origin: Column, page_height: Column) -> Column:
    """A top-left box on bottom-left axes; other origins and unknown heights leave it as it is."""
    turned = F.struct(box["x0"].alias("x0"), (page_height - box["y0"]).alias("y0"), box["x1"].alias("x1"), (page_height - box["y1"]).alias("y1"))
    return F.when((origin == "TOPLEFT") & page_height.isNotNull(), turned).otherwise(box)


def blocks(items: DataFrame) -> DataFrame:
    """Items (doc_id, seq, item_id, label, text, level, prov) with a place become blocks; an item whose text vanishes by clean-up goes."""
    place, clean = first_place(F.col("prov")), repair.normalize(F.coalesce("text", F.lit("")))
    placed = items.withColumn("place", place).where(F.col("place").isNotNull()).withColumn("clean", clean)
    vanished = (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.trim("clean") == "")
    return placed.where(~vanished).select("doc_id", "seq", F.col("item_id").alias("block_id"), block_type(F.col("label")).alias("type"), F.col("clean").alias("text"), F.col("place.page").alias("page"), F.col("place.bbox").alias("bbox"), "level")


def cells(raw: DataFrame) -> DataFrame:
    """Raw cells with start and end offsets, header marks, a box and its origin become grid cells."""
    return raw.select(
        "doc_id", "block_id", F.col("row_start").alias("row"), F.col("col_start").alias("col"), (F.col("row_end") - F.col("row_start")).alias("row_span"), (F.col("col_end") - F.col("col_start")).alias("col_span"),
        (F.col("column_header") | F.col("row_header")).alias("header"), "text", flipped(F.col("bbox"), F.col("origin"), F.col("page_height")).alias("bbox"),
    )


def tables(cells: DataFrame) -> DataFrame:
    """One row for each table: grid size, and whether any cell spans."""
    return cells.groupBy("doc_id", "block_id").agg(F.bool_or((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("has_spanning_cells"), F.max(F.col("row") + F.col("row_span")).cast("int").alias("num_rows"), F.max(F.col("col") + F.col("col_span")).cast("int").alias("num_cols"), F.count("*").alias("cells"))
