"""Documents as layout engines nest them, one JSON each: items in reading order, tables with cells, figures with captions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import repair
from vellum.functions import text as t
from vellum.operators import tables as tb
from vellum.operators import translate
from vellum.plans.convert import Source
from vellum.sources.shared import Scratch

# The fields of the nested format that are read.
_BOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
_REFS = "array<struct<`$ref`:string>>"
_PROV = f"array<struct<page_no:int,bbox:{_BOX}>>"
_CELL = f"struct<text:string,bbox:{_BOX},row_span:int,col_span:int,start_row_offset_idx:int,end_row_offset_idx:int,start_col_offset_idx:int,end_col_offset_idx:int,column_header:boolean,row_header:boolean>"
_ITEM = f"struct<self_ref:string,label:string,text:string,level:int,children:{_REFS},captions:{_REFS},prov:{_PROV},data:struct<num_rows:int,num_cols:int,table_cells:array<{_CELL}>>>"
DOCUMENT = f"body struct<children:{_REFS}>, groups array<{_ITEM}>, texts array<{_ITEM}>, tables array<{_ITEM}>, pictures array<{_ITEM}>, pages map<string,struct<size:struct<width:double,height:double>>>"
LISTS = ("groups", "texts", "tables", "pictures")


def parsed(documents: DataFrame, column: str = "content") -> DataFrame:
    """(doc_id, body, groups, texts, tables, pictures, pages) of documents (doc_id, content); what is no JSON has null in all."""
    return documents.select("doc_id", F.from_json(F.col(column).cast("string"), DOCUMENT).alias("_d")).select("doc_id", "_d.*")


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, ref, kind, item): all items of the lists, in the tree or not."""
    each = [docs.select("doc_id", F.lit(kind).alias("kind"), F.explode(kind).alias("item")) for kind in LISTS]
    return functools.reduce(DataFrame.unionByName, each).select("doc_id", F.col("item.self_ref").alias("ref"), "kind", "item")


def reading_order(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, seq, ref, kind, item) of the items below the body in preorder, groups left out.

    Level by level each item's children get its way from the body and their own places; ordered by their ways, items are in
    preorder. Below a picture only its captions are walked. A reference to no item, or back to an item above, leads nowhere.
    """
    refs = F.transform("body.children", lambda c: c["$ref"])
    now = docs.select("doc_id", F.posexplode(refs).alias("at", "ref"))
    now = now.select("doc_id", "ref", F.array("at").alias("way"), F.array("ref").alias("above"))
    placed, k = [], 0
    while True:
        level = scratch.table(now.join(items, ["doc_id", "ref"]), f"level-{k}")
        if level.isEmpty():
            break
        placed.append(level)
        own = F.transform(F.coalesce("item.children", F.expr(f"cast(array() as {_REFS})")), lambda c: c["$ref"])
        captions = F.transform(F.coalesce("item.captions", F.expr(f"cast(array() as {_REFS})")), lambda c: c["$ref"])
        walked = F.when(F.col("kind") == "pictures", F.array_intersect(own, captions)).otherwise(own)
        now = level.select("doc_id", "way", "above", F.posexplode(walked).alias("at", "ref")).where(~F.array_contains("above", F.col("ref")))
        now = now.select("doc_id", "ref", F.concat("way", F.array("at")).alias("way"), F.concat("above", F.array("ref")).alias("above"))
        k += 1
    if not placed:
        return items.limit(0).select("doc_id", F.lit(0).alias("seq"), "ref", "kind", "item")
    every = functools.reduce(DataFrame.unionByName, placed).where("kind <> 'groups'")
    order = Window.partitionBy("doc_id").orderBy("way")
    return every.select("doc_id", (F.row_number().over(order) - 1).alias("seq"), "ref", "kind", "item")


def _sides(box: Column) -> Column:
    return F.when(box.isNotNull(), F.struct(box["l"].alias("x0"), box["t"].alias("y0"), box["r"].alias("x1"), box["b"].alias("y1")))


def _prov(item: str) -> Column:
    return F.transform(f"{item}.prov", lambda p: F.struct(p["page_no"].alias("page"), _sides(p["bbox"]).alias("bbox")))


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page, width, height)."""
    found = docs.select("doc_id", F.explode("pages").alias("no", "p"))
    return found.select("doc_id", F.col("no").cast("int").alias("page"), F.col("p.size.width").alias("width"), F.col("p.size.height").alias("height"))


def blocks(ordered: DataFrame) -> DataFrame:
    """Blocks of the items in reading order, as translate.blocks makes them."""
    items = ordered.select("doc_id", "seq", F.col("ref").alias("item_id"), F.col("item.label").alias("label"), F.col("item.text").alias("text"), F.col("item.level").alias("level"), _prov("item").alias("prov"))
    return translate.blocks(items)


def cells(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, block_id, row, col, row_span, col_span, header, text, bbox) of all tables, boxes from the bottom; sizes: pages."""
    own = items.where("kind = 'tables'").select("doc_id", F.col("ref").alias("block_id"), F.get("item.prov", F.lit(0))["page_no"].alias("page"), F.explode("item.data.table_cells").alias("c"))
    raw = own.join(sizes.select("doc_id", "page", F.col("height").alias("page_height")), ["doc_id", "page"], "left")
    raw = raw.select(
        "doc_id", "block_id", "page_height", F.col("c.start_row_offset_idx").alias("row_start"), F.col("c.end_row_offset_idx").alias("row_end"), F.col("c.start_col_offset_idx").alias("col_start"), F.col("c.end_col_offset_idx").alias("col_end"),
        F.coalesce("c.column_header", F.lit(False)).alias("column_header"), F.coalesce("c.row_header", F.lit(False)).alias("row_header"), repair.normalize(F.coalesce("c.text", F.lit(""))).alias("text"), _sides(F.col("c.bbox")).alias("bbox"), F.col("c.bbox.coord_origin").alias("origin"),
    )
    return translate.cells(raw)


def tables(items: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, block_id, page, bbox, num_rows, num_cols, has_spanning_cells, gfm, html): GFM always, HTML where a cell spans."""
    place = F.get(_prov("item"), F.lit(0))
    own = items.where("kind = 'tables'").select("doc_id", F.col("ref").alias("block_id"), F.coalesce(place["page"], F.lit(0)).alias("page"), place["bbox"].alias("bbox"), F.coalesce("item.data.num_rows", F.lit(0)).alias("num_rows"), F.coalesce("item.data.num_cols", F.lit(0)).alias("num_cols"))
    spans = cells.groupBy(*tb.KEY).agg(F.bool_or((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("_spans"))
    plain = tb.grid(cells.withColumn("text", tb.markdown_cell(F.col("text"))), own)
    marked = tb.grid(cells.withColumn("text", t.escape(F.col("text"))), own)
    j = own.join(spans, tb.KEY, "left").join(tb.gfm(plain), tb.KEY, "left").join(tb.html(marked), tb.KEY, "left")
    spanning = F.coalesce("_spans", F.lit(False))
    return j.select(*own.columns, spanning.alias("has_spanning_cells"), F.coalesce("gfm", F.lit("")).alias("gfm"), F.when(spanning, F.col("html")).alias("html"))


def figures(items: DataFrame) -> DataFrame:
    """(doc_id, block_id, page, bbox, caption, caption_bbox): captions are the texts that a picture refers to, the box that of the first with a place."""
    place = F.get(_prov("item"), F.lit(0))
    own = items.where("kind = 'pictures'").select("doc_id", F.col("ref").alias("block_id"), F.coalesce(place["page"], F.lit(0)).alias("page"), place["bbox"].alias("bbox"), F.transform("item.captions", lambda c: c["$ref"]).alias("_refs"))
    said = own.select(*tb.KEY, F.posexplode("_refs").alias("k", "ref")).join(items.select("doc_id", "ref", "item"), ["doc_id", "ref"])
    listed = said.groupBy(*tb.KEY).agg(F.sort_array(F.collect_list(F.struct("k", F.col("item.text").alias("text"), F.get(_prov("item"), F.lit(0))["bbox"].alias("bbox")))).alias("_c"))
    text = F.nullif(F.array_join(F.array_compact(F.col("_c.text")), ""), F.lit(""))
    box = F.get(F.filter("_c", lambda c: c["bbox"].isNotNull()), F.lit(0))["bbox"]
    j = own.join(listed, tb.KEY, "left").withColumn("_text", text)
    return j.select("doc_id", "block_id", "page", "bbox", repair.normalize(F.col("_text")).alias("caption"), box.alias("caption_bbox"))


def source(documents: DataFrame, glyphs: DataFrame, scratch: Scratch, bookmarks: DataFrame | None = None) -> Source:
    """What convert.run takes, of documents (doc_id, file_name, content, ...) as nested JSON; documents that are none have no blocks and no pages."""
    docs = scratch.table(parsed(documents), "parsed")
    items = scratch.table(nodes(docs), "nodes")
    sizes = pages(docs)
    own = cells(items, sizes)
    counted = documents.drop("content", "page_count").join(sizes.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count")), "doc_id", "left")
    counted = counted.withColumn("page_count", F.coalesce("page_count", F.lit(0)))
    return Source(counted, blocks(reading_order(docs, items, scratch)).withColumn("confidence", F.lit(None).cast("double")), glyphs, tables(items, own), own, figures(items), bookmarks, sizes)
