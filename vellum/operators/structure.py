"""Section trees: nesting of headings and bookmarks, the section of each block, how a document splits into files."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import headings as h
from vellum.functions import text as t
from vellum.sources.shared import Scratch

SPLIT_PAGES, SPLIT_SECTIONS = 40, 2


def is_heading() -> Column:
    return (F.col("type") == "heading") & ~t.is_blank(F.col("text"))


def from_headings(blocks: DataFrame) -> DataFrame:
    """Sections (doc_id, seq, section_id, parent_seq, title, depth, kind, page_start).

    A heading's parent is the nearest earlier one of lesser depth that no heading between them closes, which is the
    nearest of lesser depth at all: the latest seq over the lesser depths. No parent: the root.
    """
    found = blocks.where(is_heading()).withColumn("depth", h.depth(F.col("text"), F.col("level")))
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.max(F.when(F.col("depth") == k, F.col("seq"))).over(before).alias(f"at{k}") for k in range(1, h.DEEPEST)]
    seen = found.select("*", *latest)
    lesser = [F.when(F.col("depth") > k, F.col(f"at{k}")) for k in range(1, h.DEEPEST)]
    title = t.strip(F.col("text"))
    return seen.select("doc_id", "seq", F.col("block_id").alias("section_id"), F.greatest(*lesser).alias("parent_seq"), title.alias("title"), "depth", h.kind(title).alias("kind"), F.col("page").alias("page_start"))


def sections_of_blocks(blocks: DataFrame) -> DataFrame:
    """Adds section_seq: the last heading at or before the block; null for what stands before the first."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section_seq", F.last(F.when(is_heading(), F.col("seq")), ignorenulls=True).over(order))


def from_bookmarks(bookmarks: DataFrame) -> DataFrame:
    """Bookmarks (doc_id, seq, title, page_index, level) as sections; depth is level + 1 without a limit.

    The parents come from a fold that keeps the open sections of each document, whose bookmarks are one small array.
    """
    node = F.struct("seq", "title", "page_index", (F.col("level") + 1).alias("depth"))
    listed = bookmarks.groupBy("doc_id").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    start = F.struct(F.expr("cast(array() as array<struct<seq:int,depth:int>>)").alias("open"), F.expr("cast(array() as array<int>)").alias("parents"))

    def step(state: Column, x: Column) -> Column:
        still = F.filter(state["open"], lambda o: o["depth"] < x["depth"])
        parent = F.get(still, F.size(still) - 1)["seq"]
        return F.struct(F.concat(still, F.array(F.struct(x["seq"].cast("int").alias("seq"), x["depth"].cast("int").alias("depth")))).alias("open"), F.concat(state["parents"], F.array(parent)).alias("parents"))

    folded = listed.select("doc_id", "nodes", F.aggregate("nodes", start, step, lambda s: s["parents"]).alias("parents"))
    out = folded.select("doc_id", F.posexplode("nodes").alias("k", "n"), "parents").select("doc_id", "n.*", F.get("parents", F.col("k")).alias("parent_seq"))
    kind = F.when(F.col("depth") == 1, "chapter").otherwise("section")
    named = F.concat(F.lit("bm:"), F.col("page_index"), F.lit(":"), F.substring("title", 1, 24))
    return out.select("doc_id", "seq", named.alias("section_id"), "parent_seq", "title", "depth", kind.alias("kind"), (F.col("page_index") + 1).alias("page_start"))


def ancestry(sections: DataFrame, scratch: Scratch) -> DataFrame:
    """Sections (doc_id, seq, parent_seq, ...) with tree_depth, 1 for those below the root, and root_seq, the top one above.

    Pointer doubling: each section knows an ancestor and how far it is; in each round it takes its ancestor's, so that
    rounds are as many as the logarithm of the deepest section.
    """
    up = F.coalesce("parent_seq", "seq").alias("up")
    now = scratch.table(sections.select("doc_id", "seq", up, F.col("parent_seq").isNotNull().cast("int").alias("steps")), "up-0")
    for k in itertools.count(1):
        above = now.select("doc_id", F.col("seq").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        step = now.join(above, ["doc_id", "up"]).select("doc_id", "seq", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("further") != F.col("up")).alias("moved"))
        step = scratch.table(step, f"up-{k}")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return sections.join(now.select("doc_id", "seq", (F.col("steps") + 1).alias("tree_depth"), F.col("up").alias("root_seq")), ["doc_id", "seq"])


def sections_by_page(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds section_seq: sections are gone through in order up to the first that starts behind the block's page.

    With the running maximum of the starts, those are the sections whose maximum is at most the page. Both sides
    are put in one order by page, sections first, and the last section so far is a running maximum: one
    shuffle by doc_id, no pairs.
    """
    running = F.max("page_start").over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    starts = sections.select("doc_id", "seq", running.alias("page")).select("doc_id", "page", F.lit(0).alias("_kind"), F.col("seq").alias("_section"), F.lit(None).alias("_row"))
    rows = blocks.select("doc_id", "page", F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_section"), F.struct(*blocks.columns).alias("_row"))
    both = rows.unionByName(starts.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    order = Window.partitionBy("doc_id").orderBy("page", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("section_seq", F.max("_section").over(order)).where("_kind = 1").select("_row.*", "section_seq")


def splits(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """Whether each document (doc_id, page_count) splits: enough pages, and enough sections below the root."""
    top = sections.where(F.col("parent_seq").isNull()).groupBy("doc_id").agg(F.count("*").alias("top_sections"))
    joined = documents.join(top, "doc_id", "left")
    n = F.coalesce("top_sections", F.lit(0))
    return joined.select("doc_id", "page_count", n.alias("top_sections"), ((n >= SPLIT_SECTIONS) & (F.col("page_count") >= SPLIT_PAGES)).alias("split"))


def heading_plan(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """For the headings of each file (keys, seq, text, title): skip, and the text that replaces it.

    A heading that repeats the title goes. A bare label takes the next heading into itself, which goes; if that
    one repeats the title, both go. A taken heading that is a label takes the next all the same.
    """
    return with_heading_plan(blocks.where(is_heading()), keys)


def with_heading_plan(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """All blocks with the plan of heading_plan; skip and merged are null for those that are no headings.

    The headings of a file are a partition of their own beside its other blocks, so that blocks which lie together by doc_id stay where they are.
    """
    found = blocks.withColumn("_heading", F.coalesce(is_heading(), F.lit(False)))
    found = found.withColumn("_head", F.when(F.col("_heading"), t.strip(F.col("text"))))
    order = Window.partitionBy(*keys, "_heading").orderBy("seq")
    title = F.when(F.col("_heading"), h.normalized_title(F.col("title")))
    dup = (title != "") & (h.normalized_title(F.col("_head")) == title)
    seen = found.withColumn("_dup", F.coalesce(dup, F.lit(False))).withColumn("_next", F.lead("_head").over(order)).withColumn("_next_dup", F.lead("_dup", 1, False).over(order))
    label = F.when(F.col("_heading"), h.is_label(F.col("_head")) & ~F.col("_dup") & F.col("_next").isNotNull())
    seen = seen.withColumn("_label", label)
    skip = F.when(F.col("_heading"), F.col("_dup") | (F.col("_label") & F.col("_next_dup")) | F.lag("_label", 1, False).over(order))
    merged = F.when(F.col("_label") & ~F.col("_next_dup"), F.concat("_head", F.lit(": "), "_next"))
    return seen.withColumn("skip", skip).withColumn("merged", merged).drop("_heading", "_head", "_next", "_next_dup", "_dup", "_label")
