"""From blocks to files, coverage and profiles, keyed by doc_id throughout; and the whole way from an engine's results to outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import headings as h
from vellum.operators import bibliography, coverage, crops, emit, enrich, structure
from vellum.operators import tables as tb
from vellum.sources.config import Config
from vellum.sources.shared import Scratch

#: Columns that rendering reads, with their types, for blocks that don't have them.
WANTED = {
    "level": "int", "confidence": "double", "ocr": "boolean", "preformatted": "boolean", "crop_path": "string", "description": "string", "text_layer": "string", "ordered": "boolean",
    "transcribed": "string", "transcribed_source": "string", "text_source": "string", "table_text": "string", "table_preformatted": "string", "has_table": "boolean", "asset_path": "string",
    "caption": "string", "figure_description": "string", "depth": "int", "base_depth": "int", "skip": "boolean", "merged": "string",
}
#: As much for documents.
SAID = {"title": "string", "authors": "array<string>", "year": "string", "doi": "string", "file_name": "string", "page_count": "int", "engine_versions": "map<string,string>"}


@dataclass
class Result:
    rendered: DataFrame
    files: DataFrame
    report: DataFrame
    profile: DataFrame
    documents: DataFrame


def complete(rows: DataFrame, wanted: dict[str, str] = WANTED) -> DataFrame:
    return rows.withColumns({n: F.lit(None).cast(kind) for n, kind in wanted.items() if n not in rows.columns})


def with_tables(blocks: DataFrame, tables: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Blocks with the markup of their tables (doc_id, block_id, has_spanning_cells, html, gfm, preformatted) and their figures' assets."""
    said = tables.select(*tb.KEY, tb.rendered(F.col("has_spanning_cells"), F.col("html"), F.col("gfm")).alias("table_text"), F.col("preformatted").alias("table_preformatted"), F.lit(True).alias("has_table"))
    out = blocks.drop("table_text", "table_preformatted", "has_table").join(said, tb.KEY, "left")
    if figures is not None:
        own = figures.select(*tb.KEY, "asset_path", "caption", F.col("description").alias("figure_description"))
        out = out.drop("asset_path", "caption", "figure_description").join(own, tb.KEY, "left")
    return out


def titled(documents: DataFrame, bookmarks: DataFrame | None) -> DataFrame:
    """Documents with marked, whether bookmarks give their sections, and split, whether they become several files."""
    if bookmarks is None:
        return documents.withColumns({"marked": F.lit(False), "split": F.lit(False)})
    marked = bookmarks.select("doc_id").distinct().withColumn("marked", F.lit(True))
    split = structure.splits(structure.from_bookmarks(bookmarks), documents).select("doc_id", "split")
    named = documents.join(marked, "doc_id", "left").join(split, "doc_id", "left")
    return named.withColumns({"marked": F.coalesce("marked", F.lit(False)), "split": F.coalesce("split", F.lit(False))})


def sectioned(blocks: DataFrame, documents: DataFrame, bookmarks: DataFrame | None) -> DataFrame:
    """Blocks of the documents (doc_id, doc_title, marked, split) with those columns, section_seq, depth, file_no and file_title.

    A document with bookmarks takes its sections from those, and blocks by their page; any other from its headings. The
    depth of a heading block is that of the section it opens, which bookmarks have none of. Blocks are dealt by doc_id
    once, together with the bookmarks, and stay where they are.
    """
    if bookmarks is None:
        placed = structure.sections_of_blocks(blocks.join(documents, "doc_id"))
        placed = placed.withColumns({"file_no": F.lit(0), "file_title": F.lit(None).cast("string")})
    else:
        order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        root = F.col("parent_seq").isNull()
        number, name = F.sum(root.cast("int")).over(order).cast("int"), F.last(F.when(root, F.col("title")), ignorenulls=True).over(order)
        starts = structure.from_bookmarks(bookmarks).select("doc_id", F.max("page_start").over(order).alias("page"), F.lit(0).alias("_kind"), F.struct(F.col("seq").alias("seq"), number.alias("no"), name.alias("title")).alias("_start"))
        both = blocks.withColumn("_kind", F.lit(1)).unionByName(starts, allowMissingColumns=True).join(documents, "doc_id")
        by_page = Window.partitionBy("doc_id").orderBy("page", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        placed = structure.sections_of_blocks(both.withColumn("_start", F.max("_start").over(by_page)).where("_kind = 1"))
        placed = placed.withColumn("section_seq", F.when(F.col("marked"), F.col("_start.seq")).otherwise(F.col("section_seq")))
        placed = placed.withColumns({"file_no": F.coalesce(F.when(F.col("split"), F.col("_start.no")), F.lit(0)), "file_title": F.coalesce("_start.title", F.lit("Front matter"))}).drop("_kind", "_start")
    opens = structure.is_heading() & ~F.col("marked")
    return placed.withColumn("depth", F.when(opens, h.depth(F.col("text"), F.col("level"))).otherwise(F.col("depth")))


def convert(blocks: DataFrame, documents: DataFrame, rasters: DataFrame | None = None, bookmarks: DataFrame | None = None, label: str = emit.LABEL, scratch: Scratch | None = None) -> Result:
    """blocks (doc_id, seq, block_id, type, text, page, ...), documents (doc_id, title, page_count, file_name, ...).

    Long documents with several top bookmarks become a file for each and one of contents; all others are one file, an
    empty one where a document has no blocks. Blocks of documents that aren't in `documents` are in no file: the report has them as dropped.
    The files come of one pass over the blocks, which are shuffled once, by doc_id. With scratch, rendered blocks are
    written and read again, as files, report and profile all start from them.
    """
    blocks, documents = complete(blocks), titled(complete(documents, SAID), bookmarks)
    titles = documents.select("doc_id", F.coalesce("title", F.lit("Document")).alias("doc_title"), "marked", "split")
    numbered = sectioned(blocks, titles, bookmarks)
    apart = F.col("split")
    numbered = numbered.withColumn("title", F.when(apart, F.col("file_title")).otherwise(F.col("doc_title")))
    numbered = numbered.withColumn("file_name", F.when(apart, emit.file_name(F.col("file_no"), F.col("title"))).otherwise("document.md")).withColumn("base_depth", apart.cast("int"))
    rendered = emit.render(structure.with_heading_plan(numbered, ["doc_id", "file_name"]), label).drop("marked")
    if scratch is not None:
        rendered = scratch.table(rendered, "rendered")
    also = {"heads": emit.shown_headings(), "has_heads": F.max(structure.is_heading()), **coverage.front_figures()}
    files = emit.complete_files(emit.files(rendered, ["doc_id", "file_no", "file_name", "title", "split"], rasters, also), documents)
    lost = coverage.unplaced(blocks, blocks.join(documents.select("doc_id"), "doc_id", "left_semi"))
    report = coverage.report(rendered.unionByName(lost, allowMissingColumns=True))
    has = rendered.where(structure.is_heading()).select("doc_id").distinct().withColumn("_heads", F.lit(True))
    source = F.when(F.col("marked"), "bookmarks").when(F.col("_heads"), "heading_outline").otherwise("none")
    sources = documents.join(has, "doc_id", "left").withColumn("section_source", source).drop("marked", "_heads")
    if scratch is not None:
        sources = scratch.table(sources, "documents")
    return Result(rendered, files, report, coverage.profile(rendered, report, documents), sources)


@dataclass
class Source:
    """What an engine gives for many documents; all but documents, blocks and glyphs may be left out.

    documents: (doc_id, file_name, page_count, embedded MAP, ...); pages: (doc_id, page, width, height); files: (doc_id, content).
    """

    documents: DataFrame
    blocks: DataFrame
    glyphs: DataFrame
    tables: DataFrame | None = None
    cells: DataFrame | None = None
    figures: DataFrame | None = None
    bookmarks: DataFrame | None = None
    pages: DataFrame | None = None
    files: DataFrame | None = None


@dataclass
class Models:
    """What is asked of models: open_file renders crops, transcribe reads equations (seams of crops.seam), describe answers prompts."""

    open_file: Callable | None = None
    transcribe: Callable | None = None
    describe: Callable | None = None
    known: DataFrame | None = None  # answers of earlier runs: (key, text)


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
TABLE = f"doc_id %s, block_id string, page int, bbox {BOX}, num_rows int, num_cols int, has_spanning_cells boolean, gfm string, html string"
CELL = f"doc_id %s, block_id string, row int, col int, row_span int, col_span int, header boolean, text string, bbox {BOX}"
FIGURE = f"doc_id %s, block_id string, page int, bbox {BOX}, caption string, caption_bbox {BOX}"


def run(source: Source, scratch: Scratch, config: Config | None = None, models: Models | None = None, keep: bool = True) -> Result:
    """The whole conversion: repair against glyphs, scanned prose read again, metadata, crops, transcriptions, descriptions, files.

    Each step that a missing part or model would need is left out. Answers come before metadata and structure where they
    replace text, and transcriptions before descriptions, which don't override them. keep: rendered blocks are written, for callers that
    read several parts of the result; without, each part renders them anew, and files come of the pass that deals blocks out.
    """
    config, models, spark = config or Config(), models or Models(), source.blocks.sparkSession
    key = dict(source.blocks.dtypes)["doc_id"]
    tables, cells, figures = (df if df is not None else spark.createDataFrame([], kind % key) for df, kind in ((source.tables, TABLE), (source.cells, CELL), (source.figures, FIGURE)))
    blocks, figures = source.blocks, complete(figures, {"asset_path": "string", "description": "string"})
    if config.enrich:
        found = enrich.enrich(blocks, source.glyphs, scratch, tables, cells, figures)
        blocks, tables, figures = found.blocks, found.tables, found.figures
    blocks, tables = complete(blocks), complete(tables, {"preformatted": "string"})
    shooting = models.open_file is not None and source.files is not None and source.pages is not None
    cache = models.known if models.known is not None else spark.createDataFrame([], "key string, text string")

    def taken(regions: DataFrame, name: str) -> DataFrame:
        rects = crops.rectangles(regions, source.pages, config.crop_dpi, config.crop_padding)
        return scratch.table(crops.shots(source.files, rects, models.open_file), name)

    def asked(pictures: DataFrame, contexts: DataFrame, name: str) -> DataFrame:
        rows = pictures.where("png IS NOT NULL").join(contexts, ["doc_id", "block_id"]).select("doc_id", "block_id", "crop_kind", "context", "png")
        said, _ = crops.describe(rows, cache, models.describe, config.model or "model", config.ocr_model)
        return scratch.table(said.where("said IS NOT NULL").select("doc_id", "block_id", "said"), name)

    if shooting and models.describe is not None:
        prose = crops.scanned_prose(blocks).withColumn("crop_kind", F.lit("ocr"))
        answers = asked(taken(prose, "ocr-shots"), prose.select("doc_id", "block_id", F.lit("").alias("context")), "ocr-answers")
        blocks = scratch.table(crops.reread(blocks, answers), "reread")
    documents = source.documents
    said = bibliography.metadata(blocks, complete(documents, {"embedded": "map<string,string>", "file_name": "string"}))
    documents = scratch.table(documents.drop("title", "authors", "year", "doi", "embedded").join(said, "doc_id", "left"), "described")
    if shooting:
        shown = figures.where("bbox IS NOT NULL").select("doc_id", "block_id", F.lit("figure").alias("crop_kind"), "page", "bbox")
        rendered = tables.where((F.trim(F.coalesce("gfm", F.lit(""))) != "") | F.col("html").isNotNull())
        wanted = crops.to_crop(blocks, rendered).select("doc_id", "block_id", "crop_kind", "page", "bbox").unionByName(shown)
        pictures = taken(wanted, "shots")
        good = pictures.where("png IS NOT NULL").withColumn("path", crops.asset(F.col("block_id"), F.col("page")))
        cropped = good.where("crop_kind <> 'figure'").select("doc_id", "block_id", F.col("path").alias("_path"))
        blocks = blocks.join(cropped, ["doc_id", "block_id"], "left").withColumn("crop_path", F.coalesce("_path", "crop_path")).drop("_path")
        seen = good.where("crop_kind = 'figure'").select("doc_id", "block_id", F.col("path").alias("_path"))
        figures = figures.join(seen, ["doc_id", "block_id"], "left").withColumn("asset_path", F.coalesce("_path", "asset_path")).drop("_path")
        if models.transcribe is not None:
            equations = good.where("crop_kind = 'equation'")
            answers = equations.select("doc_id", "block_id", models.transcribe("png", F.lit("")).alias("said")).where("said IS NOT NULL")
            blocks = crops.transcribed(blocks, scratch.table(answers, "transcriptions"))
        if models.describe is not None:
            context = blocks.select("doc_id", "block_id", F.coalesce("text", F.lit("")).alias("context")).join(figures.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti")
            context = context.unionByName(figures.select("doc_id", "block_id", F.coalesce("caption", F.lit("")).alias("context")))
            untold = good.join(blocks.where("transcribed IS NOT NULL").select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti")
            answers = asked(untold, context, "descriptions")
            blocks = crops.described(blocks, answers)
            figures = figures.join(answers, ["doc_id", "block_id"], "left").withColumn("description", F.coalesce("said", "description")).drop("said")
    if source.tables is not None or source.figures is not None or shooting or not config.enrich:
        blocks = scratch.table(with_tables(blocks, tables, figures), "rendering")
    else:
        blocks = blocks.drop("table_text", "table_preformatted", "has_table", "asset_path", "caption", "figure_description")
    return convert(blocks, documents, None, source.bookmarks, config.label, scratch if keep else None)
