"""Which regions are cropped, where the crop lies in pixels, and what models say about crops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import equations as e
from vellum.functions import text as t

LEAST_SIDE = 4.0
#: What is asked of a vision model, by the kind of crop.
PROMPTS = {
    "figure": "Say what kind of figure this is and what it shows, in a few plain sentences. Copy labels exactly. Give no number that can't be read.",
    "table": "Write this table as a GitHub-flavored Markdown table; if it doesn't fit one, describe its columns. Add nothing.",
    "equation": "Write this equation as LaTeX and nothing else.",
    "ocr": "Write out the text in this image exactly, as plain text and nothing else.",
}
OCR_KINDS = ("table", "ocr")


def equations_to_crop(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("type") == "equation") & F.col("bbox").isNotNull() & (F.col("confidence") < e.RECOVER_BELOW))


def tables_to_crop(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Table blocks with a box that have no table data, or that were scanned."""
    known = tables.select("doc_id", "block_id", F.lit(True).alias("_known"))
    j = blocks.join(known, ["doc_id", "block_id"], "left")
    return j.where(F.col("bbox").isNotNull() & F.col("block_id").startswith("#/tables/") & (F.col("_known").isNull() | F.coalesce("ocr", F.lit(False)))).drop("_known")


def scanned_prose(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.coalesce("ocr", F.lit(False)) & F.col("bbox").isNotNull() & F.col("type").isin(*t.PROSE) & ~t.is_blank(F.col("text")))


def to_crop(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    return equations_to_crop(blocks).withColumn("crop_kind", F.lit("equation")).unionByName(tables_to_crop(blocks, tables).withColumn("crop_kind", F.lit("table")))


def pixels(box: Column, width: Column, height: Column, dpi: float = 200.0, padding: float = 4.0) -> Column:
    """The crop's pixel rectangle: bottom-left boxes turned, padded, clamped to the page; the whole page if a side is tiny."""
    turned = box["y0"] > box["y1"]
    top, bottom = F.when(turned, height - box["y0"]).otherwise(box["y0"]), F.when(turned, height - box["y1"]).otherwise(box["y1"])
    left, right = F.greatest(F.lit(0.0), F.least(box["x0"], box["x1"]) - padding), F.least(width, F.greatest(box["x0"], box["x1"]) + padding)
    top, bottom = F.greatest(F.lit(0.0), top - padding), F.least(height, bottom + padding)
    tiny = (right - left < LEAST_SIDE) | (bottom - top < LEAST_SIDE)
    scale = dpi / 72
    sides = (("left", left, F.lit(0.0)), ("top", top, F.lit(0.0)), ("right", right, width), ("bottom", bottom, height))
    return F.struct(*[(F.when(tiny, whole).otherwise(side) * scale).cast("int").alias(n) for n, side, whole in sides])


def prompt(kind: Column, context: Column) -> Column:
    base = F.coalesce(F.create_map(*[F.lit(x) for p in PROMPTS.items() for x in p])[kind], F.lit(PROMPTS["figure"]))
    near = F.trim(F.coalesce(context, F.lit("")))
    return F.when(near != "", F.concat(base, F.lit("\n\nContext: "), near)).otherwise(base)


def data_uri(png: Column) -> Column:
    """Base64 without the line breaks that Spark puts in."""
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(png), r"[\r\n]", ""))


def cache_key(model: Column, kind: Column, png: Column) -> Column:
    return F.concat_ws(":", model, kind, F.sha2(png, 256))


def model_for(kind: Column, model: str, ocr_model: str | None) -> Column:
    return F.when(kind.isin(*OCR_KINDS), F.lit(ocr_model or model)).otherwise(F.lit(model))


def seam(make: Callable[[], Callable[[bytes, str], str | None]]):
    """A pandas UDF (png, prompt) -> text around a model that each worker makes once; a call that fails gives null."""

    @F.pandas_udf(T.StringType())
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()

        def one(png: bytes, said: str) -> str | None:
            try:
                return model(png, said) or None
            except Exception:  # one unreadable crop must not end the run: the row stays without a text
                return None

        for pngs, prompts in batches:
            yield pd.Series([None if p is None else one(bytes(p), s) for p, s in zip(pngs, prompts, strict=True)], dtype=object)

    return call


def describe(crops: DataFrame, cache: DataFrame, call, model: str, ocr_model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Crops (doc_id, block_id, crop_kind, context, png) with `said`, and the answers that are new to the cache (key, text).

    Equal crops are asked about once; cached ones not at all.
    """
    keyed = crops.withColumn("key", cache_key(model_for(F.col("crop_kind"), model, ocr_model), F.col("crop_kind"), F.col("png")))
    misses = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    new = misses.select("key", call("png", prompt(F.col("crop_kind"), F.col("context"))).alias("text")).where(F.col("text").isNotNull())
    return keyed.join(cache.unionByName(new), "key", "left").withColumnRenamed("text", "said").drop("key"), new


def tally(said: DataFrame) -> DataFrame:
    """Calls and failures, exact under retries as they are counted from the rows."""
    return said.agg(F.count("*").alias("calls"), F.count_if(F.col("said").isNull()).alias("failures"))


def transcribed(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Equations' transcriptions from answers (doc_id, block_id, said); what is there already stays."""
    j = blocks.join(answers.select("doc_id", "block_id", "said"), ["doc_id", "block_id"], "left")
    take = (F.col("type") == "equation") & F.col("crop_path").isNotNull() & F.col("transcribed").isNull() & (F.col("said") != "")
    return j.withColumn("transcribed_source", F.when(take, "math OCR").otherwise(F.col("transcribed_source"))).withColumn("transcribed", F.when(take, F.col("said")).otherwise(F.col("transcribed"))).drop("said")


def described(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Cropped blocks take a vision model's answers (doc_id, block_id, said): an equation without a transcription as that, another as its description."""
    j = blocks.join(answers.select("doc_id", "block_id", "said"), ["doc_id", "block_id"], "left")
    take = F.col("crop_path").isNotNull() & (F.col("said") != "")
    hint = take & (F.col("type") == "equation") & F.col("transcribed").isNull()
    j = j.withColumn("transcribed_source", F.when(hint, "vision model").otherwise(F.col("transcribed_source"))).withColumn("transcribed", F.when(hint, F.col("said")).otherwise(F.col("transcribed")))
    return j.withColumn("description", F.when(take & (F.col("type") != "equation"), F.col("said")).otherwise(F.col("description"))).drop("said")


def reread(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Scanned prose takes a vision model's reading where there is one."""
    j = blocks.join(answers.select("doc_id", "block_id", "said"), ["doc_id", "block_id"], "left")
    take = F.coalesce(F.col("said") != "", F.lit(False))
    return j.withColumn("text", F.when(take, F.col("said")).otherwise(F.col("text"))).withColumn("text_source", F.when(take, "vision-ocr").otherwise(F.col("text_source"))).drop("said")


def asset(block_id: Column, page: Column) -> Column:
    """Where a crop lies below its document's folder."""
    name = F.translate(F.regexp_replace(block_id, "^[#/]+|[#/]+$", ""), "/", "_")
    return F.concat(F.lit("assets/"), name, F.lit("_p"), page.cast("string"), F.lit(".png"))


def rectangles(regions: DataFrame, pages: DataFrame, dpi: float, padding: float) -> DataFrame:
    """(doc_id, block_id, crop_kind, page, left, top, right, bottom) in pixels of regions (doc_id, block_id, crop_kind, page, bbox), with pages (doc_id, page, width, height)."""
    j = regions.join(pages, ["doc_id", "page"]).withColumn("_p", pixels(F.col("bbox"), F.col("width"), F.col("height"), dpi, padding))
    return j.select("doc_id", "block_id", "crop_kind", "page", "_p.left", "_p.top", "_p.right", "_p.bottom")


def shots(files: DataFrame, rects: DataFrame, open_file: Callable[[bytes], Callable[[int, tuple[int, int, int, int]], bytes]]) -> DataFrame:
    """(doc_id, block_id, crop_kind, page, png, error) of rects (as `rectangles` gives them) and files (doc_id, content).

    A document's file and its rectangles meet in one group, and the file is opened once: open_file(content) gives a function
    from a page and a rectangle to a PNG, which may have a `close`. What fails, a crop or a whole file, is a row with `error`;
    so are the rectangles of a document without a file. Of several files of one doc_id the first is taken, as their contents are the same.
    """
    names = ("left", "top", "right", "bottom")
    kind = T.StructType([f for f in rects.schema.fields if f.name in ("doc_id", "block_id", "crop_kind", "page")] + [T.StructField("png", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(mine: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out, crop, failed = [], None, None
        if len(mine) and not len(there):
            failed = "no file"
        elif len(mine):
            try:
                crop = open_file(bytes(there["content"].iloc[0]))
            except Exception as e:  # one bad file must not end the run: its rows say what failed
                failed = f"{type(e).__name__}: {e}"
        for r in mine.sort_values("page").to_dict("records"):
            png, error = None, failed
            if crop is not None:
                try:
                    png = crop(int(r["page"]), tuple(int(r[n]) for n in names))
                except Exception as e:  # as above, for one crop
                    error = f"{type(e).__name__}: {e}"
            out.append((*(r[n] for n in kind.names[:-2]), png, error))
        if hasattr(crop, "close"):
            crop.close()
        return pd.DataFrame(out, columns=kind.names)

    return rects.groupBy("doc_id").cogroup(files.select("doc_id", "content").groupBy("doc_id")).applyInPandas(run, kind)
