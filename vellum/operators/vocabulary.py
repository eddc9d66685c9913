"""The words of a document's own text layer, and repairs held against them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import repair
from vellum.functions import text as t
from vellum.sources.shared import Scratch


def _found(text: Column) -> Column:
    """The ASCII words of a text, compatibility forms folded; plain texts stay in the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), repair.vocabulary(text)).otherwise(F.array_distinct(t.words(text)))


def words(pages: DataFrame) -> DataFrame:
    """(doc_id, word): the distinct words of all pages (doc_id, text)."""
    return pages.select("doc_id", F.explode(_found(pages["text"])).alias("word")).distinct()


def vocabulary(pages: DataFrame) -> DataFrame:
    """(doc_id, words): the distinct words of all pages as one sorted array."""
    return words(pages).groupBy("doc_id").agg(F.sort_array(F.collect_list("word")).alias("words"))


def page_texts(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, text): each page's glyphs, or runs of them, in drawing order."""
    ch = "text" if "text" in glyphs.columns else "ch"
    listed = glyphs.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("draw_idx", ch))).alias("g"))
    return listed.select("doc_id", "page", F.array_join(F.col(f"g.{ch}"), "").alias("text"))


#: What a row of `joined` is: a page of the document's text layer, whose words are known, or a text.
PAGE = "_page"


def joined(rows: DataFrame, wanted: str | None = None, pairs: str | None = None) -> DataFrame:
    """The texts of rows (doc_id, PAGE, text, ...) with split ligatures and split words joined where the document's pages have the word; pages go.

    PAGE says whether a row is a page of the document or one of its texts. Rows must lie together by doc_id. They are sorted, pages
    first, and a worker holds the distinct words of one document at a time; no row carries them, and no text is shuffled or stored
    for its words. wanted: a boolean column, of texts to be joined; others stay, as do those without a doc_id. pairs: a column
    for the split words that were joined (left, whole).
    """
    struct = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("whole", T.StringType())]))
    schema = T.StructType([f for f in rows.schema.fields if f.name not in (PAGE, wanted)] + ([T.StructField(pairs, struct)] if pairs else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, now, known = to_arrow_schema(schema), None, set()
        for batch in batches:
            own, asked = batch.column(PAGE), batch.column(wanted).to_pylist() if wanted else itertools.repeat(True)
            texts, used = [], []
            for doc, page, text, want in zip(batch.column("doc_id").to_pylist(), own.to_pylist(), batch.column("text").to_pylist(), asked, strict=False):
                if doc != now:
                    now, known = doc, set()
                if page:
                    if text is not None and doc is not None:
                        known.update(repair.words_of(text))
                    continue
                good: set[tuple[str, str]] = set()
                texts.append(repair.join_known(text, known, good) if want and text is not None and known else text)
                used.append([{"left": a, "whole": b} for a, b in sorted(good)])
            if texts:
                kept = batch.filter(pc.invert(own))
                columns = [pa.array(texts, f.type) if f.name == "text" else pa.array(used, f.type) if f.name == pairs else kept.column(f.name) for f in kind]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return rows.sortWithinPartitions("doc_id", F.col(PAGE).desc()).mapInArrow(run, schema)


def repair_words(blocks: DataFrame, pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """blocks with split ligatures and words of their texts joined where the document's pages (doc_id, text) have the word.

    One shuffle, by doc_id; nothing is stored, so that scratch may be left out.
    """
    rows = blocks.withColumn(PAGE, F.lit(False)).unionByName(pages.select("doc_id", "text", F.lit(True).alias(PAGE)), allowMissingColumns=True)
    return joined(rows.repartition("doc_id")).select(*blocks.columns)
