"""Title, authors, year and DOI of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import metadata as m
from vellum.functions import text as t


def metadata(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, title, authors, year, doi) of documents (doc_id, file_name, embedded MAP), from the embedded data and page 1."""
    heading = (F.col("type") == "heading") & ~t.is_blank(F.col("text"))
    first = blocks.where("page = 1").groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("page_text"),
        t.strip(F.min_by("text", F.when(heading, F.col("seq")))).alias("first_heading"),
    )
    j = documents.join(first, "doc_id", "left")
    text = F.coalesce("page_text", F.lit(""))

    def embedded(key: str):
        return F.nullif(F.trim(F.try_element_at("embedded", F.lit(key))), F.lit(""))

    return j.select("doc_id", F.coalesce(embedded("Title"), "first_heading").alias("title"), m.authors(embedded("Author")).alias("authors"), m.year(text, F.col("file_name")).alias("year"), m.doi(text).alias("doi"))
