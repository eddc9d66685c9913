"""Blocks from plain texts and from HTML pages, and a file scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements that become blocks of a type of their own.
ELEMENTS = r"(?is)<(h[1-6]|p|li|pre|figcaption|td|th)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p|li|pre|figcaption|td|th)>"
LINES_A_PAGE = 40


def scan(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """binaryFile rows below root whose name fits; an empty folder gives no rows."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)


def from_text(docs: DataFrame, lines_a_page: int = LINES_A_PAGE) -> DataFrame:
    """Documents (doc_id, text) to blocks, a line each, all paragraphs but bullets and numbered headings."""
    line = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("seq", "text"))
    numbered = F.col("text").rlike(r"^\s*[0-9]+(\.[0-9]+)*\s+\p{Lu}") & (F.length("text") < 80)
    kind = F.when(F.col("text").rlike(r"^\s*[-*•] "), "list").when(numbered, "heading").otherwise("paragraph")
    return line.select("doc_id", "seq", F.concat(F.lit("#/texts/"), "seq").alias("block_id"), kind.alias("type"), "text", (F.floor(F.col("seq") / lines_a_page) + 1).cast("int").alias("page"), F.lit(None).cast("int").alias("level"))


def from_html(pages: DataFrame) -> DataFrame:
    """Pages (page_id, html) to blocks, one for each text element; headings keep their level."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    found = F.arrays_zip(F.regexp_extract_all(bare, F.lit(ELEMENTS), 1).alias("tag"), F.regexp_extract_all(bare, F.lit(ELEMENTS), 2).alias("body"))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("seq", "e")).select("doc_id", "seq", F.lower("e.tag").alias("tag"), "e.body")
    text = F.regexp_replace(F.col("body"), r"(?s)<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    kind = F.when(F.col("tag").rlike("^h[1-6]$"), "heading").when(F.col("tag") == "li", "list").when(F.col("tag") == "pre", "code").when(F.col("tag") == "figcaption", "caption").when(F.col("tag").isin("td", "th"), "other").otherwise("paragraph")
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    return rows.select("doc_id", "seq", F.concat(F.lit("#/texts/"), "seq").alias("block_id"), kind.alias("type"), F.trim(F.regexp_replace(text, r"(?U)\s+", " ")).alias("text"), F.lit(1).alias("page"), level.alias("level"))


def bookmarks(raw: DataFrame) -> DataFrame:
    """Table-of-contents entries with a page and a title that isn't blank."""
    return raw.where(F.col("page_index").isNotNull() & (F.trim("title") != "")).withColumn("title", F.trim("title"))
