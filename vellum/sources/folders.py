"""Finished outputs in folders, root/doc_id/v<version>/file_name: making their rows, and reading audits' inputs out of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import audit, coverage
from vellum.operators.emit import FORMAT_VERSION
from vellum.operators.versions import newest_rows
from vellum.plans.convert import Result, complete

PROVENANCE, PROFILE, README = "provenance.json", "profile.json", "README.md"
#: What provenance keeps of each block.
BLOCK = {"block_id": "string", "seq": "int", "type": "string", "text": "string", "page": "int", "status": "string", "flag": "string", "ocr": "boolean", "crop_path": "string", "confidence": "double", "transcribed": "string"}
SAID = f"source_path string, page_count int, section_source string, lossless boolean, blocks array<struct<{', '.join(f'{n}:{k}' for n, k in BLOCK.items())}>>"
PLACE = r"/([^/]+)/v([0-9]+)/([^/]+)$"


def rows(result: Result, versions: DataFrame, tool: str, started: datetime, finished: datetime) -> DataFrame:
    """(doc_id, version, file_name, content) of a conversion: markdown, profile, summary and, as the mark of a whole version, provenance.

    versions: (doc_id, version) of each document; one that isn't there gets version 1.
    """
    files = result.files.select(F.col("doc_id"), "file_name", F.col("body").alias("content"))
    profile = coverage.profile_json(result.profile, result.files).select("doc_id", F.lit(PROFILE).alias("file_name"), "content")
    summary = coverage.readme(result.profile).select("doc_id", F.lit(README).alias("file_name"), "content")
    kept = complete(result.rendered, BLOCK)
    blocks = kept.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", *[n for n in BLOCK if n != "seq"]))).alias("blocks"))
    j = result.documents.join(blocks, "doc_id", "left").join(result.report.select("doc_id", "total_blocks", "emitted", "cropped", "flagged", "dropped", "illegible", "flags", "lossless"), "doc_id", "left")
    counts = F.struct("total_blocks", "emitted", "cropped", "flagged", "dropped", "illegible", "flags")
    fields = [F.lit(tool).alias("tool_version"), "engine_versions", F.lit(FORMAT_VERSION).alias("format_version"), F.col("file_name").alias("source_path"), F.col("doc_id").cast("string").alias("source_sha256"), "page_count"]
    times = [F.lit(started.isoformat()).alias("started_at"), F.lit(finished.isoformat()).alias("finished_at"), F.lit(round((finished - started).total_seconds(), 2)).alias("duration_s")]
    said = j.select("doc_id", F.lit(PROVENANCE).alias("file_name"), F.to_json(F.struct(*fields, *times, "section_source", F.coalesce("lossless", F.lit(True)).alias("lossless"), counts.alias("coverage"), "blocks")).alias("content"))
    own = files.unionByName(profile).unionByName(summary).unionByName(said).join(versions.select("doc_id", "version"), "doc_id", "left")
    return own.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("version", F.lit(1)).cast("int").alias("version"), "file_name", "content")


def _place(k: int) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), PLACE, k)


def _whole(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(doc_id, version, file_name, content) of the files below root whose name fits."""
    found = spark.read.option("wholetext", True).option("pathGlobFilter", name).option("recursiveFileLookup", True).text(root)
    out = found.select(_place(1).alias("doc_id"), _place(2).cast("int").alias("version"), _place(3).alias("file_name"), F.col("value").alias("content"))
    return out.where(F.col("version").isNotNull())


def newest(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, version) of each document's newest complete version. Their paths say it: no file is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", PROVENANCE).option("recursiveFileLookup", True).load(root)
    named = found.select(F.regexp_extract("path", PLACE, 1).alias("doc_id"), F.regexp_extract("path", PLACE, 2).cast("int").alias("version"))
    return newest_rows(named.where("version IS NOT NULL").withColumn("complete", F.lit(True))).select("doc_id", "version")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The files of that name, as a pattern, of each document's newest complete version."""
    return _whole(spark, root, name).join(newest(spark, root), ["doc_id", "version"], "left_semi")


def provenance(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, version, source_path, page_count, section_source, lossless, blocks) of the newest complete versions."""
    return read(spark, root, PROVENANCE).select("doc_id", "version", F.from_json("content", SAID).alias("p")).select("doc_id", "version", "p.*")


def blocks(spark: SparkSession, root: str) -> DataFrame:
    """Their blocks, a row each, with the source's name."""
    source = F.element_at(F.split("source_path", "/"), -1).alias("source")
    return provenance(spark, root).select("doc_id", source, F.explode("blocks").alias("b")).select("doc_id", "source", "b.*")


def outputs(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, source, pages, tables, markdown, prose_legibility, confidence, ocr_pages): what audits compare; the summary is no markdown of the document."""
    own = read(spark, root, "*.md").where(F.col("file_name") != README)
    md = own.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_name", "content"))), lambda x: x["content"]), "\n").alias("markdown"))
    kind = "prose_legibility double, confidence string, ocr_pages bigint, by_type map<string,bigint>"
    profile = read(spark, root, PROFILE).select("doc_id", F.from_json("content", kind).alias("p")).select("doc_id", "p.prose_legibility", "p.confidence", "p.ocr_pages", F.coalesce(F.try_element_at("p.by_type", F.lit("table")), F.lit(0)).alias("tables"))
    said = provenance(spark, root).select("doc_id", F.element_at(F.split("source_path", "/"), -1).alias("source"), F.col("page_count").alias("pages"))
    return said.join(md, "doc_id", "left").join(profile, "doc_id", "left").withColumn("markdown", F.coalesce("markdown", F.lit("")))


def signals(spark: SparkSession, root: str) -> DataFrame:
    """audit.signals of a folder of outputs."""
    return audit.signals(blocks(spark, root), outputs(spark, root).select("doc_id", "source", "pages", "tables", "markdown"))


def facts(spark: SparkSession, root: str, labels: DataFrame) -> DataFrame:
    """audit.facts of a folder of outputs."""
    return audit.facts(outputs(spark, root), labels)


def similarity(spark: SparkSession, root: str, labels: DataFrame) -> DataFrame:
    """audit.similarity of a folder's equations to labels (source, block_id, latex)."""
    return audit.similarity(labels, blocks(spark, root).where("type = 'equation'"))


def baseline(spark: SparkSession, root: str) -> DataFrame:
    """What a later run is compared with: each source's invariants and whether it was lossless, to be written as JSON."""
    return signals(spark, root).select("source", *audit.INVARIANTS, "lossless")
