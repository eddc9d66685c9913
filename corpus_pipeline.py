"""From documents to token counts: toxic documents go, boilerplate lines go, near copies go, sources are mixed, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, linededup, mixing, neardup, toxicity
from vellum.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Similarity in percent that makes two documents near copies.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold. Null and empty texts stay, as do all rows where no labels are."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, freed of their source's boilerplate lines; n_chars counts the new text. Null texts stay null."""
    cleaned = linededup.drop_lines(docs.select(*COLUMNS), "source", Scratch(spark, "pipeline-lines"))
    return cleaned.withColumn("n_chars", F.when(F.col("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id; texts without words all stay."""
    return neardup.dedup(docs.select(*COLUMNS), Scratch(spark, "pipeline-near"), NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its sources takes it."""
    by_source = Scratch(spark, "pipeline-mix").table(docs.groupBy("source").agg(F.sum(mixing.words()).alias("source_size")), "sources")
    sized = docs.select(*COLUMNS).withColumn("size", mixing.words())
    return mixing.repeat(mixing.mix(sized, by_source)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, n_tokens, and the hashes of its ids and of the text decoded from them."""
    return bpe.round_trip(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: The first, third and last stages learn, hash sets and merge symbols, which SQL doesn't express; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
