"""The operators as queries: production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, fertility, linededup, linkgraph, mixing, neardup, phrases, reshard, tiff, tokenfile, topk, toxicity, variants
from vellum.llm.common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"), Scratch(spark, "op1"))


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.score(table(spark, sf_dir, "documents"))


def op3_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in 40 shards, from 32: the affected shards are written, and sizes, hashes, shards and slots read back from them."""
    scratch = Scratch(spark, "op3")
    rows = reshard.documents_in_shards(table(spark, sf_dir, "documents"), 32)
    back = reshard.rewritten(rows, reshard.plan(rows, 40, 32, scratch), scratch.path("shards"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + reshard.EACH).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return back.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = Scratch(spark, "op5").path("tokens")
    return tokenfile.read_checks(spark, uri, tokenfile.write(table(spark, sf_dir, "documents"), uri))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words().alias("size"))
    mixed = mixing.mix(Scratch(spark, "op6").table(docs, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = f"WITH docs AS (SELECT * FROM documents), {mixing.MIX_SQL} SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.components(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def _freed(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"), "text")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text are one page of their source."""
    return _freed(linededup.drop_lines(table(spark, sf_dir, "documents"), "source", Scratch(spark, "op9")))


OP9_SQL = f"""WITH docs AS (SELECT * FROM documents), {linededup.LINES_SQL}
SELECT doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(parts) - len(keep), 0) AS BIGINT) AS n_dropped,
  CASE WHEN len(keep) < len(parts) THEN array_to_string(keep, chr(10)) ELSE text END AS text FROM cleaned"""


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.round_trip(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"), Scratch(spark, "op11"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"), Scratch(spark, "op12"))


OP12_SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.forms(variants.word_counts(table(spark, sf_dir, "documents")), Scratch(spark, "op13"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_linkgraph, op2_fertility, op3_flow_reshard, op4_bpe, op5_tokenfile, op6_mixing, op7_toxicity, op8_neardup, op9_linededup, op10_tiff)
    return {f.__name__: f for f in (*ops, op11_collocations, op12_topk, op13_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op9_linededup": OP9_SQL, "op11_collocations": phrases.SQL, "op12_topk": OP12_SQL}
