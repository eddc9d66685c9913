"""Words are joined where the texts of a document lie: one shuffle, nothing stored, no row a word."""

from pyspark.sql import functions as F

from vellum.operators import vocabulary
from vellum.queries import scalars
from vellum.sources import shared

DIR = "/root/testdata/sf0.001"


def test_texts_are_shuffled_once_and_not_stored(spark, monkeypatch):
    monkeypatch.setattr(shared.Scratch, "table", lambda self, df, name: 1 / 0)
    plan = scalars.x9_repaired(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_documents_that_share_a_task_keep_their_words_apart(spark):
    """Small batches, so that documents and their pages go over several; texts without a document, without pages, of null."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        texts = [(k, f"b{n}", "x di ff erent, lo wdin") for k in range(12) for n in range(4)] + [(None, "n", "lo wdin"), (99, "p", "lo wdin"), (1, "z", None)]
        df = spark.createDataFrame(texts, "doc_id long, block_id string, text string")
        pages = [(k, w) for k in range(12) for w in (["filler"] * 5 + ["different"] * (k % 2) + ["lowdin"] * (k % 3 == 0) + ["lo lowdin"] * (k == 9))] + [(None, "lowdin"), (2, None)]
        got = vocabulary.repair_words(df.coalesce(1), spark.createDataFrame(pages, "doc_id long, text string"))
        rows = [tuple(x) for x in got.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def want(k, s):
        if k is None or k == 99 or s is None:
            return s
        return f"x {'different' if k % 2 else 'di ff erent'}, {'lowdin' if k % 3 == 0 and k != 9 else 'lo wdin'}"

    assert sorted(rows, key=str) == sorted([(k, b, want(k, s)) for k, b, s in texts], key=str)


def test_the_joined_pairs_can_be_asked_for(spark):
    df = spark.createDataFrame([(1, True, "lowdin able", True), (1, False, "lo wdin ab le lo wdin", True), (1, False, "lo wdin", False)], "doc_id long, _page boolean, text string, fix boolean").coalesce(1)
    got = vocabulary.joined(df, "fix", "good").select("text", F.expr("transform(good, x -> concat(x.left, '+', x.whole))").alias("g")).collect()
    assert sorted((x.text, x.g) for x in got) == [("lo wdin", []), ("lowdin able lowdin", ["ab+able", "lo+lowdin"])]
