"""What operators may not hold in the driver."""

from pyspark.sql import functions as F

from vellum.llm import variants
from vellum.llm.common import Scratch


def test_no_words_of_variants_are_broadcast(spark):
    """Small files of words, whose rows for each band and half Spark takes for as small."""
    words = spark.createDataFrame([("banana", 50), ("bananas", 5), ("banena", 5), ("cherry", 9)], "word string, n long")
    words = Scratch(spark, "t").table(words, "words")
    pairs, out = variants.near_pairs(words), variants.forms(words, Scratch(spark, "t"))
    assert {(x.a, x.b) for x in pairs.collect()} == {("banana", "bananas"), ("banana", "banena")}
    assert {(x.word, x.root) for x in out.where(F.col("word") != F.col("root")).collect()} == {("bananas", "banana"), ("banena", "banana")}
    for df in (pairs, out):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
