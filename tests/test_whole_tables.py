"""Tables that come whole: the markup of the flat grid, without a shuffle."""

import random

from pyspark.sql import functions as F

from vellum.operators import tables as tb
from vellum.queries import trees

CELL = "array<struct<row:int,col:int,row_span:int,col_span:int,header:boolean,text:string>>"


def test_markup_of_whole_tables(spark):
    r = random.Random(3)
    tables = [(1, "empty", 0, 3, []), (1, "bare", 2, 2, []), (2, "null", 1, 1, [(0, 0, 1, 1, None, None)])]
    for k in range(60):
        rows, cols = r.randrange(1, 6), r.randrange(1, 5)
        places = r.sample([(y, x) for y in range(rows) for x in range(cols)], k=r.randrange(rows * cols + 1))
        tables.append((3, f"t{k}", rows, cols, [(y, x, r.choice([1, 1, 2]), r.choice([1, 1, 3]), y < 2 and r.random() < 0.7, r.choice(["a", "b|c", "d\ne", "", "x y"])) for y, x in places]))
    whole = spark.createDataFrame(tables, f"doc_id long, block_id string, num_rows int, num_cols int, cells {CELL}")
    cells = whole.select("doc_id", "block_id", F.explode("cells").alias("c")).select("doc_id", "block_id", "c.*").withColumn("bbox", F.lit(None).cast("string"))
    sizes = whole.drop("cells")
    html, gfm = tb.html(tb.grid(cells, sizes)), tb.gfm(tb.grid(cells.withColumn("text", tb.markdown_cell(F.col("text"))), sizes))
    want = {(x.doc_id, x.block_id): (x.html, x.gfm) for x in html.join(gfm, tb.KEY).collect()}
    got = {(x.doc_id, x.block_id): (x.html, x.gfm) for x in tb.markup_of_tables(whole).collect()}
    assert got == want and len(got) == 62


def test_words_of_tables_are_not_shuffled(spark):
    assert "Exchange" not in trees.x42_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
