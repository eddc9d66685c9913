"""Streams that restart, files as partitions, versions that are whole or absent, audits of written folders."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vellum.operators import audit, crops
from vellum.plans import convert
from vellum.sources import files, folders
from vellum.sources.shared import Scratch
from vellum.streaming import dropfolder


def test_contents_are_converted_once(spark, tmp_path):
    """Two batches, a content that comes again, a restart from the checkpoint: nothing twice, nothing lost, `done` never read."""
    folder, done, checkpoint = tmp_path / "in", str(tmp_path / "done"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def run(**contents):
        for name, text in contents.items():
            (folder / name).write_text(text)
        query = dropfolder.convert_new(dropfolder.arrivals(spark, str(folder)), done, checkpoint, lambda new: new.select("doc_id", "path", F.col("content").cast("string").alias("text")))
        assert query.awaitTermination(60) and query.exception() is None
        return sorted(r.text for r in spark.read.parquet(done).collect())

    assert run(a="one", b="two", c="one") == ["one", "two"]
    assert run(d="two", e="three") == ["one", "three", "two"]
    assert run() == ["one", "three", "two"]


def test_models_are_asked_once_in_streams(spark, tmp_path):
    """Equal crops of one batch and of a later one are asked about once; failures are asked about again."""
    rows, calls = str(tmp_path / "rows"), str(tmp_path / "calls")
    kind = "doc_id string, key string, png binary, prompt string"

    def make():
        def model(png, prompt):
            with open(calls, "a") as f:
                f.write(f"{prompt}\n")
            if png == b"bad":
                raise ValueError
            return f"seen {prompt}"

        return model

    def run(batch):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(rows)
        said = dropfolder.answers(spark.readStream.schema(kind).parquet(rows), make)
        query = said.writeStream.format("parquet").option("path", str(tmp_path / "said")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(60) and query.exception() is None
        return sorted((r.doc_id, r.said or "") for r in spark.read.parquet(str(tmp_path / "said")).collect())

    assert run([("a", "k1", bytearray(b"x"), "p"), ("b", "k1", bytearray(b"x"), "p"), ("c", "k2", bytearray(b"bad"), "q")]) == [("a", "seen p"), ("b", "seen p"), ("c", "")]
    assert run([("d", "k1", bytearray(b"x"), "p"), ("e", "k2", bytearray(b"bad"), "q")])[-2:] == [("d", "seen p"), ("e", "")]
    assert open(calls).read().split() == ["p", "q", "q"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "sub" / "deep").mkdir(parents=True)
    for name, text in {"b.txt": "bb", "sub/a.txt": "a" * 50, "sub/deep/c.txt": "", "sub/deep/d.pdf": "no", "e.md": "listed"}.items():
        (root / name).write_text(text)
    return root


def test_files_of_several_roots(spark, tree):
    """Folders and single files, each file once and in order; partitions by size; a file that can't be read is a row."""
    spark.dataSource.register(files.Documents)
    paths = json.dumps([str(tree / "sub"), str(tree), f"file://{tree}/e.md"])
    df = spark.read.format("vellum_documents").option("paths", paths).option("pattern", "*.txt").option("partition_bytes", "40").load()
    got = df.select("path", "length", F.col("content").cast("string").alias("text"), "error", F.spark_partition_id().alias("part")).orderBy("path").collect()
    assert [(r.path.removeprefix(f"file://{tree}/"), r.length, r.text) for r in got] == [("b.txt", 2, "bb"), ("e.md", 6, "listed"), ("sub/a.txt", 50, "a" * 50), ("sub/deep/c.txt", 0, "")]
    assert len({r.part for r in got}) == 3 and got[0].part == got[1].part
    gone = list(files.contents(files.Files([f"file://{tree}/gone"])))
    assert gone[0][0].endswith("gone") and gone[0][3] is None and "FileNotFoundError" in gone[0][4]
    with pytest.raises(FileNotFoundError):
        files.listed([str(tree / "nowhere")], "*")
    assert spark.read.format("vellum_documents").option("paths", json.dumps([str(tree)])).option("pattern", "*.none").load().count() == 0


def test_files_as_a_stream(spark, tmp_path):
    """Files that come later, one with an old time; a restart goes on where it was."""
    spark.dataSource.register(files.Documents)
    folder = tmp_path / "in"
    folder.mkdir()

    def run(name, when=None):
        (folder / name).write_text(name)
        if when:
            os.utime(folder / name, (when, when))
        df = spark.readStream.format("vellum_documents").option("paths", json.dumps([str(folder)])).option("log", str(tmp_path / "log")).load()
        query = df.select("path", "doc_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(60) and query.exception() is None
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run("a") == ["a"]
    assert run("b", when=1_000_000) == ["a", "b"]


def test_versions_are_whole_or_absent(spark, tmp_path):
    """A job that fails leaves nothing to see, and nothing at all once it is aborted; one that ends shows each version whole."""
    spark.dataSource.register(files.Folders)
    root = tmp_path / "out"
    rows = spark.createDataFrame([(d, 1, f, f"{d}{f}") for d in ("x", "y") for f in ("a.md", "b.md", "assets/c.txt")], "doc_id string, version int, file_name string, content string").repartition(3)
    bad = rows.withColumn("content", F.when(F.col("file_name") == "b.md", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("vellum_folders").mode("append").save(str(root))
    assert not [p for p in root.rglob("*") if p.is_file()] if root.exists() else True
    rows.write.format("vellum_folders").mode("append").save(str(root))
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()) == [f"{d}/v1/{f}" for d in ("x", "y") for f in ("a.md", "assets/c.txt", "b.md")]
    rows.where("doc_id = 'x' AND file_name = 'a.md'").write.format("vellum_folders").mode("append").save(str(root))
    assert [p.name for p in (root / "x" / "v1").iterdir()] == ["a.md"] and (root / "y" / "v1" / "b.md").read_text() == "yb.md"


def test_audits_of_a_written_folder(spark, tmp_path):
    """A conversion is written, an older version and one without provenance beside it; the audits see the newest whole one."""
    spark.dataSource.register(files.Folders)
    root = str(tmp_path / "out")
    rows = [("d1", 0, "h", "heading", "Title", 1, None), ("d1", 1, "p", "paragraph", "a di ff erent start", 1, None), ("d1", 2, "e", "equation", r"\frac{a}{b}", 1, 0.95), ("d2", 0, "p", "paragraph", "①②③④⑤⑥⑦", 1, None)]
    blocks = spark.createDataFrame(rows, "doc_id string, seq int, block_id string, type string, text string, page int, confidence double")
    docs = spark.createDataFrame([("d1", "One", 1, "in/one.pdf"), ("d2", "Two", 1, "in/two.pdf")], "doc_id string, title string, page_count int, file_name string")
    result = convert.convert(blocks, docs, scratch=Scratch(spark, "t"))
    now = datetime(2024, 1, 1)
    both = spark.createDataFrame([("d1", 2), ("d2", 1)], "doc_id string, version int")
    folders.rows(result, both, "1", now, now + timedelta(seconds=2.5)).write.format("vellum_folders").mode("append").save(root)
    old = spark.createDataFrame([("d1", 1, folders.PROVENANCE, "{}"), ("d1", 1, "document.md", "old"), ("d1", 3, "document.md", "no provenance")], "doc_id string, version int, file_name string, content string")
    old.write.format("vellum_folders").mode("append").save(root)
    assert {(r.doc_id, r.version) for r in folders.newest(spark, root).collect()} == {("d1", 2), ("d2", 1)}
    said = {r.source: r for r in folders.signals(spark, root).collect()}
    assert (said["one.pdf"].blocks, said["one.pdf"].eq_total, said["one.pdf"].ligature_residual, said["one.pdf"].illegible, said["one.pdf"].lossless) == (3, 1, 1, 0, True)
    assert said["two.pdf"].illegible == 1
    labels = spark.createDataFrame([("one.pdf", ["start"], 0.5), ("two.pdf", ["gone"], 0.5), ("three.pdf", ["x"], None)], "source string, must_contain array<string>, min_legibility double")
    labels = labels.withColumns({"must_not_contain": F.lit(None).cast("array<string>"), "confidence": F.lit(None).cast("string"), "min_ocr_pages": F.lit(None).cast("int")})
    assert sorted((r.source, r.passed is None or r.passed) for r in folders.facts(spark, root, labels).collect()) == [("one.pdf", True), ("one.pdf", True), ("three.pdf", True), ("two.pdf", False), ("two.pdf", False)]
    scored = folders.similarity(spark, root, spark.createDataFrame([("one.pdf", "e", r"\frac{a}{b}"), ("one.pdf", "gone", "x")], "source string, block_id string, latex string"))
    assert {r.block_id: r.engine_ratio for r in scored.collect()} == {"e": 1.0, "gone": None}
    totals = audit.similarity_totals(scored).first()
    assert (totals.engine_mean, totals.n, totals.missing) == (1.0, 1, 1)
    folders.baseline(spark, root).write.json(str(tmp_path / "baseline"))
    was = spark.read.json(str(tmp_path / "baseline"))
    assert audit.compare(folders.baseline(spark, root), was).count() == 0
    assert {r.key for r in audit.compare(folders.baseline(spark, root), was.withColumn("illegible", F.lit(0))).collect()} == {"illegible"}
    assert crops.tally(spark.createDataFrame([("a",), (None,)], "said string")).first() == (2, 1)
