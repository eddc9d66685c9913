"""Outputs: markdown and JSON files one to a row, provenance as the mark of completeness, and reading them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.versions import newest_rows


def write(files: DataFrame, provenance: DataFrame, root: str) -> None:
    """files (doc_id, version, file_name, content) first, then provenance (doc_id, version, ...), which names the attempt.

    What has no provenance isn't complete: files of an attempt that died are never read, also where a later attempt
    writes the same version.
    """
    attempt = F.lit(f"a{uuid.uuid4().hex}")  # a letter first, so that the folder's name is read as text
    files.withColumn("attempt", attempt).write.mode("append").partitionBy("version", "attempt").parquet(f"{root}/files")
    provenance.withColumn("attempt", attempt).write.mode("append").partitionBy("version").json(f"{root}/provenance")


def provenance(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.json(f"{root}/provenance")


def read(spark: SparkSession, root: str) -> DataFrame:
    """The files of each document's newest complete version, of the attempt that its provenance names; of several the last by name."""
    files = spark.read.parquet(f"{root}/files")
    said = provenance(spark, root).groupBy("doc_id", "version").agg(F.max("attempt").alias("attempt"))
    done = newest_rows(said.withColumn("complete", F.lit(True))).select("doc_id", "version", "attempt")
    return files.join(done, ["doc_id", "version", "attempt"], "left_semi").drop("attempt")


def markdown(files: DataFrame) -> DataFrame:
    """(doc_id, markdown): a document's markdown files, README aside, in the order of their names."""
    own = files.where(F.col("file_name").endswith(".md") & (F.col("file_name") != "README.md"))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_name", "content"))), lambda x: x["content"]), "\n").alias("markdown"))


def export(files: DataFrame, uri: str) -> DataFrame:
    """Writes each row as a file of its own, uri/doc_id/v<version>/file_name, under another name first; returns what was written."""
    import pandas as pd
    from pyarrow import fs
    from pyspark import TaskContext

    def run(batches):
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            names = []
            for r in batch.itertuples():
                folder = f"{root}/{r.doc_id}/v{r.version}"
                store.create_dir(folder, recursive=True)
                # a name of its own for each attempt, as Spark may run two of one task at a time
                started = f"{folder}/.{r.file_name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(started) as out:
                    out.write(r.content.encode())
                store.move(started, f"{folder}/{r.file_name}")
                names.append(f"{folder}/{r.file_name}")
            yield pd.DataFrame({"path": names})

    return files.select("doc_id", "version", "file_name", "content").mapInPandas(run, "path string")
