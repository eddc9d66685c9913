"""Versions of a document's output: only complete ones count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def identity(files: DataFrame) -> DataFrame:
    """binaryFile rows to (path, doc_id, folder): the content's SHA-256, and its first 16 digits."""
    return files.select("path", F.sha2("content", 256).alias("doc_id")).withColumn("folder", F.substring("doc_id", 1, 16))


def latest(versions: DataFrame) -> DataFrame:
    """(doc_id, latest, next_version) of versions (doc_id, version, complete); latest is null where none is complete."""
    newest = F.max(F.when(F.col("complete"), F.col("version")))
    return versions.groupBy("doc_id").agg(newest.alias("latest"), (F.coalesce(newest, F.lit(0)) + 1).alias("next_version"))


def newest_rows(versions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The row of the newest complete version of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col("version").desc())
    return versions.where("complete").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def pruned(versions: DataFrame, keep: int = 1, incomplete: bool = True) -> DataFrame:
    """The versions to remove: complete ones but the newest `keep`, and, unless told otherwise, incomplete ones.

    Complete versions are ranked among themselves, so that a crashed run never pushes out the last good output.
    """
    order = Window.partitionBy("doc_id", "complete").orderBy(F.col("version").desc())
    old = F.col("complete") & (F.row_number().over(order) > keep)
    return versions.withColumn("_old", old | (~F.col("complete") & F.lit(incomplete))).where("_old").drop("_old")


def to_convert(files: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Files (doc_id, ...) that have no complete version yet; all of them by force."""
    return files if force else files.join(done.where("complete").select("doc_id").distinct(), "doc_id", "left_anti")
