"""A drop folder as a stream: files that arrive are converted once, by content, and models are asked once; state says what is known."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

FILE = "path string, modificationTime timestamp, length long, content binary"
#: How long a content or an answer is remembered, in days.
KEPT_DAYS = 365


def arrivals(spark: SparkSession, folder: str, pattern: str = "*", most: int = 1000) -> DataFrame:
    """Files as they arrive; at most so many in a batch, the rest in later ones."""
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most).load(folder)


def _keyed(df: DataFrame, key: str, f: Callable, kind: T.StructType, state: str) -> DataFrame:
    # else Spark runs batch after batch to look for keys whose time is up, and a run over what is there never ends
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return df.groupBy(key).applyInPandasWithState(f, kind, state, "append", "ProcessingTimeTimeout")


def new_contents(files: DataFrame, days: float = KEPT_DAYS) -> DataFrame:
    """(doc_id, path, content) of the files of a stream whose content hasn't come before: of equal ones the first by path.

    The state holds a flag for each content, until it hasn't come for so many days.
    """
    named = files.select(F.sha2("content", 256).alias("doc_id"), "path", "content")
    names, milliseconds = named.columns, int(days * 86_400_000)

    def first(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # a content's rows are all alike but for their paths
        least = None
        for batch in rows:
            if len(batch):
                own = batch.sort_values("path").head(1)
                least = own if least is None or own["path"].iloc[0] < least["path"].iloc[0] else least
        if not state.exists and least is not None:
            yield least[names]
        state.update((True,))
        state.setTimeoutDuration(milliseconds)

    return _keyed(named, "doc_id", first, named.schema, "known boolean")


def answers(crops: DataFrame, make: Callable[[], Callable[[bytes, str], str | None]], days: float = KEPT_DAYS) -> DataFrame:
    """A stream of crops (key, png, prompt, ...) with `said` and without png and prompt; key: as crops.cache_key gives it.

    Rows of one key are answered alike: as the state says, or as the model says, which is asked once. A failure gives null and
    isn't remembered. An answer is kept until its key hasn't come for so many days.
    """
    names, milliseconds = [c for c in crops.columns if c not in ("png", "prompt")], int(days * 86_400_000)
    kind = T.StructType([f for f in crops.schema.fields if f.name in names] + [T.StructField("said", T.StringType())])

    def answer(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        said, asked = (state.get[0] if state.exists else None), False
        for batch in rows:
            if said is None and not asked and len(batch):
                asked, one = True, batch.iloc[0]
                try:
                    said = make()(bytes(one["png"]), one["prompt"]) or None
                except Exception:  # one unreadable crop must not end the stream: its rows stay without an answer
                    said = None
            yield batch.assign(said=said)[[*names, "said"]]
        if said is not None:
            state.update((said,))
            state.setTimeoutDuration(milliseconds)

    return _keyed(crops, "key", answer, kind, "said string")


def convert_new(files: DataFrame, done: str, checkpoint: str, convert: Callable[[DataFrame], DataFrame], available_now: bool = True, days: float = KEPT_DAYS) -> StreamingQuery:
    """Writes convert(files whose content is new) to `done`, batch by batch; nothing that was written is read again.

    convert gets (doc_id, path, content). A batch that is run again after a failure has the same new files, as the state is
    the checkpoint's, and overwrites its own part of `done`, so that nothing is converted twice or lost.
    """

    def one(batch: DataFrame, number: int) -> None:
        convert(batch).write.mode("overwrite").parquet(f"{done}/batch_id={number}")

    writer = new_contents(files, days).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_windows(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in tumbling windows; on a stream, rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
