"""What several operators share: joins with small tables, Arrow helpers; scratch tables are the library's."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.sources.shared import Scratch, shared_dir  # noqa: F401

#: A word is a run of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of at most so many rows and bytes are broadcast; larger ones are joined by shuffle, each key over SALTS partitions.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 1_000_000, 32 << 20, 16

#: Text that a Python worker handles at a time.
SLICE_BYTES = 2 << 20


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with as many underscores behind it as make it none of the frames' columns."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fits(df: DataFrame) -> bool:
    """Whether a table may be broadcast: BROADCAST_ROWS rows and BROADCAST_BYTES at most; an element of an array counts 16 bytes."""

    def size_of(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(f"`{f.name}`")
        return F.size(f"`{f.name}`") * 16 if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.lit(16)

    rows, size = df.agg(F.count("*"), F.sum(sum((F.coalesce(size_of(f), F.lit(0)) for f in df.schema.fields), F.lit(0)))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def small_join(left: DataFrame, small: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join with a table that has one row for each key and is usually small; how: left, inner, left_semi or left_anti.

    Broadcast where its rows and bytes are few (counted first); beyond, a shuffle join in which each key is spread over
    SALTS partitions, so that a key with a third of all rows doesn't land in one task. Null keys match null keys.
    Columns of `left` come first, whatever their names; the others must have names of their own.
    """
    keys = [on] if isinstance(on, str) else on
    names = {k: fresh(f"_{k}", left, small) for k in keys}
    right = small.withColumnsRenamed(names)
    hit = [left[f"`{k}`"].eqNullSafe(right[f"`{n}`"]) for k, n in names.items()]
    if fits(small):
        return left.join(F.broadcast(right), functools.reduce(operator.and_, hit), how).drop(*names.values())
    salt, at = fresh("_salt", left, right), fresh("_at", left, right)
    others = [f"`{f.name}`" for f in left.schema.fields if f.name not in keys and not isinstance(f.dataType, T.MapType)]
    spread = left.withColumn(at, F.pmod(F.xxhash64(*(others or [f"`{k}`" for k in keys])), F.lit(SALTS)).cast("int"))
    salted = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = [spread[f"`{k}`"].eqNullSafe(salted[f"`{n}`"]) for k, n in names.items()]
    return spread.join(salted, functools.reduce(operator.and_, [*hit, spread[at] == salted[salt]]), how).drop(*names.values(), salt, at)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow with a function that `make` builds once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for part in slices(b):
                yield f(part)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of the text column, whole rows each."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    if column not in batch.schema.names:
        yield batch
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of the column; null counts as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def record(schema: T.StructType, **columns) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in kind], schema=kind)
