"""The engine seam: a callable from a file's bytes to items runs partition-wise, its handle made once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])
ITEM = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("item_id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType())]
    + [T.StructField("prov", T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("bbox", BOX)]))), T.StructField("error", T.StringType())]
)


def convert(files: DataFrame, make: Callable[[], Callable[[bytes], Iterable[dict]]]) -> DataFrame:
    """Items of each file (path, content); a file that the engine fails on gives one row with `error`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [{"path": path, "seq": k, **item} for k, item in enumerate(engine(bytes(content)))]
                except Exception as e:  # one bad file must not end the run: its row says what failed
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame([{n: r.get(n) for n in ITEM.names} for r in rows], columns=ITEM.names, dtype=object)

    return files.select("path", "content").mapInPandas(run, ITEM)


ENGINES: dict[str, Callable[[], Callable[[bytes], Iterable[dict]]]] = {}


def engine(name: str) -> Callable[[], Callable[[bytes], Iterable[dict]]]:
    """A registered engine's factory; KeyError names the known ones."""
    if name not in ENGINES:
        raise KeyError(f"no engine {name}; known: {', '.join(sorted(ENGINES)) or 'none'}")
    return ENGINES[name]


def text_engine() -> Callable[[bytes], Iterable[dict]]:
    """Plain text, a paragraph each block."""

    def run(content: bytes) -> Iterable[dict]:
        for k, part in enumerate(content.decode("utf-8", "replace").split("\n\n")):
            yield {"item_id": f"#/texts/{k}", "label": "text", "text": part, "prov": [{"page": 1, "bbox": None}]}

    return run


ENGINES["text"] = text_engine
