"""Toxicity by compression distance: windows of a text are compressed with two zstandard dictionaries.

Both are trained by zstandard's trainer. The ordinary one learns windows of ordinary text. The toxic one has the same
content, so that whatever both kinds of text say costs the same, and behind it a dictionary trained on windows of
toxic text, weighted by label: runs of RUN bytes are counted by label in different contexts, and a window, one word
with its spaces, counts as often as it occurs if it holds a run that is typical of toxic text. Where the toxic
dictionary makes a window shorter, the window is like toxic text. How many windows are shorter by how many bytes goes
through a logistic calibration, fitted on texts whose half of the sample the dictionary hadn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import map_arrow, record, texts_of
from vellum.llm.words import mixed

#: The classifier is fitted on at most so many labelled texts of each label, those of the lowest hash, on none of more
#: than FIT_CHARS characters, and on FIT_BYTES of each label.
FIT_TOXIC, FIT_ORDINARY, FIT_CHARS, FIT_BYTES = 1500, 3000, 16_000, 8 << 20
#: Bytes of a scored window and from one to the next; of a run, and in how many contexts it must stand in toxic text, how
#: often as in ordinary text, and with what G-squared.
WINDOW, STEP, RUN, CONTEXTS, RATIO, TYPICAL = 128, 112, 6, 3, 50.0, 60.0
#: Bytes of the dictionaries and of the ordinary windows, and the trainer's segment and run for the toxic windows.
ORDINARY_BYTES, TOXIC_BYTES, TRAINED_WINDOW, SEGMENT, LONGEST_WORD = 32_768, 16_384, 256, 16, 40
#: How zstandard searches: lazily, for matches of so many bytes, 2**SEARCH candidates each.
STRATEGY, MIN_MATCH, SEARCH = zstandard.STRATEGY_LAZY2, 6, 6
#: Differences in bytes from which windows are counted, and the score from which a document is toxic.
STEPS, THRESHOLD = (1, 2, 3, 4, 5, 6, 8), 0.7


def held_out() -> Column:
    """Rows whose labels the classifier must not learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """A logistic regression of the labels on the features, by Newton's steps with a ridge of 1 on all but the constant."""
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.spread]
        w, ridge = np.zeros(z.shape[1]), np.r_[1e-6, np.ones(z.shape[1] - 1)]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w


#: Zero bytes part texts: no run crosses them, as no text may hold a run with one.
PART = b"\0" * 16
#: Places that are looked up at a time.
CHUNK = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[list(b"\0\t\n\r ")] = True


def run_keys(raw: bytes) -> np.ndarray:
    """The RUN bytes from each place on as one number."""
    b = np.frombuffer(raw, np.uint8)
    keys = np.zeros(max(0, len(b) - RUN + 1), np.uint64)
    for k in range(RUN):
        keys <<= np.uint64(8)
        keys |= b[k : k + len(keys)]
    return keys


def contexts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs and behind how many different runs each stands. A passage that is copied often counts once."""
    keys = run_keys(raw)
    found, part = [], np.zeros(len(keys), np.uint8)
    for k in range(0, len(keys), CHUNK):
        part[k : k + CHUNK] = keys[k : k + CHUNK] % np.uint64(251) % np.uint64(16)
    for k in range(16):  # a sixteenth of the runs at a time
        at = np.flatnonzero(part == k)
        own, before = keys[at], np.where(at >= RUN, keys[at - RUN], 0).astype(np.uint64)
        first = np.unique(mixed(mixed(own) + before), return_index=True)[1]
        found.append(np.unique(own[first], return_counts=True))
    runs, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(runs)
    return runs[order], counts[order]


def typical_runs(toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Runs that toxic text has in many contexts and ordinary text hardly ever, by G-squared and ratio."""
    (runs, t), (others, o) = contexts(toxic), contexts(ordinary)
    total_t, total_o = max(int(t.sum()), 1), max(int(o.sum()), 1)
    at = np.minimum(np.searchsorted(others, runs), max(len(others) - 1, 0))
    o = np.where(others[at] == runs, o[at], 0) if len(others) else np.zeros(len(runs))
    share, n = total_t / (total_t + total_o), t + o
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (t * np.log(t / (n * share)) + np.where(o > 0, o * np.log(o / (n * (1 - share))), 0))
    return runs[(t >= CONTEXTS) & (t * total_o > RATIO * o * total_t) & (g >= TYPICAL)]


def toxic_windows(raw: bytes, typical: np.ndarray) -> list[bytes]:
    """Each occurrence of a word in which a typical run has its middle.

    The word stands twice in its window, as the trainer doesn't look at the last bytes of a sample.
    """
    b = np.frombuffer(raw, np.uint8)
    gaps = np.flatnonzero(SPACES[b])
    keys, hits = run_keys(raw), []
    for k in range(0, len(keys) if len(typical) else 0, CHUNK):
        some = keys[k : k + CHUNK]
        hits.append(k + np.flatnonzero(typical[np.minimum(np.searchsorted(typical, some), len(typical) - 1)] == some))
    middle = np.concatenate([np.zeros(0, np.int64), *hits]) + RUN // 2
    ends = np.unique(np.searchsorted(gaps, middle[~SPACES[b[middle]]]))
    words = [raw[gaps[k - 1] + 1 : gaps[k]] for k in ends.tolist() if gaps[k] - gaps[k - 1] <= LONGEST_WORD]
    return [b" %b %b " % (w, w) for w in words]


def dictionary(samples: list[bytes], size: int, **how: int) -> bytes:
    """What the trainer makes of the samples; of too few, which it refuses, they are given often enough."""
    total = sum(map(len, samples))
    if not total:
        return b""
    size = max(256, min(size, 4 * total))
    return zstandard.train_dictionary(size, samples * max(1, -(-2 * size // total)), **how).as_bytes()


def learn(toxic: list[bytes], ordinary: list[bytes], base: bytes) -> Model:
    """The dictionaries, without a calibration."""
    raw, other = (PART + PART.join(x) + PART for x in (toxic, ordinary))
    special = dictionary(toxic_windows(raw, typical_runs(raw, other)), TOXIC_BYTES, k=SEGMENT, d=RUN, steps=1)
    # the filler keeps the ordinary content equally far from the window, so that its matches cost the same
    return Model(base + b"\x01" * len(special), base + special)


def train(toxic: list[str], ordinary: list[str]) -> Model | None:
    """None if either label has fewer than two texts, or all of a label's together are too short to train on."""
    toxic, ordinary = [t.lower() for t in toxic if t], [t.lower() for t in ordinary if t]
    if min(len(toxic), len(ordinary)) < 2:
        return None
    raw = [[t.encode().replace(b"\0", b" ") for t in texts] for texts in (toxic, ordinary)]
    windows = [b[k : k + TRAINED_WINDOW] for b in raw[1] for k in range(0, len(b), TRAINED_WINDOW)]
    try:
        base = dictionary(windows, ORDINARY_BYTES)
        x, y = [], []
        for half in (0, 1):
            scorer = Scorer(learn(raw[0][half::2], raw[1][half::2], base))
            for texts, label in ((toxic, 1.0), (ordinary, 0.0)):
                unseen = texts[1 - half :: 2]
                x += [scorer.measure(part) for part in parts(unseen)]
                y.append(np.full(len(unseen), label))
        model = learn(*raw, base)
    except zstandard.ZstdError:
        return None
    model.calibrate(np.concatenate(x), np.concatenate(y))
    return model


def parts(texts: list[str], most: int = 2 << 20) -> Iterator[list[str]]:
    """Runs of texts of about so many characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.by_ordinary, self.by_toxic = self._compressor(model.ordinary), self._compressor(model.toxic)

    @staticmethod
    def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters(strategy=STRATEGY, min_match=MIN_MATCH, window_log=17, hash_log=16, chain_log=17, search_log=SEARCH, target_length=0, write_content_size=0)
        shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=shared, compression_params=how)

    def measure(self, texts: list[str]) -> np.ndarray:
        """Features of the texts in lower case; an empty text has one empty window."""
        raw = [t.encode() for t in texts]
        size = np.array([len(b) for b in raw], np.int64)
        n = np.maximum(1, -(-(size - (WINDOW - STEP)) // STEP))
        owner = np.repeat(np.arange(len(raw)), n)
        at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STEP
        # a segment must have a byte: an empty text's window is the space behind it or the next text's first byte
        segments = np.stack([at + (np.cumsum(size) - size)[owner], np.maximum(1, np.minimum(WINDOW, size[owner] - at))], 1)
        windows = zstandard.BufferWithSegments(b"".join(raw) + b" ", segments.astype(np.uint64).tobytes())
        longer, shorter = (np.array([len(x) for x in c.multi_compress_to_buffer(windows, threads=1)], np.int64) for c in (self.by_ordinary, self.by_toxic))
        gain = np.where(size[owner] > 0, longer - shorter, 0).astype(float)
        counts = np.stack([np.bincount(owner, gain >= s, len(raw)) for s in STEPS], 1)
        most = np.maximum.reduceat(gain, np.cumsum(n) - n)
        return np.c_[np.log1p(counts), counts / n[:, None], np.bincount(owner, gain, len(raw)) / n, most, np.log(n)]

    def score(self, texts: list[str]) -> np.ndarray:
        m = self.model
        x = np.c_[np.ones(len(texts)), (self.measure([t.lower() for t in texts]) - m.mean) / m.spread]
        return 1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learns labels.toxic from the bounded sample of labelled docs (doc_id, text) that isn't held out.

    Labels that are null don't count; where a doc_id has several, the highest does. The driver gets the sample alone.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.select(F.col("doc_id").alias("id"), F.length("text").alias("n")).where(F.col("n").between(1, FIT_CHARS)).select("id")
    known = known.join(usable, known["doc_id"] == usable["id"], "left_semi").withColumn("h", F.xxhash64("doc_id"))
    chosen = known.where("toxic = 1").orderBy("h", "doc_id").limit(FIT_TOXIC).unionByName(known.where("toxic = 0").orderBy("h", "doc_id").limit(FIT_ORDINARY))
    chosen = [(r.doc_id, r.toxic) for r in chosen.collect()]
    if not chosen:
        return None
    small = docs.sparkSession.createDataFrame(chosen, "id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(small), F.col("doc_id") == F.col("id")).where(F.length("text").between(1, FIT_CHARS)).dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect()
    place = {i: k for k, (i, _) in enumerate(chosen)}
    rows.sort(key=lambda r: place[r.doc_id])
    return train(*([t for t in within(r.text for r in rows if r.toxic == label)] for label in (1, 0)))


def within(texts: Iterator[str], most: int = FIT_BYTES) -> Iterator[str]:
    """The first texts, up to so many bytes."""
    for t in texts:
        most -= len(t.encode())
        if most < 0:
            return
        yield t


def with_score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 from THRESHOLD on), all other columns as they are.

    Columns of these names that docs has are replaced. Null and empty texts are scored as one empty window; without a
    model (too few labelled texts of either kind) every score is 0. Null ids and repeated rows are kept; an empty table
    stays empty.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    if model is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        scorer = Scorer(model)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = scorer.score(texts_of(batch))
            return record(schema, **dict(zip(names, batch.columns, strict=True)), score=pa.array(score), predicted=pa.array((score >= THRESHOLD).astype(np.int32)))

        return f

    return map_arrow(docs, make, schema)
