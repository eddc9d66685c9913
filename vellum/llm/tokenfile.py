"""Token files: each document's ids as a zstandard frame of its own, with a dictionary that all of them share.

Layout of a folder: `dictionary-<sha256>.zdict`, `part-<n>.tok` in the order of doc_id, and `manifest.json`
(dictionary hash, width of an id, and for each part its documents, ids, first and last doc_id).
Layout of a part: the frames one after the other; the index as three little-endian arrays (doc_id int64,
frame offset uint64, ids so far uint64, the last two with an end value more); a JSON header with counts and the
dictionary's hash; the header's length as uint32; the magic `VTOK`. A reader needs the tail, the index and one
frame for a document.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.bpe import ByteBpe, Encoder, ranges, vocabulary_path, white_space
from vellum.llm.common import map_arrow, record, texts_of

MAGIC = b"VTOK"
END_ID = 2
#: The dictionary is fitted on at most so many distinct whole texts, those of the lowest hash among texts of up to so many characters.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 16_384, 112_640
LEVEL = 3
#: Words that the library gets at a time.
RUN = 4096
#: Rows of a part, about.
ROWS_PER_PART = 200_000


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class LibraryWords:
    """Ids of words as the tokenizers library encodes them.

    Words that begin with one space are encoded in runs, as the library begins a word there too; the tokens' lengths in
    bytes tell which ids are whose. Others are encoded one by one.
    """

    def __init__(self, path: str, bpe: ByteBpe):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bpe = Tokenizer.from_file(path), bpe
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts
        white = white_space(raw)[0]
        joins = (size > 1) & (raw[starts] == 0x20) & ~white[np.minimum(starts + 1, len(raw) - 1)]
        run, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        groups = np.split(run, np.arange(RUN, len(run), RUN)) if len(run) else []
        said = self._encode([raw[ranges(starts[g], size[g])].tobytes() for g in groups] + [raw[starts[k] : ends[k]].tobytes() for k in alone.tolist()])
        ids = np.array([i for x in said for i in x], np.int64)
        order = np.r_[run, alone]
        stops = np.cumsum(self.bpe.token_len[ids])
        last = np.searchsorted(stops, np.cumsum(size[order]), "right")
        counts = np.diff(np.r_[0, last])
        if not (counts > 0).all() or (stops[last - 1] != np.cumsum(size[order])).any():
            raise ValueError("the library's tokens don't end where the words do")
        length = np.zeros(len(size), np.int64)
        length[order] = counts
        at = np.zeros(len(size), np.int64)
        at[order] = last - counts
        return ids[ranges(at, length)], length


@functools.cache
def library_encoder(path: str) -> Encoder:
    """The encoder that all tasks of a Python worker share."""
    bpe = ByteBpe(path)
    return Encoder(bpe, LibraryWords(path, bpe))


def width_of(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, n_docs: int, path: str) -> bytes:
    """A zstandard dictionary over the serialized ids of a bounded, hash-chosen sample; empty if that is too small.

    One scan: the texts whose hash lies in the lowest share of all hashes, a share that about 2 * SAMPLE_DOCS rows have,
    without copies, and of them the SAMPLE_DOCS lowest.
    """
    share = min((1 << 64) - 1, (1 << 64) * 2 * SAMPLE_DOCS // max(n_docs, 1))
    hashed = docs.select("text", F.xxhash64("text").alias("h")).where(F.length("text").between(1, SAMPLE_CHARS))
    low = hashed.where(F.col("h") <= F.lit(share - (1 << 63)))
    texts = [r[0] for r in low.dropDuplicates(["h"]).orderBy("h").limit(SAMPLE_DOCS).select("text").collect()]
    encoder = library_encoder(path)
    kind = width_of(encoder.bpe.size)
    parts = []
    for at in range(0, len(texts), 100):
        ids, counts = encoder.encode(texts[at : at + 100])
        parts += [x.astype(kind).tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples
        return b""


def compressor(raw: bytes) -> zstandard.ZstdCompressor:
    if not raw:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    shared = zstandard.ZstdCompressionDict(raw)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=shared, write_content_size=True)


def decompressor(raw: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()


FRAME = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("ids", T.LongType())]
    + [T.StructField("frame", T.BinaryType())]
)
PART = T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("docs", "ids", "first", "last")]])
#: In the index for a null doc_id, which sorts first.
NULL_ID = -(1 << 63)


def first_ids(docs: DataFrame, n_docs: int) -> list[int]:
    """The least doc_id of each part, in order: parts of about ROWS_PER_PART rows, cut by Spark's sample of the ids alone."""
    wanted = max(1, -(-n_docs // ROWS_PER_PART), min(n_docs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = docs.select("doc_id").repartitionByRange(wanted, F.col("doc_id").asc_nulls_first())
    least = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first")).collect()
    return sorted(r.first for r in least if r.first is not None)


def write(docs: DataFrame, uri: str, path: str | None = None) -> dict:
    """Encodes docs (doc_id, text) into token files below `uri`, in ascending doc_id order; returns the manifest.

    Each document gets END_ID behind its ids. Null and empty texts give just that id; a null doc_id sorts first;
    rows of equal doc_id lie side by side in one part, in the order of their texts' hashes; further columns are ignored;
    an empty table gives a manifest without parts. Texts are encoded and compressed where they are read, and only
    frames are moved. A part is written under another name and then moved, so a task that is tried again leaves one
    whole part.
    """
    path = path or vocabulary_path()
    store, root = open_fs(uri)
    store.create_dir(root, recursive=True)
    docs = docs.select("doc_id", "text")
    n_docs = docs.count()
    raw = train_dictionary(docs, n_docs, path)
    digest = hashlib.sha256(raw).hexdigest()
    with store.open_output_stream(f"{root}/dictionary-{digest}.zdict") as out:
        out.write(raw)
    firsts = np.array(first_ids(docs, n_docs), np.int64)
    kind = width_of(library_encoder(path).bpe.size)

    def dictionary() -> bytes:
        store, root = open_fs(uri)
        with store.open_input_stream(f"{root}/dictionary-{digest}.zdict") as f:
            return f.read()

    def compress():
        squeeze, encoder, end = compressor(dictionary()).compress, library_encoder(path), np.array([END_ID], kind).tobytes()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts = encoder.encode(texts_of(batch))
            packed, ends = memoryview(ids.astype(kind)).cast("B"), np.cumsum(counts) * np.dtype(kind).itemsize
            frames = [squeeze(bytes(packed[a:b]) + end) for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
            doc_id = batch.column("doc_id")
            named = doc_id.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            part = np.maximum(0, np.searchsorted(firsts, named, "right") - 1)
            return record(FRAME, part=pa.array(part), doc_id=doc_id, tie=batch.column("tie"), ids=pa.array(counts + 1), frame=pa.array(frames, pa.binary()))

        return f

    def write_part(rows: Iterator[pa.RecordBatch], part: int) -> pa.RecordBatch:
        store, root = open_fs(uri)
        name = f"{root}/part-{part:06d}.tok"
        names, sizes, counts, at = [], [], [], 0
        with store.open_output_stream(started := f"{name}.{TaskContext.get().taskAttemptId()}") as out:
            for batch in rows:
                frames = batch.column("frame")
                sizes.append(pc.binary_length(frames).to_numpy(zero_copy_only=False).astype(np.int64))
                names.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                counts.append(batch.column("ids").to_numpy(zero_copy_only=False))
                for frame in frames:
                    out.write(frame.as_buffer())
            names = np.concatenate(names)
            offsets, so_far = (np.r_[0, np.cumsum(np.concatenate(x))] for x in (sizes, counts))
            at, total = int(offsets[-1]), int(so_far[-1])
            header = json.dumps({"docs": len(names), "ids": total, "dictionary": digest, "kind": kind, "index": at}).encode()
            out.write(names.astype("<i8").tobytes() + offsets.astype("<u8").tobytes() + so_far.astype("<u8").tobytes())
            out.write(header + np.array([len(header)], "<u4").tobytes() + MAGIC)
        store.move(started, name)
        return record(PART, part=[part], docs=[len(names)], ids=[total], first=[int(names[0])], last=[int(names[-1])])

    def write_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def split() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                part = batch.column("part").to_numpy()
                edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
                for a, b in itertools.pairwise(edges.tolist()):
                    if b > a:
                        yield int(part[a]), batch.slice(a, b - a)

        for part, rows in itertools.groupby(split(), key=lambda x: x[0]):
            yield write_part((b for _, b in rows), part)

    frames = map_arrow(docs.withColumn("tie", F.xxhash64("text")), compress, FRAME)
    dealt = frames.repartitionById(max(1, len(firsts)), "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie")
    # one small row for each part
    parts = sorted((r.asDict() for r in dealt.mapInArrow(write_parts, PART).collect()), key=lambda p: p["part"])
    start = 0
    for p in parts:
        p["start"], start = start, start + p["ids"]
    manifest = {"dictionary": digest, "parts": parts, "ids": start, "docs": sum(p["docs"] for p in parts)}
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class Part:
    """One part opened for reading; `raw` is the shared dictionary, whose hash is held against the part's."""

    def __init__(self, file, raw: bytes):
        self.file = file
        size = file.size()
        tail = file.read_at(min(size, 1024), max(0, size - 1024))
        if tail[-4:] != MAGIC:
            raise ValueError("not a token file")
        length = int(np.frombuffer(tail[-8:-4], "<u4")[0])
        self.header = json.loads(tail[-8 - length : -8])
        if self.header["dictionary"] != hashlib.sha256(raw).hexdigest():
            raise ValueError("written with another dictionary")
        n, at = self.header["docs"], self.header["index"]
        index = file.read_at(24 * n + 16, at)
        self.doc_id = np.frombuffer(index, "<i8", n)
        self.offset = np.frombuffer(index, "<u8", n + 1, 8 * n).astype(np.int64)
        self.so_far = np.frombuffer(index, "<u8", n + 1, 16 * n + 8).astype(np.int64)
        self.inflate = decompressor(raw).decompress

    def frames(self, most: int = 8 << 20) -> Iterator[tuple[int, bytes]]:
        """(row, serialized ids) of every document, read in runs of about `most` bytes."""
        a = 0
        while a < len(self.doc_id):
            b = max(a + 1, int(np.searchsorted(self.offset, self.offset[a] + most, "right")) - 1)
            block = self.file.read_at(int(self.offset[b] - self.offset[a]), int(self.offset[a]))
            for k in range(a, b):
                yield k, self.inflate(block[self.offset[k] - self.offset[a] : self.offset[k + 1] - self.offset[a]])
            a = b

    def document(self, k: int) -> np.ndarray:
        raw = self.inflate(self.file.read_at(int(self.offset[k + 1] - self.offset[k]), int(self.offset[k])))
        return np.frombuffer(raw, self.header["kind"])


def open_part(uri: str, part: int, dictionary: str) -> Part:
    store, root = open_fs(uri)
    with store.open_input_stream(f"{root}/dictionary-{dictionary}.zdict") as f:
        raw = f.read()
    return Part(store.open_input_file(f"{root}/part-{part:06d}.tok"), raw)


def read_document(uri: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the rows with this doc_id: the manifest, the index of a part or two and those frames are read."""
    store, root = open_fs(uri)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    out = []
    for p in manifest["parts"]:
        if p["first"] <= doc_id <= p["last"]:
            part = open_part(uri, p["part"], manifest["dictionary"])
            low, high = np.searchsorted(part.doc_id, [doc_id, doc_id + 1])
            out += [part.document(k) for k in range(low, high)]
    return out


READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
IDS = T.StructType([*READ.fields[:2], T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _scan(spark: SparkSession, uri: str, manifest: dict, schema: T.StructType, row) -> DataFrame:
    digest, parts = manifest["dictionary"], [(p["part"], p["start"]) for p in manifest["parts"]]
    table = spark.createDataFrame(parts, "part int, start long").repartition(max(1, len(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), strict=True):
                opened = open_part(uri, part, digest)
                width, rows = np.dtype(opened.header["kind"]).itemsize, []

                def out(rows):
                    return record(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

                for k, raw in opened.frames():
                    name = int(opened.doc_id[k])
                    rows.append((None if name == NULL_ID else name, start + int(opened.so_far[k]), *row(raw, opened.header["kind"], width)))
                    if len(rows) >= 4096:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return table.mapInArrow(run, schema)


def read_checks(spark: SparkSession, uri: str, manifest: dict) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return _scan(spark, uri, manifest, READ, lambda raw, kind, width: (len(raw) // width, zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes())))


def read_ids(spark: SparkSession, uri: str, manifest: dict) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files."""
    return _scan(spark, uri, manifest, IDS, lambda raw, kind, width: (np.frombuffer(raw, kind).tolist(),))
