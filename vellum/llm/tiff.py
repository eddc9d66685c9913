"""TIFF as a column: walks the image directories of a file, decodes strips and tiles, one row for each page.

Classic and BigTIFF in both byte orders; uncompressed, PackBits, LZW and deflate; predictors 2 (differences) and
3 (floating point); chunky and planar samples of 1, 2, 4, 8, 16, 32 or 64 bits. Samples come out row by row, chunky, in
little-endian; those of fewer than 8 bits take a byte each.
A page of more than PAGE_BYTES, or of more than its file's bytes could ever unpack to, is an error and never allocated.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import SLICE_BYTES, map_arrow, record, texts_of

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
# Fixed values of the format: tag numbers, and for each field type its struct letter.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339
LETTERS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}

#: How payloads are stored: rows of 64 RGB pixels, so many rows in a strip and in a page, so many pixels across and down in a tile.
PIXELS, STRIP_ROWS, PAGE_ROWS, TILE = 64, 256, 4096, (32, 16)
ROW = PIXELS * 3

#: The most bytes of samples a page may state, and the most a byte of any codec here can unpack to (an LZW code of 12 bits: under 4096).
PAGE_BYTES, BYTES_PER_BYTE = 512 << 20, 4096


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    photometric: int
    chunks: int
    data: bytes


def unpack_bits(raw: bytes, most: int | None = None) -> bytes:
    """All bytes, or what is unpacked once `most` are there."""
    out, i = bytearray(), 0
    while i < len(raw) and (most is None or len(out) < most):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 1 + (n != 128)
    return bytes(out)


#: A run worth a code of its own.
RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    for m in (*RUN.finditer(raw), None):
        begin, end = m.span() if m else (len(raw), len(raw))
        for k in range(at, begin, 128):
            part = raw[k : min(k + 128, begin)]
            out.append(len(part) - 1)
            out += part
        if m:
            out += bytes((257 - (end - begin), raw[begin]))
        at = end
    return bytes(out)


def unpack_lzw(raw: bytes, most: int | None = None) -> bytes:
    """Codes from the high bit on; a code's width grows one entry early; 256 clears, 257 ends; it stops once `most` bytes are there."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            table = [bytes((k,)) for k in range(256)] + [b"", b""]
        if code < len(table):
            said = table[code]
        elif code == len(table) and last:
            said = last + last[:1]
        else:
            raise ValueError("a code that isn't in the table")
        if last:
            table.append(last + said[:1])
        out += said
        if most is not None and len(out) >= most:
            break
        last = said
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


#: Table sizes at which codes grow by a bit.
WIDER = (512, 1024, 2048)


def pack_lzw(raw: bytes) -> bytes:
    """Strings are known by the code of what precedes their last byte, and that byte."""
    out, table, width, size, seen = bytearray(), {}, 9, 258, -1
    held, bits = 256, 9  # a clearing code comes first
    for byte in raw:
        key = seen << 8 | byte
        if seen < 0:
            seen = byte
        elif key in table:
            seen = table[key]
        else:
            held, bits = held << width | seen, bits + width
            table[key], seen = size, byte
            size += 1
            if size in WIDER:
                width += 1
            elif size == 4094:
                held, bits = held << width | 256, bits + width
                table, width, size = {}, 9, 258
            if bits >= 512:
                out += (held >> bits % 8).to_bytes(bits // 8)
                bits %= 8
                held &= (1 << bits) - 1
    if seen >= 0:
        held, bits, size = held << width | seen, bits + width, size + 1
        width += size in WIDER
    held, bits = held << width | 257, bits + width
    held, bits = held << -bits % 8, bits + -bits % 8
    return bytes(out + held.to_bytes(bits // 8))


def inflate(raw: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(raw, most) if most else b""


UNPACK = {NONE: lambda raw, most: raw, LZW: unpack_lzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda raw: zlib.compress(raw, 6), PACKBITS: pack_bits}


def directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8:
        raise ValueError("not a TIFF file")
    version = struct.unpack_from(order + "H", raw, 2)[0]
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at, seen = struct.unpack_from(order + ("Q" if big else "I"), raw, 8 if big else 4)[0], set()
    if not at:
        raise ValueError("no directory")
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + ("Q" if big else "H"), raw, at)[0]
        at += 8 if big else 2
        fields = {}
        for _ in range(n):
            tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, at)
            place, room = (at + 12, 8) if big else (at + 8, 4)
            if letter := LETTERS.get(kind):
                if struct.calcsize(order + letter) * count > room:
                    place = struct.unpack_from(order + ("Q" if big else "I"), raw, place)[0]
                fields[tag] = struct.unpack_from(f"{order}{count}{letter}", raw, place)
            at += 20 if big else 12
        yield order, fields
        at = struct.unpack_from(order + ("Q" if big else "I"), raw, at)[0]


def row_bytes(width: int, samples: int, bits: int) -> int:
    """Each row begins on a byte."""
    return -(-width * samples * bits // 8)


def undo(raw: bytes, order: str, rows: int, width: int, samples: int, bits: int, predictor: int) -> np.ndarray:
    """The samples of one strip or tile as unsigned integers, rows x width x samples."""
    if bits < 8:
        across = row_bytes(width, samples, bits)
        if len(raw) < rows * across:
            raise ValueError("a strip or tile is too short")
        packed = np.frombuffer(raw, np.uint8, rows * across).reshape(rows, across, 1)
        values = packed >> np.arange(8 - bits, -1, -bits, dtype=np.uint8) & np.uint8((1 << bits) - 1)
        return values.reshape(rows, -1)[:, : width * samples].reshape(rows, width, samples)
    kind = np.dtype(f"{order}u{bits // 8}")
    need = rows * width * samples * kind.itemsize
    if len(raw) < need:
        raise ValueError("a strip or tile is too short")
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8, need).reshape(rows, -1).copy()
        lines = planes.reshape(rows, -1, samples)
        np.cumsum(lines, axis=1, dtype=np.uint8, out=lines)
        # the bytes of a row lie by significance, the highest first
        values = planes.reshape(rows, kind.itemsize, width * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(values).view(f">u{kind.itemsize}").reshape(rows, width, samples).astype(kind.newbyteorder("<"))
    values = np.frombuffer(raw, kind, need // kind.itemsize).reshape(rows, width, samples).astype(kind.newbyteorder("<"))
    return np.cumsum(values, axis=1, dtype=values.dtype) if predictor == 2 else values


DAMAGE = (ValueError, struct.error, zlib.error, KeyError, IndexError, OverflowError, TypeError)


@dataclass
class Broken:
    page: int
    error: str


def pages(raw: bytes) -> Iterator[Page | Broken]:
    """The pages of a file under their numbers in the chain of directories.

    A page that is damaged or not decoded here is Broken, and the pages behind it follow; a broken chain ends the file,
    Broken under the number that the next page would have had.
    """
    chain, number = directories(raw), 0
    while True:
        try:
            order, fields = next(chain)
        except StopIteration:
            return
        except DAMAGE as e:
            yield Broken(number, f"damaged: {e}")
            return
        try:
            yield page_of(raw, number, order, fields)
        except DAMAGE as e:
            yield Broken(number, f"damaged: {e}")
        number += 1


#: Each byte with its bits in the other order.
MIRRORED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), axis=1, bitorder="little").tobytes()


def page_of(raw: bytes, number: int, order: str, f: dict[int, tuple]) -> Page:
    def one(tag: int, other: int | None = None) -> int:
        return f[tag][0] if other is None else f.get(tag, (other,))[0]

    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(f.get(BITS, (1,)))) > 1:
        raise ValueError(f"{bits} bits a sample")
    if predictor == 2 and bits < 8 or predictor == 3 and bits <= 8:
        raise ValueError(f"predictor {predictor} with {bits} bits a sample")
    if compression not in UNPACK or predictor not in (1, 2, 3):
        raise ValueError(f"compression {compression} with predictor {predictor}")
    planar = one(PLANAR, 1) == 2 and samples > 1
    tiled = TILE_OFFSETS in f
    across, down = (one(TILE_W), one(TILE_H)) if tiled else (width, min(one(ROWS, height), height))
    offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f[OFFSETS], f[COUNTS])
    cols, lines = -(-width // max(across, 1)), -(-height // max(down, 1))
    together = 1 if planar else samples
    chunks, line = cols * lines * (samples if planar else 1), row_bytes(across, together, bits)
    # bits that are unpacked to bytes count by what they fill here
    stated, room = max(bits, 8) // 8, BYTES_PER_BYTE * len(raw) * max(1, 8 // bits)
    if max(height * width * samples, down * across * together) * stated > min(room, PAGE_BYTES):
        raise ValueError(f"{width} x {height} x {samples} samples are too many")
    if min(len(offsets), len(counts)) < chunks:
        raise ValueError("a strip or tile is missing")
    out = np.zeros((height, width, samples), f"<u{stated}")
    for k in range(chunks):
        plane, rest = divmod(k, cols * lines)
        y, x = rest // cols * down, rest % cols * across
        rows = down if tiled else min(down, height - y)
        packed = raw[offsets[k] : offsets[k] + counts[k]]
        if one(FILL, 1) == 2:
            packed = packed.translate(MIRRORED)
        part = undo(UNPACK[compression](packed, rows * line), order, rows, across, together, bits, predictor)
        part = part[: height - y, : width - x]
        out[y : y + part.shape[0], x : x + part.shape[1], slice(plane, plane + 1) if planar else slice(None)] = part
    return Page(number, width, height, samples, bits, compression, predictor, one(PHOTOMETRIC, 1), len(offsets), out.tobytes())


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A classic TIFF file with one page for each image (rows x columns x samples, 8 or 16 bits unsigned)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width, samples = image.shape
        bits = image.dtype.itemsize * 8
        across, down = tile or (width, strip_rows)
        offsets, counts = [], []
        for y in range(0, height, down):
            for x in range(0, width, across):
                part = image[y : y + down, x : x + across]
                if tile:
                    part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                packed = PACK[compression](part.astype(part.dtype.newbyteorder(order)).tobytes())
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        fields = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [bits] * samples), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [2 if samples >= 3 else 1]), (SAMPLES, "H", [samples]), (PLANAR, "H", [1]), (PREDICTOR, "H", [predictor])]
        fields += [(TILE_W, "I", [across]), (TILE_H, "I", [down]), (TILE_OFFSETS, "I", offsets), (TILE_COUNTS, "I", counts)] if tile else [(OFFSETS, "I", offsets), (ROWS, "I", [down]), (COUNTS, "I", counts)]
        fields.sort()
        directory = struct.pack(order + "H", len(fields))
        for tag, letter, values in fields:
            said = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(said) > 4:
                place = len(out)
                out += said + b"\0" * (len(said) % 2)
                said = struct.pack(order + "I", place)
            directory += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[letter], len(values)) + said.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + len(directory)
        out += directory + b"\0\0\0\0"
    return bytes(out)


def payload_of(text: str) -> bytes:
    """The text in UTF-8 with spaces up to a positive multiple of a row."""
    raw = text.encode()
    return raw + b" " * (-len(raw) % ROW or ROW * (not raw))


def store(payload: bytes) -> bytes:
    """A file of the payload's rows. Codec, predictor, strips or tiles and byte order follow from the payload's hash."""
    rows, h = np.frombuffer(payload, np.uint8).reshape(-1, PIXELS, 3), zlib.crc32(payload)
    images = [rows[k : k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)]
    codec, predictor = (NONE, PACKBITS, LZW, DEFLATE)[h % 4], 1 + (h >> 2) % 2
    return write(images, codec, predictor, tile=TILE if h >> 3 & 1 else None, order="<>"[h >> 4 & 1])


PAGE = T.StructType(
    [T.StructField("file_id", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("page", "width", "height", "samples", "bits", "compression", "predictor", "photometric", "chunks")]]
    + [T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())]
)


def explode_pages(files: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(file_id, content) to one row for each page, with its samples in `data`; columns of `carry` come along with each page.

    A null or damaged file, or one without a directory, gives one row with page 0 and `error` set; so does a damaged page under its own number, and the
    pages behind it come too. Files of any size are held one at a time, with about SLICE_BYTES of pages or one larger page.
    The pages of a file are neighbours in one partition, in order. Repeated rows and null ids are kept, further columns
    ignored; an empty table gives an empty one.
    """
    schema = T.StructType([*PAGE.fields, *[files.schema[c] for c in carry]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            along = [batch.column(c) for c in carry]
            for i in range(batch.num_rows):
                file_id, content = batch.column("file_id")[i].as_py(), batch.column("content")[i].as_py()
                more = {c: a[i].as_py() for c, a in zip(carry, along, strict=True)}
                for p in pages(content or b""):
                    held.append({"file_id": file_id, **vars(p), **more})
                    size += len(held[-1].get("data", b""))
                    if size > SLICE_BYTES or len(held) == ROWS_HELD:
                        yield record(schema, **{n: [r.get(n) for r in held] for n in schema.names})
                        held, size = [], 0
        if held:
            yield record(schema, **{n: [r.get(n) for r in held] for n in schema.names})

    return files.select("file_id", "content", *carry).mapInArrow(run, schema)


#: The most rows of a batch that leaves a Python worker here.
ROWS_HELD = 1000
STORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("content", T.BinaryType())])


def store_documents(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text) to (doc_id, content): each text's payload as a TIFF file; columns of `carry` come along.

    Null counts as empty. Equal texts give equal files; null ids and repeated rows are kept, further columns ignored.
    """
    schema = T.StructType([*STORED.fields, *[docs.schema[c] for c in carry]])

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            files = [store(payload_of(t)) for t in texts_of(batch)]
            return record(schema, doc_id=batch.column("doc_id"), content=files, **{c: batch.column(c) for c in carry})

        return f

    return map_arrow(docs.select("doc_id", "text", *carry), make, schema)


CHECKED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
    + [T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
)


@dataclass
class Summary:
    """What is known of a file after the pages read so far."""

    head: dict
    sha: object = field(default_factory=hashlib.sha256)
    size: int = 0
    tail: bytes = b""
    pages: int = 0
    chunks: int = 0
    squares: int = 0
    sums: np.ndarray = field(default_factory=lambda: np.zeros(3, np.int64))

    def add(self, data: bytes, chunks: int) -> None:
        samples = np.frombuffer(data, np.uint8).reshape(-1, 3)
        self.sha.update(data)
        self.size, self.tail = self.size + len(data), (self.tail + data[-16:])[-16:]
        self.pages, self.chunks = self.pages + 1, self.chunks + chunks
        self.sums = self.sums + samples.sum(0, dtype=np.int64)
        self.squares += int((samples.astype(np.int64) ** 2).sum())

    def row(self) -> dict:
        """The feature: pages, strips or tiles, mean and mean square of all samples, and the mean of each channel, means in hundredths."""
        n = self.size // 3
        channels = "/".join(str(int(s) * 100 // n) for s in self.sums)
        feature = f"{self.pages}x{self.chunks}:{int(self.sums.sum()) * 100 // (3 * n)}:{self.squares // (3 * n)}:{channels}"
        return {**self.head, "payload_bytes": self.size, "payload_sha256": self.sha.hexdigest(), "tail_crc32": zlib.crc32(self.tail), "feature": feature}


def summarize(pages_of_files: DataFrame) -> DataFrame:
    """Pages as explode_pages gives them, with n_bytes, media_bytes and media_sha256 along, to a row a file.

    Reads a page at a time; a page with an error stops the job, as these files are the library's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            columns = {n: batch.column(n) for n in ("file_id", "n_bytes", "media_bytes", "media_sha256", "page", "chunks", "data", "error")}
            for i in range(batch.num_rows):
                r = {n: c[i].as_py() for n, c in columns.items()}
                if r["error"] is not None:
                    raise ValueError(f"document {r['file_id']}, page {r['page']}: {r['error']}")
                if r["page"] == 0:
                    if now:
                        done.append(now.row())
                    now = Summary({"doc_id": r["file_id"], **{n: r[n] for n in ("n_bytes", "media_bytes", "media_sha256")}})
                now.add(r["data"], r["chunks"])
            if len(done) >= ROWS_HELD:
                yield record(CHECKED, **{n: [d[n] for d in done] for n in CHECKED.names})
                done = []
        if now:
            done.append(now.row())
        yield record(CHECKED, **{n: [d[n] for d in done] for n in CHECKED.names})

    return pages_of_files.mapInArrow(run, CHECKED)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores each text as a TIFF file, reads it as a row for each page, and describes file and pages; no shuffle.

    Null counts as an empty text, whose payload is one row of spaces. Equal texts give equal values; null ids and
    repeated rows are kept, further columns ignored; an empty table gives an empty one.
    """
    sized = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    files = store_documents(sized, ["n_bytes"]).select(
        F.col("doc_id").alias("file_id"),
        "content",
        "n_bytes",
        F.octet_length("content").cast("long").alias("media_bytes"),
        F.sha2("content", 256).alias("media_sha256"),
    )
    return summarize(explode_pages(files, ["n_bytes", "media_bytes", "media_sha256"]))
