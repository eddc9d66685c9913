"""Byte-level BPE in batched numpy merge rounds, and its inverse.

The words of a batch lie in one flat array of symbols. In each round every word finds its pair of the
lowest rank, by binary search over the sorted pair keys of the merge table, and merges all occurrences of
it from left to right; words without a pair leave the array. Merging all occurrences at once equals the
one-by-one order: a pair that holds the merged symbol always has a later rank.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.llm.common import map_arrow, record, texts_of
from vellum.llm.words import range_hashes, runs

#: Fixed value of the byte-level vocabulary: how it cuts text into words (\s read as Unicode white space).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: A letter run with one of these behind it is two words; the pattern needn't be asked.
END = b".,;:!?"

#: What a worker remembers of pieces: those of up to SHORT bytes, in a table of SLOTS places (a power of 2), with POOL
#: ids; about 40 MB in all. Pieces are looked up for so many bytes at a time.
SHORT, SLOTS, POOL, BATCH_BYTES = 64, 1 << 20, 3_000_000, 1 << 19


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


class ByteBpe:
    """Vocabulary and merges of a byte-level BPE file in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        to_byte = byte_alphabet()
        vocab = said["model"]["vocab"]
        self.size = max([*vocab.values(), *(a["id"] for a in said["added_tokens"])]) + 1
        raw: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            raw[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.added = {a["content"]: a["id"] for a in said["added_tokens"]}
        for content, i in self.added.items():
            raw[i] = content.encode()
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_len = np.array([len(x) for x in raw], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.of_byte = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        self.split = regex.compile(PATTERN).findall
        # the longest first, as a longer one may begin with a shorter one
        self.cut = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(self.added, key=len, reverse=True))) if self.added else None

    def _ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the places; self.none for none, or where the word ends."""
        out = np.full(len(at), self.none, np.int32)
        inside = np.flatnonzero(at + 1 < len(symbols))
        inside = inside[word[at[inside]] == word[at[inside] + 1]]
        key = symbols[at[inside]] * self.size + symbols[at[inside] + 1]
        found = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        out[inside] = np.where(self.keys[found] == key, self.ranks[found], self.none)
        return out

    def encode_ranges(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in the ranges one after the other, and how many each has."""
        lengths = ends - starts
        symbols = self.of_byte[raw[ranges(starts, lengths)]]
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank = self._ranks(symbols, word, np.arange(len(symbols)))
        done_s, done_w = [], []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
            if (over := least == self.none).any():
                done_s.append(symbols[over])
                done_w.append(word[over])
                if over.all():
                    break
                symbols, word, rank, least = symbols[~over], word[~over], rank[~over], least[~over]
            hit = np.flatnonzero(rank == least)
            # of occurrences that overlap, every second one, from the left
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            # only the merged symbol's pairs to both sides have changed
            hit = hit - np.arange(len(hit))
            for at in (hit, hit[hit > 0] - 1):
                rank[at] = self._ranks(symbols, word, at)
        if not done_s:
            return np.zeros(0, np.int64), lengths
        of, ids = np.concatenate(done_w), np.concatenate(done_s)
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(lengths))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[ranges(self.token_at[ids], self.token_len[ids])].tobytes()


#: Fixed values of Unicode: white space beyond ASCII in UTF-8.
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER, _AFTER_C3, _END = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_AFTER_C3[[b for b in range(0x80, 0xC0) if bytes((0xC3, b)).decode().isalpha()]] = True
_END[list(END)] = True
_LEADS = np.zeros(256, bool)
_LEADS[[w[0] for w in WIDE_SPACES]] = True


def white_space(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether a white-space character begins there, and whether one ends there."""
    begins = _SPACE[raw]
    ends = begins.copy()
    leads = np.flatnonzero(_LEADS[raw])
    for w in WIDE_SPACES if len(leads) else ():
        at = leads[leads + len(w) <= len(raw)]
        for k, b in enumerate(w):
            at = at[raw[at + k] == b]
        begins[at] = ends[at + len(w) - 1] = True
    return begins, ends


def piece_ranges(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of all texts, and how many each text has; `at`: where each text begins, with the end.

    A text is cut before each space that stands between two characters other than white space. There the
    vocabulary's pattern always begins a word: no word runs on from such a character over a space, and the space
    goes with what follows it. So a piece is encoded alike alone and in the text.
    """
    begins, ends = white_space(raw)
    cut = raw == 0x20
    cut[:1] = cut[-1:] = False
    cut[1:] &= ~ends[:-1]
    cut[:-1] &= ~begins[1:]
    first = at[:-1][at[:-1] < at[1:]]
    cut[first[1:] - 1] = False  # a text's last character has nothing behind it
    cut[first] = True
    starts = np.flatnonzero(cut)
    return starts, np.r_[starts[1:], len(raw)] if len(starts) else starts, np.diff(np.searchsorted(starts, at))


class Remembered:
    """Ids of short pieces by their hash, in arrays of bounded size.

    Each hash has one place in a table of SLOTS; a later piece takes the place of an earlier one. The ids lie in a
    pool; when it holds more than POOL ids or entries, all is forgotten.
    """

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.hash, self.entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.ids, self.at, self.length = (np.zeros(1 << 12, np.int32) for _ in range(3))
        self.used = self.n = 0

    @property
    def full(self) -> bool:
        return max(self.used, self.n) > POOL

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the hashes, and which of them are known."""
        slot = (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        return self.entry[slot], self.hash[slot] == hashes

    def add(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Puts ids into the pool, `length` of them for each entry; returns the entries."""
        first, self.n = self.n, self.n + len(length)
        self.at, self.length = room(self.at, self.n), room(self.length, self.n)
        self.length[first : self.n] = length
        self.at[first : self.n] = self.used + np.cumsum(length) - length
        self.ids = room(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return np.arange(first, self.n)

    def name(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        slot = (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        self.hash[slot], self.entry[slot] = hashes, entries

    def gather(self, entries: np.ndarray) -> np.ndarray:
        return self.ids[ranges(self.at[entries].astype(np.int64), self.length[entries].astype(np.int64))]


def room(values: np.ndarray, size: int) -> np.ndarray:
    """The array, copied into a larger one if it is too small."""
    if size <= len(values):
        return values
    out = np.zeros(max(size, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


class Encoder:
    """Encodes texts; short pieces that were seen lately aren't merged again.

    merge: new words, as ranges of bytes in order, to ids, flat, and how many each has, in place of the numpy merges (a
    library's encoding). Pieces and words are told apart by a 64-bit hash.
    """

    def __init__(self, bpe: ByteBpe, merge: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None):
        self.bpe, self.merge, self.known = bpe, merge or bpe.encode_ranges, Remembered()

    def _merged(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.known.add(*self.merge(raw, starts, ends))

    def _by_words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        begins, stops, counts = self._words(raw, starts, ends)
        words = self._entries(raw, begins, stops, self._merged)
        first = np.cumsum(counts) - counts
        out, many = words[first], np.flatnonzero(counts > 1)
        theirs = words[ranges(first[many], counts[many])]
        out[many] = self.known.add(self.known.gather(theirs), sums(self.known.length[theirs].astype(np.int64), counts[many]))
        return out

    def _words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces' words by the vocabulary's pattern, as ranges, and how many each piece has.

        Letters of ASCII and Latin-1, alone or with one of END behind them, are cut by numpy, other pieces by the pattern.
        """
        letter = _LETTER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[_AFTER_C3[raw[lead + 1]]]
        letter[lead] = letter[lead + 1] = True
        other = np.r_[0, np.cumsum(~letter, dtype=np.int32)]
        body = starts + (raw[starts] == 0x20)
        stop = ends - (_END[raw[ends - 1]] & (ends - 1 > body))
        plain = (stop > body) & (other[stop] == other[body])
        counts, rest = np.where(stop < ends, 2, 1), np.flatnonzero(~plain)
        view, split = memoryview(raw), self.bpe.split
        found = [split(str(view[a:b], "utf-8")) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        counts[rest] = list(map(len, found))
        first = np.cumsum(counts) - counts
        stops = np.zeros(counts.sum(), np.int64)
        stops[first[plain]], stops[(first + counts - 1)[plain]] = stop[plain], ends[plain]
        size = np.array([len(w.encode()) for ws in found for w in ws], np.int64)
        so_far = np.cumsum(size)
        before = np.cumsum(ends[rest] - starts[rest]) - (ends[rest] - starts[rest])
        stops[ranges(first[rest], counts[rest])] = so_far + np.repeat(starts[rest] - before, counts[rest])
        begins = np.r_[0, stops[:-1]]
        begins[first] = starts
        return begins, stops, counts

    def _entries(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, resolve: Callable[..., np.ndarray]) -> np.ndarray:
        """Pool entries of the pieces in the ranges; the unknown ones go through resolve, each different short one once."""
        short = ends - starts <= SHORT
        hashes = range_hashes(raw, starts, ends)
        entries, hit = self.known.find(hashes)
        entries, hit = entries.astype(np.int64), hit & short
        new, long = np.flatnonzero(short & ~hit), np.flatnonzero(~short)
        if not len(new) and not len(long):
            return entries
        different, first, place = np.unique(hashes[new], return_index=True, return_inverse=True)
        wanted = np.r_[new[first], long]
        order = np.argsort(wanted)
        made = np.zeros(len(wanted), np.int64)
        made[order] = resolve(raw, starts[wanted[order]], ends[wanted[order]])
        self.known.name(different, made[: len(different)])
        entries[new], entries[long] = made[place], made[len(different) :]
        return entries

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts one after the other, and how many each text has."""
        cut, added = self.bpe.cut, self.bpe.added
        parts, counts, special = [], [], []
        for text in texts:
            before = len(parts)
            if cut is None or not any(a in text for a in added):
                parts.append(text.encode())
            else:
                for x in (x for x in cut.split(text) if x):
                    if x in added:
                        special.append((len(parts), added[x]))
                    parts.append(b"" if x in added else x.encode())
            counts.append(len(parts) - before)
        at = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        starts, ends, pieces = piece_ranges(raw, at)
        flat, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i, j in runs(starts, ends, BATCH_BYTES):
            if self.known.full:
                self.known.forget()
            base = starts[i]
            entries = self._entries(raw[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base, self._by_words)
            flat.append(self.known.gather(entries))
            lengths.append(self.known.length[entries].astype(np.int64))
        ids, by_part = np.concatenate(flat), sums(np.concatenate(lengths), pieces)
        if special:
            where, said = np.array([k for k, _ in special]), np.array([i for _, i in special], ids.dtype)
            ids = np.insert(ids, (np.cumsum(by_part) - by_part)[where], said)
            by_part[where] = 1
        return ids, sums(by_part, np.array(counts, np.int64))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the first counts[0] values, the next counts[1], ..."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder that all tasks of a Python worker share, so that its words stay known from task to task."""
    return Encoder(ByteBpe(path))


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row (doc_id, ids) for each row of docs (doc_id, text), in the ids of the vocabulary file.

    The file must lie at `path` on every executor. Texts that are null or empty give no ids; rows with a null
    doc_id, repeated rows and further columns of docs are taken as they come (further columns aren't
    returned); an empty table gives an empty one. A special token's string in a text becomes its id.
    """
    path = path or vocabulary_path()

    def make():
        shared = encoder(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts = shared.encode(texts_of(batch))
            flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))
            return record(ENCODED, doc_id=batch.column("doc_id"), ids=flat)

        return f

    return map_arrow(docs.select("doc_id", "text"), make, ENCODED)


DECODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The inverse of encode_documents: (doc_id, ids) to (doc_id, text); null ids give an empty text.

    Bytes that are no UTF-8 (ids cut within a character) become U+FFFD.
    """
    path = path or vocabulary_path()

    def make():
        bpe = ByteBpe(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [bpe.decode_bytes(np.asarray(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            return record(DECODED, doc_id=batch.column("doc_id"), text=texts)

        return f

    return map_arrow(encoded.select("doc_id", "ids"), make, DECODED)


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes each text in one pass and keeps what tells whether it came back: counts and hashes.

    Cases as in encode_documents.
    """
    path = path or vocabulary_path()

    def make():
        shared = encoder(path)
        bpe = shared.bpe

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts = shared.encode(texts_of(batch))
            ends = np.cumsum(counts)
            packed, decoded = memoryview(ids.astype("<u4").tobytes()), memoryview(bpe.decode_bytes(ids))
            size = sums(bpe.token_len[ids], counts)
            stop = np.cumsum(size)
            ids_sha = [hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            out_sha = [hashlib.sha256(whole(decoded[a:b])).hexdigest() for a, b in zip((stop - size).tolist(), stop.tolist(), strict=True)]
            return record(DIGEST, doc_id=batch.column("doc_id"), n_tokens=pa.array(counts), ids_sha256=ids_sha, decoded_sha256=out_sha)

        return f

    return map_arrow(docs.select("doc_id", "text"), make, DIGEST)


def whole(raw: memoryview) -> bytes:
    """The bytes as decoded text in UTF-8 again."""
    return bytes(raw).decode("utf-8", "replace").encode()
