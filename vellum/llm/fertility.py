"""Quality by tokeniser fertility: how public vocabularies cut a text, held against bands for its language or script."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.llm.bpe import ranges, sums, vocabulary_path
from vellum.llm.common import map_arrow, record, texts_of

SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\r\v\f"

#: For each language, else script: least and most characters a token in the piece vocabulary and in the byte
#: vocabulary, most share of byte-fallback tokens, least entropy of the tokens in bits. Prose of the four languages
#: lies well above the least byte-vocabulary figures, words strewn with symbols below.
BANDS = {
    "en": (1.6, 8.0, 1.86, 8.0, 0.05, 3.0),
    "de": (1.4, 8.0, 1.85, 8.0, 0.08, 3.0),
    "fr": (1.3, 8.0, 1.72, 8.0, 0.08, 3.0),
    "es": (1.4, 8.0, 1.77, 8.0, 0.08, 3.0),
    "latin": (1.3, 8.0, 0.9, 8.0, 0.10, 3.0),
    "other": (0.3, 8.0, 0.25, 8.0, 0.90, 3.0),
}
BASE_WORDS, BASE_REPEATED = 50, 50

#: Words that a worker remembers before it starts afresh.
REMEMBERED = 300_000

SCORED = T.StructType(
    [T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("band", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("piece_chars", "byte_chars", "fallback_share", "entropy")]
)


class Pieces(dict):
    """Ids of text pieces, remembered: piece -> index into a pool of ids.

    resolve gets new pieces and gives their ids, flat, and how many each has.
    """

    def __init__(self, resolve: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        super().__init__()
        self.resolve, self.new = resolve, []
        self.ids, self.length, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n

    def settle(self) -> None:
        if self.new:
            ids, length = self.resolve(self.new)
            self.ids = np.concatenate([self.ids, ids])
            self.length = np.concatenate([self.length, length])
            self.at = np.cumsum(self.length) - self.length
            self.new = []

    def forget(self, most: int = REMEMBERED) -> None:
        if len(self) > most:
            self.clear()
            self.__init__(self.resolve)


def repeated_words(words: np.ndarray) -> int:
    """Words in windows of three that occur twice or more; words: numbers below 2**31, equal for equal words."""
    if len(words) < 4:
        return 0
    if words.max() < 1 << 21:
        keys = words[:-2] << 42 | words[1:-1] << 21 | words[2:]
    else:  # pairs by numbers of their own, so that three words fit a key
        pairs = np.unique(words[:-1] << 32 | words[1:], return_inverse=True)[1].astype(np.int64)
        keys = pairs[:-1] << 32 | words[2:]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(words), bool)
    found = order[np.r_[same, False] | np.r_[False, same]]
    for k in range(3):
        twice[found + k] = True
    return int(twice.sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE.decode())]
    return len(lines) - len(set(lines))


class Fertility:
    """How many tokens a word takes, in a piece vocabulary with byte fallback and in a byte vocabulary."""

    def __init__(self, pieces: str, byte_ranks: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(byte_ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.fallback = np.array([self.model.is_byte(k) for k in range(self.model.get_piece_size())])
        self.words = Pieces(self._resolve)
        self.byte_tokens = np.zeros(0, np.int64)

    def _resolve(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        said = [w.decode() for w in new]
        ids = self.model.encode(said, num_threads=1)
        self.byte_tokens = np.concatenate([self.byte_tokens, np.array([len(self.byte(" " + w)) for w in said], np.int64)])
        return np.array([i for x in ids for i in x], np.int64), np.array(list(map(len, ids)), np.int64)

    def index(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers, one text after the other, and how many words each has."""
        self.words.forget()
        if not len(self.words):
            self.byte_tokens = np.zeros(0, np.int64)
        parts, counts = [], []
        for t in texts:
            found = t.split()
            parts.extend(map(self.words.__getitem__, found))
            counts.append(len(found))
        self.words.settle()
        return np.array(parts, np.int64), np.array(counts, np.int64)


def entropy(ids: np.ndarray) -> float:
    if not len(ids):
        return 0.0
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(share * np.log2(share)).sum())


def script_of(text: str) -> str:
    """latin if most of the letters are below U+0250, else other."""
    letters = sum(map(str.isalpha, text))
    return "latin" if 2 * sum(c.isalpha() and c < "ɐ" for c in text) >= letters else "other"


def score(docs: DataFrame, pieces: str | None = None, byte_ranks: str | None = None, bands: dict = BANDS) -> DataFrame:
    """Counts, measures and verdict for each row of docs (doc_id, text, lang).

    base_failed: fewer than BASE_WORDS words, or more than BASE_REPEATED percent of them in repeated windows of three.
    kept: not base_failed, and all measures within the band of lang, or of the text's script where lang is null or has no
    band. Words of all the text are measured, each as it is cut alone. A null or empty text has no words and fails; null
    doc_ids and repeated rows are kept as they come, further columns ignored; an empty table gives an empty one.
    """
    pieces, byte_ranks = pieces or vocabulary_path("piece_bpe_32k.model"), byte_ranks or vocabulary_path("byte_bpe_multi_50k.tiktoken")

    def make():
        fertility = Fertility(pieces, byte_ranks)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            raw = [t.encode() for t in texts]
            index, counts = fertility.index(raw)
            length = fertility.words.length[index]
            ids = fertility.words.ids[ranges(fertility.words.at[index], length)]
            tokens, byte_tokens = sums(length, counts), sums(fertility.byte_tokens[index], counts)
            fallback = sums(fertility.fallback[ids].astype(np.int64), tokens)
            ends, token_ends = np.cumsum(counts), np.cumsum(tokens)
            narrow = len(fertility.words) < 1 << 21
            rows = []
            for k, (text, b, lang) in enumerate(zip(texts, raw, batch.column("lang").to_pylist(), strict=True)):
                n = int(counts[k])
                words = index[ends[k] - n : ends[k]]
                if not narrow:
                    words = np.unique(words, return_inverse=True)[1]
                chars = len(text) - (len(b) - len(b.translate(None, SPACE)))
                repeated = repeated_words(words)
                failed = n < BASE_WORDS or 100 * repeated > BASE_REPEATED * n
                band = lang if lang in bands else script_of(text)
                measures = (chars / max(int(tokens[k]), 1), chars / max(int(byte_tokens[k]), 1), int(fallback[k]) / max(int(tokens[k]), 1), entropy(ids[token_ends[k] - tokens[k] : token_ends[k]]))
                low, high, byte_low, byte_high, most, least = bands[band]
                good = low <= measures[0] <= high and byte_low <= measures[1] <= byte_high and measures[2] <= most and measures[3] >= least
                rows.append((n, chars, len(b) - len(b.translate(None, SYMBOLS)), repeated_lines(text), repeated, failed, not failed and good, band, *measures))
            return record(SCORED, doc_id=batch.column("doc_id"), **dict(zip(SCORED.names[1:], map(list, zip(*rows, strict=True)), strict=True)))

        return f

    return map_arrow(docs.select("doc_id", "text", "lang"), make, SCORED)
