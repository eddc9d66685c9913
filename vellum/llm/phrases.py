"""Phrases that belong together: n-gram counts from suffix arrays over word ids, a shard at a time, merged by key.

A shard is what a task has read of one language. Numpy prefix doubling sorts its suffixes by their first words, and the
intervals of suffixes that agree in so many words are its n-grams. Words and pairs of words are merged first; longer
phrases consist of frequent pairs, so the second reading takes only runs of those, found by a filter of fixed size that
never misses one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import Scratch, slices, small_join
from vellum.llm.words import buffer_of, mixed, range_hashes, word_ranges

#: Words of a phrase at most, occurrences that count as often, phrases of a language in the result.
LONGEST, OFTEN, TOP = 4, 30, 2000
#: A phrase goes if a longer one around it has SHARE percent of its occurrences; scores are whole parts of SCALE.
SHARE, SCALE = 80, 2_000_000
#: Words that a task gathers, of all languages, before it makes its shards; rows of a batch that it puts out.
SHARD_WORDS, BATCH = 2_000_000, 1 << 16
#: Bits of the filter: so many for each frequent pair, up to MOST_BITS (32 MB). Beyond, it lets more through and loses nothing.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28

#: Which bytes part words, and which of them part pieces: . , ; : ! ? and U+000A to U+000D.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, and which of them begin a piece. A text ends a piece; null counts as empty."""
    raw, at = buffer_of(texts)
    raw = np.where((raw >= 0x41) & (raw <= 0x5A), raw + np.uint8(0x20), raw)
    starts, ends, counts = word_ranges(raw, at, _GAP)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, bool)
    breaks = np.cumsum(_BREAK[raw], dtype=np.int32)[starts]
    begins = np.r_[True, breaks[1:] != breaks[:-1]]
    first = np.cumsum(counts) - counts
    begins[first[counts > 0]] = True
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    data = raw[~_GAP[raw]]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), begins


def sequence(ids: np.ndarray, begins: np.ndarray, room: int) -> np.ndarray:
    """The ids, from 1 on, with a 0 before each piece and `room` zeros behind the last."""
    out = np.zeros(len(ids) + int(begins.sum()) + room, np.int64)
    out[np.arange(len(ids)) + np.cumsum(begins)] = ids
    return out


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """The places of seq ordered by the `depth` ids from each on: ranks of one id, then of two, of four, by doubling."""
    rank, k = seq, 1
    while k < depth:
        key = rank * (rank.max(initial=0) + 1)
        key[:-k] += rank[k:]
        rank, k = np.unique(key, return_inverse=True)[1], 2 * k
    return np.argsort(rank, kind="stable")


def common_prefixes(seq: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many ids each suffix shares with the one before it, up to `depth` and never over a 0."""
    padded = np.r_[seq, np.zeros(depth, seq.dtype)]
    alive, out = np.ones(max(0, len(order) - 1), bool), np.zeros(max(0, len(order) - 1), np.int8)
    for k in range(depth):
        here = padded[order[1:] + k]
        alive &= (here == padded[order[:-1] + k]) & (here > 0)
        out += alive
    return np.r_[np.zeros(min(1, len(order)), np.int8), out]


def ngrams(seq: np.ndarray, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, counts) for each k of sizes: where each different k-gram of seq stands once, and how often it occurs."""
    depth = max(sizes)
    order = suffix_array(seq, depth)
    shared = common_prefixes(seq, order, depth)
    zero = np.flatnonzero(seq == 0)
    room = zero[np.searchsorted(zero, order)] - order if len(zero) else np.zeros(0, int)
    for k in sizes:
        heads = np.flatnonzero(shared < k)
        counts = np.diff(np.r_[heads, len(order)])
        whole = room[heads] >= k
        yield k, order[heads[whole]], counts[whole]


class Filter:
    """Which pairs of words of a language may be frequent: two bits of a table for each that is, never a miss."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # 64 to a number

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        return [(h & np.uint64(size - 1)).astype(np.int64) for h in (hashes, mixed(hashes + _FACTOR))]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for p in self.places(hashes, 64 * len(self.bits)):
            out &= (self.bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def hashes_of(words: pa.Array) -> np.ndarray:
    raw, at = buffer_of(words)
    return range_hashes(raw, at[:-1], at[1:])


def pair_hashes(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    return mixed(mixed(first * _FACTOR + seed) * _FACTOR + second)


COUNTS = T.StructType([T.StructField("key", T.StringType()), T.StructField("f", T.LongType())])
ARROW = pa.schema([("key", pa.string()), ("f", pa.int64())])


def shard_counts(lang: str, words: pa.Array, begins: np.ndarray, sizes: range, keep: Filter | None) -> Iterator[pa.RecordBatch]:
    """(key, f) of the shard's phrases of so many words: `<lang> TAB <phrase>`; with one-word phrases also all words under an empty phrase.

    With a filter, phrases of pairs that it lets through alone.
    """
    coded = words.dictionary_encode()
    ids, known = coded.indices.to_numpy().astype(np.int64) + 1, coded.dictionary
    if keep is not None:
        h = hashes_of(known)[ids - 1]
        tied = np.r_[keep.has(pair_hashes(lang, h[:-1], h[1:])) & ~begins[1:], False] if len(ids) else np.zeros(0, bool)
        after = np.r_[False, tied[:-1]]
        held = tied | after
        ids, begins = ids[held], ~after[held]
    seq = sequence(ids, begins, max(sizes))
    if 1 in sizes:
        yield pa.record_batch([pa.array([f"{lang}\t"]), pa.array([len(ids)], pa.int64())], schema=ARROW)
    for k, places, counts in ngrams(seq, sizes):
        for at in range(0, len(places), BATCH):
            part = places[at : at + BATCH]
            said = [known.take(pa.array(seq[part + j] - 1)) for j in range(k)]
            phrase = pc.binary_join_element_wise(*said, " ") if k > 1 else said[0]
            key = pc.binary_join_element_wise(pa.scalar(lang), phrase, "\t")
            yield pa.record_batch([key, pa.array(counts[at : at + BATCH], pa.int64())], schema=ARROW)


def counted(docs: DataFrame, sizes: range, keep: Broadcast | None = None) -> DataFrame:
    """(key, f) of all shards of docs (lang, text), a row for each phrase of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Filter(keep.value) if keep is not None else None
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        total = 0

        def shards() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                parts = held.pop(lang)
                yield from shard_counts(lang, pa.concat_arrays([w for w, _ in parts]), np.concatenate([b for _, b in parts]), sizes, found)

        for batch in batches:
            for part in slices(batch):
                langs = part.column("lang")
                for lang in langs.unique().to_pylist():
                    words, begins = pieces(part.column("text").filter(pc.equal(langs, lang)))
                    if len(words):
                        held.setdefault(lang, []).append((words, begins))
                        total += len(words)
                if total >= SHARD_WORDS:
                    yield from shards()
                    total = 0
        yield from shards()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, COUNTS)


def merged(counts: DataFrame, often: int) -> DataFrame:
    """(lang, phrase, f) of the keys that occur often, and the totals under an empty phrase.

    A shard has a key once, so the rows are dealt by key before they are added up, and not added up within tasks first.
    """
    total = F.col("key").endswith("\t")
    sums = counts.repartition("key").groupBy("key").agg(F.sum("f").alias("f")).where((F.col("f") >= often) | total)
    phrase = F.substring_index("key", "\t", -1)
    return sums.select(F.expr("substring(key, 1, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "f")


BITS = T.StructType([T.StructField("slot", T.LongType()), T.StructField("bits", T.LongType())])


def filter_of(pairs: DataFrame) -> np.ndarray:
    """The bits of a Filter of the pairs (lang, phrase), set in tasks and or-ed by slot; the driver gets a row for each slot that has any."""
    size = LEAST_BITS
    wanted = BITS_EACH * pairs.count()
    while size < min(wanted, MOST_BITS):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hashes_of(pc.list_flatten(pc.split_pattern(b.column("phrase"), " "))).reshape(-1, 2)
            langs = b.column("lang")
            for lang in langs.unique().to_pylist():
                own = h[pc.equal(langs, lang).to_numpy(zero_copy_only=False)]
                p = np.concatenate(Filter.places(pair_hashes(lang, own[:, 0], own[:, 1]), size))
                bits = np.uint64(1) << (p & 63).astype(np.uint64)
                yield pa.record_batch([pa.array(p >> 6), pa.array(bits.view(np.int64))], names=BITS.names)

    slots = pairs.select("lang", "phrase").mapInArrow(run, BITS).groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return out


def frequent(docs: DataFrame, scratch: Scratch, often: int = OFTEN) -> DataFrame:
    """(lang, phrase, f, size) of all phrases of up to LONGEST words that occur often; size 0, with an empty phrase: all words of the language.

    docs: (lang, text) and any others. A null lang is `und`; a null or empty text has no words; repeated rows count again.
    """
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("size")
    short = scratch.table(merged(counted(docs, range(1, 3)), often).select("*", words), "short")
    bits = short.sparkSession.sparkContext.broadcast(filter_of(short.where("size = 2")))
    long = merged(counted(docs, range(3, LONGEST + 1), bits), often).select("*", words)
    out = short.unionByName(scratch.table(long, "long"))
    bits.unpersist()
    return out


def collocations(found: DataFrame, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `top` phrases of two words or more whose parts go together best.

    found: as `frequent` gives it. A phrase of frequency a, cut after its first words into parts of l and r, scores
    floor(SCALE * a / (l + r)); the cut of the least score counts, of equal ones the first. It goes if a
    longer frequent phrase around it has `share` percent of its occurrences. Ranks by score, a, then the phrase's bytes.
    """
    one = found.where("size > 0").select("lang", "phrase", "f")
    many = found.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("words"))
    cut = many.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ").alias("rest"))
    cut = cut.join(one.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(one.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast({SCALE} as decimal(9,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")))))
    inside = many.where("size > 2").select("lang", spans.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = best.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < share * F.col("a"), F.lit(True)))
    ranked = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = found.where("size = 0").select("lang", F.col("f").alias("n"))
    return small_join(ranked, totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The collocations of docs (lang, text): cases as in `frequent`; no documents, or none with phrases, give no rows."""
    return collocations(scratch.table(frequent(docs, scratch), "frequent"))


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS size, array_to_string(ws[i:i+{k - 1}], ' ') AS phrase FROM w, UNNEST(range(1, len(ws) - {k - 2})) AS t(i)" for k in range(1, LONGEST + 1))
SQL = rf"""WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLD}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), n AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY lang, size, phrase HAVING count(*) >= {OFTEN}
), many AS (
  SELECT *, string_split(phrase, ' ') AS words FROM f WHERE size > 1
), cuts AS (
  SELECT many.lang, many.phrase, many.f AS a, k, l.f AS l, r.f AS r, CAST({SCALE}::HUGEINT * many.f // (l.f + r.f) AS BIGINT) AS score
  FROM many CROSS JOIN UNNEST(range(1, size)) AS t(k) JOIN f l ON l.lang = many.lang AND l.phrase = array_to_string(words[1:k], ' ') JOIN f r ON r.lang = many.lang AND r.phrase = array_to_string(words[k+1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(words[i:i+k-1], ' ') AS phrase, max(f) AS around FROM many CROSS JOIN UNNEST(range(2, size)) AS t(k) CROSS JOIN UNNEST(range(1, size - k + 2)) AS u(i) GROUP BY 1, 2
), ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < {SHARE} * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}"""
