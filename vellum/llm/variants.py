"""Spelling variants: words that one edit turns into each other, found by bands of letter-parity masks.

A word's mask holds for each letter whether the word has it an odd number of times. One inserted or deleted letter flips
one bit of it, a replaced one two or none, so of three bands of the mask one at least stays as it was, and of any two
bands one if the lengths differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch

#: Code points that a word has at least, occurrences that it has at least, how much more frequent a word's form is.
SHORTEST, RAREST, TIMES = 6, 5, 5
#: One in so many occurrences of the query's words loses a code point.
ONE_IN = 199
#: Bands of a mask, and bits of a band.
BANDS, WIDTH = 3, 20
#: The letters by how often they stand in texts: neighbours go to different bands, so that no band holds the rare ones alone.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bits() -> list[int]:
    """The mask of each code point below 256; those above share the bits of those below."""
    order = LETTERS + "".join(chr(c) for c in range(256) if chr(c) not in LETTERS)
    place = {c: (k % BANDS) * WIDTH + k // BANDS % WIDTH for k, c in enumerate(order)}
    return [1 << place[chr(c)] for c in range(256)]


def mask(word: Column) -> Column:
    """Which letters the word has an odd number of times, BANDS * WIDTH bits."""
    bits = F.lit(_bits()).cast("array<bigint>")
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.get(bits, F.ascii(c) % 256)))


def band(mask: Column, k: int) -> Column:
    return F.shiftright(mask, k * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n): runs of Latin letters with A-Z lower-cased, by how often they occur; short and rare ones left out.

    Where ONE_IN divides the CRC-32 of `<doc_id>:<run>`, the run loses the code point at that number modulo its length, in
    all its occurrences in the document. A null doc_id is an empty text there; a null or empty text has no runs; repeated
    rows count again.
    """
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.withColumn("run", F.translate("run", UPPER, LOWER))
    found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = found.select(F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    words = words.where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= RAREST)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of different words of (word, n) that one edit of a code point turns into each other, once.

    The words of a pair are equal in one band at least, and in the half before the edit or in the one behind it. A row is
    made for each band and half, of the length that the shorter word of a pair has; longer ones need two bands
    alone. Rows meet by a hash of those, so the groups are of words with the same half and the same band. A pair that
    meets several times is taken in its first equal band and half; then masks and edits are compared.
    """
    own = words.where(F.col("word") != "").select("word", "n", mask(F.col("word")).alias("mask"), F.length("word").alias("length"))

    def half(base: Column, side: int) -> Column:
        cut = F.floor(base / 2).cast("int")
        return F.substring("word", F.lit(1), cut) if side == 0 else F.right(F.col("word"), base - cut)

    def rows(base: Column, bands: range, longer: bool) -> list[Column]:
        out = []
        for k in bands:
            for side in (0, 1):
                key = F.xxhash64(F.lit(2 * k + side), base, band(F.col("mask"), k), half(base, side))
                out.append(F.struct(F.lit(k).alias("band"), F.lit(side).alias("side"), F.lit(longer).alias("longer"), key.alias("key")))
        return out

    length = F.col("length")
    equal, longer = rows(length, range(BANDS), False), rows(length - 1, range(BANDS - 1), True)
    left = own.select("word", "n", "mask", "length", F.explode(F.array(*equal)).alias("at")).select("word", "n", "mask", "length", "at.*")
    right = own.select("word", "n", "mask", F.explode(F.array(*equal, *longer)).alias("at")).select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("mask").alias("m_b"), "at.longer", "at.key")
    left = left.drop("longer").withColumnsRenamed({"word": "a", "n": "n_a", "mask": "m_a"})
    same = [band(F.col("m_a"), k) == band(F.col("m_b"), k) for k in range(BANDS)]
    first = F.when(same[0], 0).when(same[1], 1).when(same[2], 2)
    cut = F.floor(F.col("length") / 2).cast("int")
    heads = F.substring("a", F.lit(1), cut) == F.substring("b", F.lit(1), cut)
    flips = F.bit_count(F.col("m_a").bitwiseXOR(F.col("m_b")))
    # by the size of the words' file Spark would broadcast the rows made of it, ten for each word
    met = left.join(right.hint("merge"), "key").where((F.col("longer") | (F.col("a") < F.col("b"))) & (flips <= 2))
    met = met.where((F.col("band") == first) & (F.col("side") == F.when(heads, 0).otherwise(1)))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def forms(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n), whose words are distinct.

    n_near: how many words are near; form: the near word of largest n, of equals the least by code point, if it
    is TIMES as frequent, else null; root: where the forms lead from the word, itself if it has none. n grows by TIMES with
    each step, so that the ways end; they are followed by pointer doubling. No words give no rows; null ones are left out.
    Tables of words are joined by shuffles alone, so that none passes through the driver.
    """
    words = scratch.table(words.where("word IS NOT NULL").select("word", "n"), "words")
    pair = F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n"))
    back = F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n"))
    both = near_pairs(words).select(F.explode(F.array(pair, back)).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.less") >= TIMES * F.col("n")
    near = near.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    near = scratch.table(near, "near")
    to, k = scratch.table(near.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        k += 1
        on = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = scratch.table(to.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{k}")
        moved = not step.where("moved").isEmpty()
        to = step.select("word", "root")
        if not moved:
            break
    out = words.join(near.hint("merge"), "word", "left").join(to.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
