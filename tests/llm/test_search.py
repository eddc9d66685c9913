"""Collocations, exact top-k search and spelling variants against brute force; nulls, empties, ties, repeated rows, clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import phrases, queries, topk, variants, words
from vellum.llm.common import Scratch

DIR = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_phrases(docs, often, top=phrases.TOP):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lowered(text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {x: c for x, c in f.items() if c >= often}
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or any(y[0] == lang and len(y[1]) > len(w) and any(y[1][i : i + len(w)] == w for i in range(len(y[1]))) and 100 * c >= 80 * a for y, c in f.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("shard", [2_000_000, 40])
def test_collocations(spark, monkeypatch, shard):
    """Pieces, languages, overlaps; in small shards too, of which each has few words."""
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    r = random.Random(5)
    letters = ["a", "B", "é", "dd", "a b a b", ".", ", ", "\n", "\t", "  ", "\x0b", "x-y", "漢字"]
    docs = [(r.choice(["en", "fr", None, ""]), " ".join(r.choices(letters, k=r.randrange(40)))) for _ in range(300)]
    docs += [("en", None), (None, ""), ("en", " . "), ("de", "one two three"), ("xx", "long " * 30_000)]
    df = spark.createDataFrame([(k, *d, "f") for k, d in enumerate(docs)], "doc_id long, lang string, text string, f string").repartition(3)
    assert set(rows_of(phrases.mine(df, Scratch(spark, "t")))) == brute_phrases(docs, phrases.OFTEN)
    assert phrases.mine(df.limit(0), Scratch(spark, "t")).count() == 0


def test_collocation_arithmetic_is_exact(spark):
    """Products beyond 64 bits, equal scores after flooring, top phrases alone."""
    big = 9_000_000_000_000_000
    found = [("en", "a", big, 1), ("en", "b", big, 1), ("en", "c", 3 * big, 1), ("en", "a b", big - 1, 2), ("en", "b c", big, 2), ("en", "a b c", big // 2, 3), ("en", "", 9 * big, 0)]
    df = spark.createDataFrame(found, "lang string, phrase string, f long, size int")
    got = rows_of(phrases.collocations(df))
    assert got == [("en", 1, "a b", big - 1, big, big, 9 * big, 999_999), ("en", 2, "b c", big, big, 3 * big, 9 * big, 500_000), ("en", 3, "a b c", big // 2, big - 1, 3 * big, 9 * big, 250_000)]
    assert len(rows_of(phrases.collocations(df, top=1))) == 1


def test_suffix_arrays():
    r = np.random.default_rng(1)
    for _ in range(50):
        seq = np.r_[0, r.integers(0, 4, int(r.integers(0, 60))), 0, 0, 0, 0]
        order = phrases.suffix_array(seq, 4)
        assert [tuple(np.r_[seq, [0] * 4][i : i + 4]) for i in order] == sorted(tuple(np.r_[seq, [0] * 4][i : i + 4]) for i in range(len(seq)))
        for k, places, counts in phrases.ngrams(seq, range(1, 5)):
            want = Counter(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1) if all(seq[i : i + k]))
            assert {tuple(seq[p : p + k]): c for p, c in zip(places, counts, strict=True)} == want


def brute_top(rows, k=10):
    best = {}
    for key, v in rows:
        if key is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        best.setdefault(key, set()).add(tuple(int(np.floor(1024 * np.float64(x))) for x in v))
    out = set()
    for q, own in best.items():
        if q % 100 == 0:
            query = min(own)
            scores = [(-max(sum(a * b for a, b in zip(query, c, strict=True)) for c in them if len(c) == len(query)), i) for i, them in best.items() if i != q and any(len(c) == len(query) for c in them)]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_top_k(spark):
    """Ties, repeated rows, several vectors of an id, other lengths, nulls, numbers that floating point would round."""
    r = np.random.default_rng(3)
    rows = [(k, (r.integers(-3, 4, 6) / 2).tolist()) for k in range(350)] + [(k, [0.5] * 6) for k in range(350, 500)]
    rows += [(7, rows[7][1]), (200, [1.0] * 6), (9, [2.0] * 6), (600, None), (601, [None] + [1.0] * 5), (602, [float("nan")] * 6), (603, [float("inf")] * 6), (None, [1.0] * 6), (700, [1.0, 2.0]), (701, [2.0, 1.0]), (800, []), (801, [])]
    rows += [(900, [2.0**40, 1.0, 3.0]), (901, [2.0**41, 1.0, 0.5]), (902, [-(2.0**41), 1.0, 0.5])]
    schema = "vec_id long, embedding array<double>, score string"
    got = rows_of(topk.nearest(spark.createDataFrame([(*x, "s") for x in rows], schema), Scratch(spark, "t")))
    want = {(q, n, i, max(topk.LIMITS[0], min(topk.LIMITS[1], s))) for q, n, i, s in brute_top(rows)}
    assert set(got) == want and len(got) == len(want)
    assert topk.nearest(spark.createDataFrame([], schema), Scratch(spark, "t")).count() == 0


def test_top_k_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 4000)
    monkeypatch.setattr(topk, "QUERIES", 1000)
    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=8).round(3).tolist()) for k in range(900)]
    got = rows_of(topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark, "t")))
    assert set(got) == brute_top(rows) and len(got) == 90


def test_bounds_hold_and_spare_products():
    r = np.random.default_rng(6)
    centres = r.normal(size=(20, 16)) * 500
    m = np.floor(centres[r.integers(0, 20, 4000)] + r.normal(size=(4000, 16)) * 40)
    pivots = topk.Pivots([(k, v.tolist()) for k, v in enumerate(m[:500])])
    d, squares, tried = pivots.distances(m), (m * m).sum(1), 0
    for q in range(40):
        apart = np.abs(d - d[q]).max(1).astype(float)
        bounds = (squares + squares[q] - apart * apart) / 2 + 1e-6 * (2 * d.max()) ** 2 + 1
        assert (bounds >= m @ m[q]).all()
        ids, scores, n = topk.search(m[q], bounds, np.arange(4000), m, 10, -1e300)
        order = sorted(range(4000), key=lambda k: (-(m[k] @ m[q]), k))[:10]
        assert ids.tolist() == order and scores.tolist() == [m[k] @ m[q] for k in order]
        tried += n
    assert tried < 40 * 4000 / 2


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_forms(n):
    by = {}
    for w in n:
        for key in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by.setdefault(key, set()).add(w)
    near = {w: {x for key in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} for x in by[key] if one_edit(w, x)} for w in n}
    form = {}
    for w, them in near.items():
        best = min(them, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] is not None else None) for w in n}


def test_variants_of_the_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = rows_of(queries.op13_variants(spark, DIR))
    assert len(got) == len(set(got)) and set(got) == brute_forms(brute_words(docs))


def test_runs_lose_a_letter_and_odd_documents(spark):
    docs = [(k, "Alphabet ÀLPHABET straße œuvres ab " + "x" * 30_000) for k in range(1500)] + [(None, "alphabets " * 7), (None, None), (3, "")]
    df = spark.createDataFrame([(*d, "w") for d in docs], "doc_id long, text string, word string")
    found = {r.word: r.n for r in variants.word_counts(df).collect()}
    assert found == brute_words(docs) and found["x" * 29_999] >= 5
    assert variants.forms(variants.word_counts(df.limit(0)), Scratch(spark, "t")).count() == 0


def test_edits_of_every_kind(spark):
    """Edits at each place of words of each length, letters beyond Latin-1, chains of forms, ties."""
    r = random.Random(8)
    n = {"a": 3, "ab": 90, "é": 4, "żółw": 7, "żółw漢": 50}
    for base in ("letters", "abcabcabcabc", "aaaaaaa", "übergröße"):
        n[base] = 5**9
        for _ in range(150):
            k, c = r.randrange(len(base) + 1), r.choice("abcdeüßxyz漢")
            for w in (base[:k] + c + base[k:], base[:k] + c + base[k + 1 :], base[:k] + base[k + 1 :]):
                n.setdefault(w, r.choice([1, 5, 25, 5**5]))
    df = spark.createDataFrame([*n.items(), (None, 9)], "word string, n long")
    got = rows_of(variants.forms(df, Scratch(spark, "t")))
    assert len(got) == len(n) and set(got) == brute_forms(n)


def test_long_words_made_to_collide():
    """The Thue-Morse sequence and its mirror agree under any polynomial hash modulo a power of two."""
    one = [bin(k).count("1") % 2 for k in range(4096)]
    texts = ["".join("ab"[b ^ flip] for b in one) for flip in (0, 1)]
    import pyarrow as pa

    h, counts = words.word_hashes(pa.array([*texts, texts[0].upper()]))
    assert counts.tolist() == [1, 1, 1] and h[0] != h[1] and h[0] == h[2]


def test_texts_of_colliding_words_stay_apart(spark):
    from vellum.llm import neardup

    one = [bin(k).count("1") % 2 for k in range(4096)]
    docs = [(flip, "".join("ab"[b ^ flip] for b in one)) for flip in (0, 1)]
    got = neardup.components(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark, "t"))
    assert {r.doc_id: r.component_id for r in got.select(F.col("doc_id"), "component_id").collect()} == {0: 0, 1: 1}
