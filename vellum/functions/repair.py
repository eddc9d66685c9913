"""Repairs that go word by word or character by character: Arrow UDFs, guarded by native tests."""

from __future__ import annotations

import difflib
import re
import unicodedata
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import text as t

# The names of the Greek letters in fonts, and the one that Unicode spells otherwise.
GREEK_NAMES = (
    "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu",
    "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "upsilon", "phi", "chi", "psi", "omega",
)
UNICODE_NAMES = {"lambda": "lamda"}
GREEK = {n: unicodedata.lookup(f"GREEK SMALL LETTER {UNICODE_NAMES.get(n, n)}") for n in GREEK_NAMES}
GREEK |= {n.capitalize(): unicodedata.lookup(f"GREEK CAPITAL LETTER {UNICODE_NAMES.get(n, n)}") for n in GREEK_NAMES}
GREEK_NAME = re.compile(r"/(" + "|".join(sorted(GREEK, key=len, reverse=True)) + r")(?:\d+|\b)")
LIGATURE = re.compile(r"(\w+) (ff|ffi|ffl|fi|fl) (\w+)")
SPLIT_WORD = re.compile(r"\b([A-Za-z]{2,}) +([a-z]{2,})\b")
PASSES = 8


def mapped(f, kind: T.DataType = T.StringType()):
    """A pandas UDF that applies f to each row's values; null where the first is null."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else f(*row) for row in zip(*columns, strict=True)], dtype="float64" if isinstance(kind, T.DoubleType) else object)

    return run


def guarded(test: Column, text: Column, f, *more: Column) -> Column:
    """f of the texts that pass the test; the rest stay as they are. Spark runs a Python UDF on every row, so those get a null."""
    return F.when(test, f(F.when(test, text), *more)).otherwise(text)


_unglyph = mapped(lambda s: GREEK_NAME.sub(lambda m: GREEK[m[1]], s))


def without_orphans(s: str) -> str:
    kept = []
    for c in s:
        if not unicodedata.combining(c) or (kept and not kept[-1].isspace()):
            kept.append(c)
    return "".join(kept)


_without_orphans = mapped(without_orphans)


def unglyph(text: Column) -> Column:
    """Greek letters for glyph names like /Delta1."""
    return guarded(text.contains("/"), text, _unglyph)


def strip_orphan_combining(text: Column) -> Column:
    """Without combining marks that have no character before them."""
    return guarded(text.rlike(r"\p{M}"), text, _without_orphans)


def normalize(text: Column) -> Column:
    return strip_orphan_combining(unglyph(text))


LETTERS = re.compile("[A-Za-z]+")


def words_of(text: str) -> list[str]:
    """The ASCII words of a text, compatibility forms folded."""
    return LETTERS.findall(text if text.isascii() else unicodedata.normalize("NFKC", text))


def vocabulary_of(text: str) -> list[str]:
    return sorted(set(words_of(text)))


vocabulary = mapped(vocabulary_of, T.ArrayType(T.StringType()))


def join_ligatures_once(s: str, known: set[str]) -> str:
    """Joins a ligature that stands alone to its neighbours where the vocabulary has the word."""

    def join(m: re.Match) -> str:
        left, ligature, right = m.groups()
        for form, pieces in ((f"{left}{ligature}{right}", left + ligature + right), (f"{left}{ligature} {right}", left + ligature), (f"{left} {ligature}{right}", ligature + right)):
            if pieces in known:
                return form
        return m[0]

    return LIGATURE.sub(join, s)


def join_known(s: str, known: set[str], good: set[tuple[str, str]]) -> str:
    """Split ligatures joined, in passes, as a joined one may be a piece of the next; then pieces of words, the first of which isn't a word itself.

    The pairs that were joined, (first piece, whole), are added to good.
    """
    for _ in range(PASSES if LIGATURE.search(s) else 0):
        before, s = s, join_ligatures_once(s, known)
        if s == before:
            break

    def join(m: re.Match) -> str:
        left, right = m.groups()
        if left in known or (whole := left + right) not in known:
            return m[0]
        good.add((left, whole))
        return whole

    return SPLIT_WORD.sub(join, s)


def transfer(s: str, glyphs: str, flags: list[str | None]) -> list[str | None]:
    """Flags of the glyphs for the characters of s, matched in order over white space and up to three glyphs too many."""
    solid = [(g, f) for g, f in zip(glyphs, flags, strict=True) if g.strip()]
    places = [k for k, g in enumerate(glyphs) if g.strip()]
    out, at = [None] * len(s), 0
    for k, c in enumerate(s):
        if c.isspace() or at >= len(solid):
            continue
        # the look-ahead is counted over all glyphs, blank ones too
        near = [j for j in range(at, len(solid)) if j == at or places[j] < places[at] + 4]
        hit = next((j for j in near if solid[j][0] == c), None)
        if hit is not None:
            out[k], at = solid[hit][1], hit + 1
    return out


def spare_numbers(s: str, flags: list[str | None]) -> list[str | None]:
    """Within a number only a group at its end stays raised or lowered."""
    flags = list(flags)
    for numeric, run in groupby(range(len(s)), key=lambda k: s[k].isdigit() or s[k] in ".,"):
        run = list(run)
        if numeric:
            plain = [k for k in run if flags[k] is None]
            for k in run:
                if plain and k < plain[-1]:
                    flags[k] = None
    return flags


def overlay(s: str, glyphs: str | None, flags: str | None, escaped: bool = False) -> str:
    """s with <sup> and <sub> around what the glyph layer shows raised (^) or lowered (_)."""
    quote = (lambda c: {"&": "&amp;", "<": "&lt;", ">": "&gt;"}.get(c, c)) if escaped else str
    marks: list[str | None] = [None] * len(s)
    if s and flags and flags.strip(" "):
        marks = spare_numbers(s, transfer(s, glyphs, [{"^": "sup", "_": "sub"}.get(f) for f in flags]))
    out = []
    for mark, run in groupby(zip(s, marks, strict=True), key=lambda x: x[1]):
        body = "".join(quote(c) for c, _ in run)
        out.append(f"<{mark}>{body}</{mark}>" if mark else body)
    return "".join(out)


_overlay, _overlay_escaped = mapped(lambda s, g, f: overlay(s, g, f)), mapped(lambda s, g, f: overlay(s, g, f, True))


def apply_scripts(text: Column, glyphs: Column, flags: Column, escape: bool = False) -> Column:
    """Of rows without a flagged glyph Python gets a null."""
    flagged = F.coalesce(flags.rlike(r"[\^_]"), F.lit(False))
    return F.when(flagged, (_overlay_escaped if escape else _overlay)(F.when(flagged, text), glyphs, flags)).otherwise(t.escape(text) if escape else text)


_ratio = mapped(lambda a, b: round(difflib.SequenceMatcher(None, a, b or "").ratio(), 3), T.DoubleType())


def ratio(a: Column, b: Column) -> Column:
    """How alike two texts are, 0 to 1 in thousandths. Of equal texts Python gets a null."""
    return F.when(a == b, F.lit(1.0)).otherwise(_ratio(F.when(F.coalesce(a != b, F.lit(True)), a), b))
