"""Headings: depth, kind, titles, anchors and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits are ASCII, [0-9], as `\d` is in Java and in the SQL beside the queries; section numbers must equal those of headings.
# What a structural label, a numbering, a title's prefix and a section reference look like.
LABEL = r"(?i)^(?:chapter|part|appendix)\s+(?:[0-9]+|[ivxlcdm]+|[a-z])\.?$"
NUMBERING = r"^\s*([0-9]+(?:\.[0-9]+)*)\s"
TITLE_PREFIX = r"^(?:(?:part|chapter|appendix)\s+(?:[0-9]+|[ivxlcdm]+)\b[.:]?\s*|(?:[0-9]+|[ivxlcdm]+)\b\s+)"
SECTION_REFERENCE = r"\b(?:sections?|sect\.?|§)\s*([0-9]+(?:\.[0-9]+)+)\b"
DOTTED = r"^([0-9]+(?:\.[0-9]+)+)\b"
DEEPEST = 6


def is_label(text: Column) -> Column:
    return F.trim(text).rlike(LABEL)


def depth(text: Column, level: Column) -> Column:
    """Dots of the numbering plus one, else the level from 1 on, else 1; at most six."""
    number = F.regexp_extract(F.coalesce(text, F.lit("")), NUMBERING, 1)
    numbered = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1
    return F.least(F.when(number != "", numbered).when(level >= 1, level).otherwise(1), F.lit(DEEPEST)).cast("int")


def kind(title: Column) -> Column:
    low = F.lower(F.trim(title))
    return F.when(low.startswith("appendix"), "appendix").when(low.startswith("chapter"), "chapter").when(low.startswith("part"), "part").otherwise("section")


def normalized_title(title: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(title)), TITLE_PREFIX, "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def anchor(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\p{L}\p{N}_\s-]", ""), r"(?U)\s+", "-")


def slug(title: Column) -> Column:
    """A file name of up to 50 characters; `section` where nothing is left."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.lower(title), r"(?U)[^\p{L}\p{N}_\s-]", "")), r"(?U)[\s_-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(bare, 1, 50), "^-+|-+$", ""), F.lit("")), F.lit("section"))


def alt_text(caption: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(caption, r"(?U)\s+", " "), "[]", "()"))


def strip_caption(gfm: Column) -> Column:
    """From the first row of pipes on; all of it where there is none."""
    found = F.split(gfm, "\n")
    first = F.array_position(F.transform(found, lambda x: F.ltrim(x).startswith("|")), F.lit(True))
    return F.regexp_replace(F.array_join(F.slice(found, F.greatest(first, F.lit(1)).cast("int"), F.size(found)), "\n"), r"(?U)^\s+|\s+$", "")
