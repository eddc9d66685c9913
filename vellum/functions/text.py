"""Text measures and clean-up as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a letter that a font could not map, glyph names, control characters, block types, thresholds.
SUBSTITUTE = r"[\x{2460}-\x{27BF}\x{E000}-\x{F8FF}\x{FFFD}]"
GLYPH_NAME = r"/a[0-9]+"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
UNCLEAN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}]"
DECORATION = r"[^*\-=_#~]"
WORD = r"[\p{L}\p{N}_]"
SPLIT_LIGATURE = rf"{WORD} (?:ff|ffi|ffl|fi|fl) {WORD}"
SPLIT_WORD = rf"(?<!{WORD})[A-Za-z]{{2,}} +[a-z]{{2,}}(?!{WORD})"
LIGATURE_BYTES = (("\x02", ""), ("\x1b", "ff"), ("\x1c", "fi"), ("\x1d", "fl"), ("\x1e", "ffi"), ("\x1f", "ffl"))
RULE_PIPE = r"(?:(?<=\s)|^)\|(?=\s|$)"
PROSE = ("paragraph", "heading", "list", "caption", "footnote", "other")
GARBAGE_BELOW = 0.6


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once a row, however often f's expression names it.

    f may name nothing but its argument: Spark takes no Python UDF inside a lambda, and other columns may come from one.
    """
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def legibility(text: Column) -> Column:
    """Letters / (letters + substitutes + glyph names); 1 where there is none of them; null for null."""

    def among(bare: Column, characters: str) -> Column:
        return F.length(bare) - F.length(F.regexp_replace(bare, f"{characters}+", ""))

    def counts(x: Column) -> Column:
        letters, marks = among(x["bare"], r"\p{L}"), among(x["bare"], SUBSTITUTE)
        return F.struct(letters.alias("letters"), (x["names"] + marks).alias("suspect"))

    parts = F.struct(F.regexp_replace(text, GLYPH_NAME, "").alias("bare"), F.regexp_count(text, F.lit(GLYPH_NAME)).alias("names"))
    counted = bind(parts, counts)
    return bind(counted, lambda c: F.when(c["letters"] + c["suspect"] == 0, 1.0).otherwise(c["letters"] / (c["letters"] + c["suspect"])))


def is_garbage(text: Column) -> Column:
    return legibility(text) < GARBAGE_BELOW


def is_clean(text: Column) -> Column:
    return ~text.rlike(UNCLEAN)


def lines(text: Column) -> Column:
    """Lines with something on them."""
    return F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: x.rlike(r"(?U)\S"))


def is_decoration(line: Column) -> Column:
    bare = strip(line)
    return (F.length(bare) >= 4) & (F.length(F.regexp_replace(bare, DECORATION, "")) / F.length(bare) >= 0.8)


def is_preformatted(text: Column, pipes: bool = False) -> Column:
    """Three lines or more, two of them rules; with pipes, two lines with two pipes will do too."""
    found = lines(text)
    rules = F.size(F.filter(found, is_decoration)) >= 2
    if pipes:
        rules = rules | (F.size(F.filter(found, lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2)) >= 2)
    return F.coalesce((F.size(found) >= 3) & rules, F.lit(False))


def has_split_ligature(text: Column) -> Column:
    return text.rlike(SPLIT_LIGATURE)


def has_split_word(text: Column) -> Column:
    return text.rlike(SPLIT_WORD)


def ligature_forms(text: Column) -> Column:
    """The words that a ligature standing alone would make with its neighbours: with both, with the left, with the right one."""
    left, middle, right = (F.regexp_extract_all(text, F.lit(rf"({WORD}+) (ff|ffi|ffl|fi|fl) ({WORD}+)"), F.lit(k)) for k in (1, 2, 3))
    forms = F.transform(F.arrays_zip(left.alias("l"), middle.alias("m"), right.alias("r")), lambda x: F.array(F.concat(x["l"], x["m"], x["r"]), F.concat(x["l"], x["m"]), F.concat(x["m"], x["r"])))
    return F.array_distinct(F.flatten(forms))


def split_words(text: Column) -> Column:
    """Pairs (left, right) of ASCII words with spaces between, the right one in lower case, no word in two pairs."""
    left, right = (F.regexp_extract_all(text, F.lit(rf"(?<!{WORD})([A-Za-z]{{2,}}) +([a-z]{{2,}})(?!{WORD})"), F.lit(k)) for k in (1, 2))
    return F.array_distinct(F.arrays_zip(left.alias("left"), right.alias("right")))


def expand_ligatures(text: Column) -> Column:
    for byte, letters in LIGATURE_BYTES:
        text = F.replace(text, F.lit(byte), F.lit(letters))
    return text


def clean_reading(text: Column) -> Column:
    """One line of prose: ligature bytes expanded, control characters to spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(expand_ligatures(text), CONTROL, " "), r"(?U)\s+", " "))


def clean_preformatted(text: Column, unglyph=lambda x: x) -> Column:
    """Line by line: names of glyphs and ligature bytes resolved, control characters and trailing space gone; no empty lines at the ends."""
    tidy = F.transform(F.split(unglyph(text), r"\r\n|[\n\r]"), lambda x: F.regexp_replace(F.regexp_replace(expand_ligatures(x), CONTROL, ""), r"(?U)\s+$", ""))
    return F.regexp_replace(F.array_join(tidy, "\n"), r"^\n+|\n+$", "")


def drop_rule_pipes(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, RULE_PIPE, " "), r"(?U)\s+", " "))


def escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def refilled(text: Column, reading: Column) -> Column:
    """The glyph layer's reading where the text is garbage and the reading isn't; else the text."""
    better = clean_reading(reading)
    return F.when(is_garbage(text) & (F.length(better) > 0) & ~is_garbage(better), better).otherwise(text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), 0)
