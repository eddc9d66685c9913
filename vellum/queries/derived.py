"""Inputs for the queries: the driver's tables with damage that Spark and DuckDB apply by the same expressions.

The tables hold no layout, so blocks are the lines of `documents`, and their type, page and damage follow from
doc_id and line number. Every document and every line takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The expressions are SQL that both engines read alike: no backslashes in strings, no negative operands of %.
KIND, DAMAGE = "(doc_id * 31 + seq * 17) % 23", "(doc_id + seq * 7) % 13"
BACK = "chr(92)"
BLOCK = {
    "block_id": f"CASE WHEN {KIND} = 9 THEN concat('#/tables/', CAST(seq AS STRING)) WHEN {KIND} = 10 THEN concat('#/pictures/', CAST(seq AS STRING)) ELSE concat('#/texts/', CAST(seq AS STRING)) END",
    "type": f"CASE WHEN {KIND} < 3 THEN 'heading' WHEN {KIND} = 3 THEN 'list' WHEN {KIND} = 4 THEN 'caption' WHEN {KIND} = 5 THEN 'equation' WHEN {KIND} = 6 THEN 'code' WHEN {KIND} = 7 THEN 'footnote' WHEN {KIND} = 8 THEN 'page_header' WHEN {KIND} = 9 THEN 'table' WHEN {KIND} = 10 THEN 'figure' WHEN {KIND} = 11 THEN 'other' ELSE 'paragraph' END",
    "text": f"CASE WHEN {DAMAGE} = 0 THEN '' WHEN {DAMAGE} = 1 THEN translate(line, 'abcdefghijklmnop', '①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯') WHEN {DAMAGE} = 2 THEN concat('di ff erent lo wdin ', line) WHEN {DAMAGE} = 3 THEN concat(CAST(1 + seq % 4 AS STRING), '.', CAST(1 + seq % 3 AS STRING), ' ', line)"
    f" WHEN {DAMAGE} = 4 THEN concat('Chapter ', CAST(1 + seq % 9 AS STRING)) WHEN {DAMAGE} = 5 THEN concat('con', chr(28), 'rm ', line, chr(21), ' /a114 /a80') WHEN {DAMAGE} = 6 THEN concat('$ ', {BACK}, 'max_{{i}} + ', {BACK}, 'text{{', line, '}} ', {BACK}, 'quad ', {BACK}, 'quad & = {{x ', {BACK}, 'left( y $')"
    f" WHEN {DAMAGE} = 7 THEN concat('*****', chr(10), line, chr(10), '| a | b |', chr(10), '-----') ELSE line END".replace("{{", "{").replace("}}", "}"),
    "page": "CAST(floor(seq / 5.0) AS INT) + 1",
    "confidence": f"CASE WHEN {KIND} = 5 THEN (doc_id + seq) % 10 / 10.0e0 END",
    "level": f"CASE WHEN {KIND} < 3 THEN CAST(seq % 3 AS INT) END",
    "ocr": "(doc_id + CAST(floor(seq / 5.0) AS INT)) % 7 = 0",
    "crop_path": f"CASE WHEN {KIND} IN (5, 9) AND (doc_id + seq) % 3 = 0 THEN concat('assets/', CAST(seq AS STRING), '.png') END",
}
LINES_SQL = "SELECT doc_id, CAST(g - 1 AS INT) AS seq, parts[g] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), UNNEST(range(1, len(parts) + 1)) AS t(g)"
BLOCKS_SQL = f"lines AS ({LINES_SQL}), blocks AS (SELECT doc_id, seq, line, {', '.join(f'{e} AS {n}' for n, e in BLOCK.items())} FROM lines)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr("doc_id", "seq", "line", *[f"{e} AS {n}" for n, e in BLOCK.items()])


PITCH, LEADING = 6.0, 15.0


def glyphs_of(texts: DataFrame, line: str = "text") -> DataFrame:
    """(doc_id, page, draw_idx, ch, l, b, r, t) of texts (doc_id, page, seq, line, top): a glyph for each character, in a fixed pitch.

    The lines of a text stand below each other from `top` on; seq orders texts by drawing.
    """
    rows = texts.select("doc_id", "page", "seq", "top", F.posexplode(F.split(line, "\n")).alias("_n", "_line")).where("_line <> ''")
    each = rows.select("doc_id", "page", "seq", "_n", (F.col("top") - F.col("_n") * LEADING).alias("b"), F.posexplode(F.split("_line", "")).alias("k", "ch"))
    at = F.col("k").cast("double") * PITCH
    order = (F.col("seq").cast("long") * 1000 + F.col("_n")) * 10_000_000 + F.col("k")
    return each.select("doc_id", "page", order.alias("draw_idx"), "ch", at.alias("l"), "b", (at + PITCH).alias("r"), (F.col("b") + 10).alias("t"))


def runs_of(texts: DataFrame, line: str = "text") -> DataFrame:
    """The glyphs of glyphs_of as runs (doc_id, page, draw_idx, text, l, b, r, t, advance), one for each line."""
    rows = texts.select("doc_id", "page", "seq", "top", F.posexplode(F.split(line, "\n")).alias("_n", "text")).where("text <> ''")
    b = F.col("top") - F.col("_n") * LEADING
    order = (F.col("seq").cast("long") * 1000 + F.col("_n")) * 10_000_000
    return rows.select("doc_id", "page", order.alias("draw_idx"), "text", F.lit(0.0).alias("l"), b.alias("b"), F.lit(PITCH).alias("r"), (b + 10).alias("t"), F.lit(PITCH).alias("advance"))


def box_of(line: str = "text") -> Column:
    """The box of such a text, as wide as its longest line."""
    parts = F.split(line, "\n")
    wide = F.array_max(F.transform(parts, lambda x: F.length(x))) * PITCH
    return F.struct(F.lit(0.0).alias("x0"), (F.col("top") - (F.size(parts) - 1) * LEADING).alias("y0"), wide.alias("x1"), (F.col("top") + 10).alias("y1"))


# What DuckDB's regular expressions lack is written out: no lookaround, ASCII word characters.
WORD = r"[\p{L}\p{N}_]"


def gone(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"


def strip(x: str) -> str:
    return gone(x, r"^\s+|\s+$")


SUBSTITUTE = r"[\x{2460}-\x{27BF}\x{E000}-\x{F8FF}\x{FFFD}]"


def legibility(x: str) -> str:
    bare = gone(x, "/a[0-9]+")
    letters, suspect = count(bare, r"\p{L}"), f"({count(x, '/a[0-9]+')} + {count(bare, SUBSTITUTE)})"
    return f"CASE WHEN {letters} + {suspect} = 0 THEN 1.0e0 ELSE {letters} / CAST({letters} + {suspect} AS DOUBLE) END"


def garbage(x: str) -> str:
    return f"({legibility(x)}) < 0.6"


PROSE_SQL = "('paragraph', 'heading', 'list', 'caption', 'footnote', 'other')"


def depth(x: str, level: str) -> str:
    number = f"regexp_extract({x}, '^\\s*([0-9]+(?:\\.[0-9]+)*)\\s', 1)"
    return f"CAST(least(CASE WHEN {number} <> '' THEN length({number}) - length(replace({number}, '.', '')) + 1 WHEN {level} >= 1 THEN {level} ELSE 1 END, 6) AS INT)"


def title(x: str) -> str:
    return f"trim({gone(f'regexp_replace(lower(trim({x})), {chr(39)}^(?:(?:part|chapter|appendix)\\s+(?:[0-9]+|[ivxlcdm]+)\\b[.:]?\\s*|(?:[0-9]+|[ivxlcdm]+)\\b\\s+){chr(39)}, {chr(39)}{chr(39)})', '[^a-z0-9]+', ' ')})"


LABEL_SQL = r"(?i)^(?:chapter|part|appendix)\s+(?:[0-9]+|[ivxlcdm]+|[a-z])\.?$"


def anchor(x: str) -> str:
    return gone(gone(f"lower(trim({x}))", rf"[^\p{{L}}\p{{N}}_\s-]"), r"\s+", "-")


def slug(x: str) -> str:
    bare = gone(f"trim({gone(f'lower({x})', rf'[^{WORD[1:-1]}\s-]')})", r"[\s_-]+", "-")
    return f"coalesce(nullif({gone(f'substr({bare}, 1, 50)', '^-+|-+$')}, ''), 'section')"


SPACE = r"(?:\\(?:qquad|quad|[,;:! ])|~)"


def markup(x: str) -> str:
    """Display markup of text without doubled backslashes or escaped braces, of which the derived blocks have none."""
    body = strip(gone(gone(gone(strip(gone(x, r"^\$+|\$+$")), rf"(?:&\s*{SPACE}\s*){{2,}}", " & "), rf"(?:{SPACE}|\s|\\|&)+$"), rf"{SPACE}(?:\s*{SPACE})+", r" \\\\quad "))
    o, c = count(body, r"\{"), count(body, r"\}")
    even = f"concat(repeat('{{', greatest({c} - {o}, 0)), {body}, repeat('}}', greatest({o} - {c}, 0)))"
    left, right = r"\\left([^a-zA-Z]|$)", r"\\right([^a-zA-Z]|$)"
    free = f"CASE WHEN {count(even, left)} <> {count(even, right)} THEN {gone(gone(even, left, r'\1'), right, r'\1')} ELSE {even} END"
    return f"(SELECT CASE WHEN contains(b, '&') THEN concat('$$', chr(10), chr(92), 'begin{{aligned}}', chr(10), b, chr(10), chr(92), 'end{{aligned}}', chr(10), '$$') ELSE concat('$$', chr(10), b, chr(10), '$$') END FROM (SELECT {free} AS b))".replace("{{", "{").replace("}}", "}")


def displayed(x: str) -> str:
    return f"concat('$$', chr(10), {x}, chr(10), '$$')"


def unbalanced(x: str) -> str:
    """How many display equations have unequal braces or delimiters; the derived blocks have no escaped braces."""
    left, right = r"\\left([^a-zA-Z]|$)", r"\\right([^a-zA-Z]|$)"
    body = rf"regexp_extract_all({x}, '(?ms)^\$\$\n(.*?)\n\$\$', 1)"
    return f"CAST(coalesce(len(list_filter({body}, lambda b: {count('b', '[{]')} <> {count('b', '[}]')} OR {count('b', left)} <> {count('b', right)})), 0) AS INT)"
