"""Equations: agreement with the text layer, tidying and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import bind

# Thresholds, LaTeX commands whose content or name is visible text, spacing commands.
RECOVER_BELOW, SCRAMBLED_ABOVE, HINT_LEAST = 0.9, 0.12, 0.5
TOKEN = "[A-Za-z0-9]{2,}"
WRAPPER = r"\\(?:text|mathrm|mathbf|mathit|operatorname)\s*\{([^{}]*)\}"
NAMED = r"\\(max|min|exp|log|ln|sin|cos|tan|det|lim|sup|inf|deg|arg|gcd)(?![a-zA-Z])"
STRUCTURE = r"\\[a-zA-Z]+|[_^{}\s]"
SPACE = r"(?:(?<!\\)\\(?:qquad|quad|[,;:! ])|~)"
LEFT, RIGHT = r"\\left(?![a-zA-Z])", r"\\right(?![a-zA-Z])"
OPEN, CLOSE = r"(?<!\\)\{", r"(?<!\\)\}"
EQUATION_BODY = r"(?ms)^\$\$\n(.*?)\n\$\$"


def latex_tokens(latex: Column) -> Column:
    """Distinct visible tokens of two characters or more."""
    for pattern, to in ((WRAPPER, "$1"), (NAMED, "$1"), (STRUCTURE, "")):
        latex = F.regexp_replace(latex, pattern, to)
    return F.array_distinct(F.regexp_extract_all(latex, F.lit(TOKEN), 0))


def agreement(latex: Column, text_layer: Column) -> Column:
    """The lesser of recall and precision of the tokens; null where the layer has fewer than three."""

    def sets(x: Column) -> Column:
        there = F.array_distinct(x["found"])
        common = F.size(F.array_intersect(there, x["said"]))
        return F.struct(F.size(x["found"]).alias("found"), F.size(there).alias("there"), F.size(x["said"]).alias("said"), common.alias("common"))

    def least(n: Column) -> Column:
        precision = F.when(n["said"] == 0, 1.0).otherwise(n["common"] / n["said"])
        return F.when(n["found"] >= 3, F.least(n["common"] / n["there"], precision))

    tokens = F.struct(F.regexp_extract_all(text_layer, F.lit(TOKEN), 0).alias("found"), latex_tokens(latex).alias("said"))
    return bind(bind(tokens, sets), least)


def reading_below(agreed: Column, text_layer: Column) -> Column:
    """The text layer on one line where an agreement already computed is too low, else null."""
    return F.when(agreed < RECOVER_BELOW, F.trim(F.regexp_replace(text_layer, r"(?U)\s+", " ")))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def balance_braces(body: Column) -> Column:
    def even(x: Column) -> Column:
        missing = lambda n: F.concat(F.repeat(F.lit("{"), F.greatest(-n, F.lit(0))), x, F.repeat(F.lit("}"), F.greatest(n, F.lit(0))))
        return bind(count(x, OPEN) - count(x, CLOSE), missing)

    return bind(body, even)


def balance_delimiters(body: Column) -> Column:
    return bind(body, lambda x: F.when(count(x, LEFT) != count(x, RIGHT), F.regexp_replace(x, f"{LEFT}|{RIGHT}", "")).otherwise(x))


def tidy(body: Column) -> Column:
    """Runs of spacing commands and empty cells collapsed, the tail cut, braces balanced."""
    body = F.regexp_replace(body, rf"(?:&\s*{SPACE}\s*){{2,}}", " & ")
    body = F.regexp_replace(body, rf"(?:{SPACE}|\s|\\|&)+$", "")
    body = F.regexp_replace(body, rf"{SPACE}(?:\s*{SPACE})+", r" \\\\quad ")
    return balance_braces(F.regexp_replace(body, r"(?U)^\s+|\s+$", ""))


def markup(text: Column) -> Column:
    """A display equation; what needs alignment is wrapped in an aligned environment."""

    def wrapped(x: Column) -> Column:
        aligned = F.concat(F.lit("\\begin{aligned}\n"), x, F.lit("\n\\end{aligned}"))
        return F.when(x.contains("&") | x.contains("\\\\"), aligned).otherwise(x)

    bare = F.regexp_replace(F.regexp_replace(text, r"^\$+|\$+$", ""), r"(?U)^\s+|\s+$", "")
    return F.concat(F.lit("$$\n"), bind(balance_delimiters(tidy(bare)), wrapped), F.lit("\n$$"))


def unbalanced(markdown: Column) -> Column:
    """Display equations with unequal braces, or unequal left and right delimiters."""
    bodies = F.regexp_extract_all(markdown, F.lit(EQUATION_BODY), 1)
    return F.size(F.filter(bodies, lambda x: (count(x, OPEN) != count(x, CLOSE)) | (count(x, LEFT) != count(x, RIGHT))))


def normalized(latex: Column) -> Column:
    """For comparison: tags, wrappers, spacing and delimiters gone, in lower case; null as empty.

    The separators 1C to 1F, which broken fonts leave for ligatures, are white space here.
    """
    out = F.regexp_replace(F.coalesce(latex, F.lit("")), r"\\tag\{[^}]*\}", "")
    for _ in range(3):  # wrappers nest
        out = F.regexp_replace(out, r"(?U)\\(?:text|operatorname|mathrm|mathbf|mathit|mathbb|boldsymbol|rm)[\s\x1c-\x1f]*\{?([^{}]*)\}?", "$1")
    out = F.regexp_replace(out, r"\\(sin|cos|tan|max|min|exp|log|ln)\b", "$1")
    out = F.replace(F.replace(out, F.lit("\\left"), F.lit("")), F.lit("\\right"), F.lit(""))
    return F.lower(F.regexp_replace(out, r"(?U)\\[,!;:> ]|[\s\x1c-\x1f]+", ""))


def latex_from_html(html: Column) -> Column:
    """The math elements' contents, else the text without tags, else null."""
    math = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<math[^>]*>(.*?)</math>"), 1), lambda x: F.trim(x)), lambda x: x != "")
    text = F.trim(F.regexp_replace(html, "<[^>]+>", ""))
    return F.when(F.size(math) > 0, F.array_join(math, " ")).otherwise(F.nullif(text, F.lit("")))
