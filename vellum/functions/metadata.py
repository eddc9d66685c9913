"""Bibliographic data in a first page's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers and years; digits are ASCII, as in headings.
DOI = r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+"
YEAR = r"\b(?:19|20)[0-9]{2}\b"
PREPRINT = r"(?<![0-9])([0-9]{2})(?:0[1-9]|1[0-2])\.[0-9]{4,5}(?![0-9])"
AUTHORS = r"\s*(?:;|,| and )\s*"
PREPRINTS_SINCE = 7


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def preprint_year(*sources: Column) -> Column:
    """From the first source whose identifier has a year since the scheme began."""
    years = [found(s, PREPRINT, 1) for s in sources]
    return F.coalesce(*[F.when(y.cast("int") >= PREPRINTS_SINCE, F.concat(F.lit("20"), y)) for y in years])


def year(text: Column, file_name: Column) -> Column:
    """The page's first year, or the identifier's where that is later or alone."""
    page, known = found(text, YEAR), preprint_year(file_name, text)
    return F.when(known.isNotNull() & (page.isNull() | (known > page)), known).otherwise(page)


def doi(text: Column) -> Column:
    return found(text, DOI)


def authors(said: Column) -> Column:
    names = F.filter(F.split(F.trim(said), AUTHORS), lambda x: x != "")
    return F.when(F.size(names) > 0, names)
