"""Site-relative line dedup: a line that more than a share of a site's pages carry is boilerplate there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, fresh, small_join

#: A line goes if it stands in more than RATIO of its site's pages, and in LEAST pages at least: on a site of fewer than
#: 1 / RATIO pages each line of a single page exceeds the ratio, and nothing would be left.
RATIO, LEAST = 0.02, 4


def line_key(line: Column) -> Column:
    """What stands for a line, without its outer spaces: two hashes."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b"))


def distinct_pages(pages: DataFrame, site: str, text: str) -> DataFrame:
    """(site, lines): the keys of the lines of each distinct text of a site, by two hashes of the text; null texts are one.

    Hashes of lines are shuffled and no text is.
    """
    # the expressions of the split stay outside the lambdas, where Spark evaluates them once
    lines = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != ""), line_key))
    keyed = pages.select(F.col(site).alias("site"), F.xxhash64(text).alias("h"), F.hash(text).alias("g"), lines.alias("lines"))
    return keyed.groupBy("site", "h", "g").agg(F.first("lines").alias("lines")).select("site", "lines")


def boilerplate(pages: DataFrame, site: str, scratch: Scratch, text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """One row (site, lines) for each site with boilerplate: the keys of the lines that it drops.

    Each page counts a line once, and each text of a site counts as one page however many copies of it there are, so
    that copies don't turn their own content into boilerplate. A site with P pages
    and L distinct lines a page has L / ratio such lines at most, whatever P is, so that the array is bounded.
    """
    own = scratch.table(distinct_pages(pages, site, text), "pages")
    seen = own.select("site", F.explode("lines").alias("line"))
    counts = seen.groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    totals = scratch.table(own.groupBy("site").agg(F.count("*").alias("pages")), "totals")
    common = small_join(counts, totals, "site").where(F.col("n") > F.col("pages") * F.lit(ratio))
    return scratch.table(common.groupBy("site").agg(F.collect_list("line").alias("lines")), "boilerplate")


def drop_lines(pages: DataFrame, site: str, scratch: Scratch, text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """pages with the text freed of its site's boilerplate lines, `_lines` before and `_dropped` lines.

    All rows stay. A null site is a site; a null or empty text stays as it is and its page counts; blank lines are
    never dropped; two equal lines of one page go or stay together. Repeated texts of a site count as one page.
    Columns named _lines or _dropped are replaced; an empty table stays empty. The site may be any column: `source` in
    documents, which have no url, the host of the url in pages.
    """
    pages = pages.drop("_lines", "_dropped")
    bad, split, left = fresh("_boilerplate", pages), fresh("_split", pages), fresh("_kept", pages)
    found = boilerplate(pages, site, scratch, text, ratio, least).select(F.col("site").alias(site), F.col("lines").alias(bad))
    out = small_join(pages, found, site).withColumn(split, F.split(F.col(text), "\n"))
    kept = F.filter(split, lambda x: ~F.array_contains(F.col(bad), line_key(x)))
    out = out.withColumn(left, F.when(F.col(bad).isNull(), F.col(split)).otherwise(kept))
    out = out.withColumn("_lines", F.coalesce(F.size(split), F.lit(0)))
    out = out.withColumn("_dropped", F.coalesce(F.size(split) - F.size(left), F.lit(0)))
    return out.withColumn(text, F.when(F.col("_dropped") > 0, F.array_join(left, "\n")).otherwise(F.col(text))).drop(bad, split, left)


LINES_SQL = f"""
split AS (
  SELECT *, string_split(text, chr(10)) AS parts FROM docs
), pages AS (
  SELECT DISTINCT source, text, parts FROM split
), seen AS (
  SELECT source, unnest(list_distinct(list_filter(list_transform(parts, lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line FROM pages
), totals AS (
  SELECT source, count(*) AS pages FROM pages GROUP BY source
), common AS (
  SELECT seen.source, line FROM seen JOIN totals ON seen.source IS NOT DISTINCT FROM totals.source
  GROUP BY seen.source, line, pages HAVING count(*) >= {LEAST} AND count(*) > pages * {RATIO}::DOUBLE
), boilerplate AS (
  SELECT source, list(line) AS bad FROM common GROUP BY source
), cleaned AS (
  SELECT split.*, CASE WHEN bad IS NULL THEN parts ELSE list_filter(parts, lambda x: NOT list_contains(bad, trim(x, ' '))) END AS keep
  FROM split LEFT JOIN boilerplate ON split.source IS NOT DISTINCT FROM boilerplate.source
)"""
