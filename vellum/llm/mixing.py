"""Mixing sources to target weights: repetition rates from sums per source, whole copies and a hash-seeded one more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import WORD, fresh, small_join

#: Weights of the sources in the order of their names, repeating; the mix takes SHARE of all sizes, a source at most MOST times its own.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = "mix-1"


def words(text: str = "text") -> Column:
    """Number of words in the text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target): targets in proportion to the weights, up to the limits.

    What exceeds MOST * source_size is shared out again by weight until no source is above. That ends at one level
    for all: a source gets min(its limit, level * weight). Sorted by limit / weight, the sources at their limit come
    first, so the level is found from running sums. The null source comes last. One row for each source; Spark sorts
    them in one task.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    limit = (F.col("source_size") * MOST).cast("double")
    w = sizes.withColumn("place", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    w = w.withColumn("weight", weight.cast("double")).withColumn("limit", limit)
    before = Window.orderBy(F.col("limit") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("rest", F.lit(SHARE) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    w = w.withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.col("rest") / F.col("weights_left"))
    # to fix at its limit a source that lies below the level raises the level for the rest, and one above it lowers it
    w = w.withColumn("stop", F.max("level").over(everything))
    return w.select("source", "source_size", F.least("limit", F.col("stop") * F.col("weight")).alias("target"))


def chance(*columns: str) -> Column:
    """A number in [0, 1) that the values and the seed fix: 32 bits of an MD5."""
    joined = F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(sized: DataFrame, by_source: DataFrame | None = None) -> DataFrame:
    """Adds source_size, target and copies to rows (doc_id, source, size, ...): how often the mix takes each row.

    copies = floor(rate), and one more with probability rate - floor(rate), where rate = target / source_size; the
    draw is a hash of doc_id and size, so reruns agree and repeated rows get the same number. A source without
    words has rate 0. Null source: a source of its own, the last one; null doc_id: drawn like another value. An
    empty table stays empty. Columns named source_size, target or copies are replaced.

    The draws are independent, so a source's taken words have a variance of the sum of size**2 * f * (1 - f), f the
    fraction of the rate: they come within a few hundredths of the target where a source has many documents, and may
    miss it by more where it has few or one very long one.
    """
    sized = sized.drop("source_size", "target", "copies")
    by_source = by_source or sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rated = small_join(sized, targets(by_source), "source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return rated.withColumn("copies", (whole + (chance("doc_id", "size") < rate - whole).cast("int")).cast("int"))


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say; rows with none go."""
    copy = fresh("copy", mixed)
    return mixed.where(F.col("copies") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).drop(copy)


MIX_SQL = rf"""
sized AS (
  SELECT *, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM docs
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM sums
), weighed AS (
  SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][place % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, CAST(source_size * {MOST} AS DOUBLE) AS lim FROM placed
), levels AS (
  SELECT *, ({SHARE} * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(lim) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev
  FROM weighed WINDOW b AS (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (
  SELECT *, max(lev) OVER () AS stop FROM levels
), targets AS (
  SELECT source, source_size, least(lim, stop * weight) AS target FROM stopped
), rated AS (
  SELECT sized.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), '-'), CAST(size AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), mixed AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CAST(draw < rate - floor(rate) AS BIGINT) AS copies FROM rated
)"""
