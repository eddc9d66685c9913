"""Checks of finished outputs: signals, regressions against a baseline, labelled facts, equation similarity, benchmark sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import equations as e
from vellum.functions import repair
from vellum.functions import text as t

# Counts that must never rise, and what a residual ligature looks like.
INVARIANTS = ("dropped", "ligature_residual", "unbalanced_eq", "illegible", "illegible_table_rows")
RESIDUAL = t.SPLIT_LIGATURE


def markdown_signals(markdown: Column) -> dict[str, Column]:
    """Counts that are read off the markdown itself."""
    rows = F.filter(F.split(markdown, r"\r\n|[\n\r]"), lambda x: x.startswith("|"))
    return {"ligature_residual": F.regexp_count(markdown, F.lit(RESIDUAL)), "unbalanced_eq": e.unbalanced(markdown), "illegible_table_rows": F.size(F.filter(rows, t.is_garbage))}


def block_signals() -> dict[str, Column]:
    """The figures of an output's blocks, as aggregates over them."""
    equation, ocr = F.col("type") == "equation", F.coalesce("ocr", F.lit(False))
    prose = F.col("type").isin(*t.PROSE) & ~t.is_blank(F.col("text"))
    return {
        "blocks": F.count("*"), "dropped": F.count_if(F.col("status") == "dropped"), "lossless": F.count("*") == F.count_if(F.col("status").isin("emitted", "cropped", "flagged", "dropped")),
        "eq_total": F.count_if(equation), "eq_image_backed": F.count_if(equation & F.col("crop_path").isNotNull()), "ocr_pages": F.size(F.collect_set(F.when(ocr, F.col("page")))).cast("long"), "illegible": F.count_if(F.when(prose, t.is_garbage(F.col("text")))),
    }


def measured(outputs: DataFrame) -> DataFrame:
    """Outputs with the figures of their markdown in its place."""
    return outputs.withColumns(markdown_signals(F.col("markdown"))).drop("markdown")


def signals(blocks: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row for each output (doc_id, source, pages, tables, markdown), with the figures of its blocks.

    Keyed by source and doc_id, so that two documents of one file name both count. Where outputs are made of blocks in the same
    job, emit.files gives block_signals beside each body, and measured the rest, without a second pass.
    """
    return measured(outputs).join(blocks.groupBy("doc_id").agg(*[c.alias(n) for n, c in block_signals().items()]), "doc_id")


def compare(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(source, verdict, key, was, now): `new`, `missing`, and `regressed` for each invariant that rose and for lost losslessness."""
    keys = [*INVARIANTS, "lossless"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("source", F.lit(True).alias(f"in_{name}"), *[F.col(k).cast("long").alias(f"{name}_{k}") for k in keys])

    both = side(current, "now").join(side(baseline, "was"), "source", "full_outer")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(f"was_{k}", F.lit(0)).alias("was"), F.col(f"now_{k}").alias("now")) for k in keys])
    worse = F.filter(pairs, lambda p: F.when(p["key"] == "lossless", p["now"] < p["was"]).otherwise(p["now"] > p["was"]))
    lone = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("was"), F.lit(None).cast("long").alias("now")))
    verdict = F.when(F.col("in_was").isNull(), "new").when(F.col("in_now").isNull(), "missing").otherwise("regressed")
    return both.select("source", verdict.alias("verdict"), F.explode(F.when(verdict == "regressed", worse).otherwise(lone)).alias("p")).select("source", "verdict", "p.*")


def facts(outputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, fact, passed) for labels (source, must_contain, must_not_contain, min_legibility, confidence, min_ocr_pages); passed is null without an output."""
    j = labels.join(outputs.select("source", "markdown", "prose_legibility", F.col("confidence").alias("graded"), "ocr_pages"), "source", "left")

    def fact(name: Column, passed: Column) -> Column:
        return F.struct(name.alias("fact"), F.when(F.col("markdown").isNotNull(), F.coalesce(passed, F.lit(False))).alias("passed"))

    listed = [F.coalesce(F.transform(c, lambda s: fact(F.concat(F.lit(name), s), F.col("markdown").contains(s) == wanted)), F.expr("cast(array() as array<struct<fact:string,passed:boolean>>)")) for c, name, wanted in (("must_contain", "contains ", F.lit(True)), ("must_not_contain", "absent ", F.lit(False)))]
    single = [F.when(F.col(c).isNotNull(), fact(F.concat(F.lit(name), F.col(c).cast("string")), p)) for c, name, p in (("min_legibility", "legibility >= ", F.col("prose_legibility") >= F.col("min_legibility")), ("confidence", "confidence == ", F.col("graded") == F.col("confidence")), ("min_ocr_pages", "ocr_pages >= ", F.col("ocr_pages") >= F.col("min_ocr_pages")))]
    return j.select("source", F.explode(F.concat(*listed, F.array_compact(F.array(*single)))).alias("f")).select("source", "f.*")


def totals(facts: DataFrame) -> DataFrame:
    """Passed and total facts, and their whole percent."""
    judged = facts.where(F.col("passed").isNotNull())
    return judged.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total")).withColumn("percent", F.when(F.col("total") > 0, F.floor(100 * F.col("passed") / F.col("total"))))


def similarity(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """Labels (source, block_id, latex) with how like the truth the engine's text and the transcription are, and which is closer."""
    j = labels.join(blocks.select("source", "block_id", F.col("text").alias("engine"), "transcribed"), ["source", "block_id"], "left")
    names = ("latex", "engine", "transcribed")
    j = j.withColumns({f"_{c}": F.when(F.col(c).isNotNull() | F.lit(c == "latex"), e.normalized(F.col(c))) for c in names})
    found, truth = F.col("engine").isNotNull(), F.col("_latex")
    j = j.withColumns({f"{c}_ratio": F.when(found, repair.ratio(F.col(f"_{c}"), truth)) for c in names[1:]}).drop(*[f"_{c}" for c in names])
    better = F.when(F.col("transcribed_ratio") > F.col("engine_ratio"), "transcription").when(F.col("transcribed_ratio") < F.col("engine_ratio"), "engine").when(F.col("transcribed_ratio").isNotNull(), "tie")
    return j.withColumn("winner", better)


def similarity_totals(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg("engine_ratio").alias("engine_mean"), F.avg("transcribed_ratio").alias("transcribed_mean"), F.count("engine_ratio").alias("n"), F.count_if(F.col("winner") == "transcription").alias("helped"), F.count_if(F.col("engine_ratio").isNull()).alias("missing"))


def benchmark(results: DataFrame) -> DataFrame:
    """Pages, seconds and pages a second over the runs (pages, seconds, failed) that didn't fail."""
    good = results.where(~F.coalesce("failed", F.lit(False)))
    return good.agg(F.sum("pages").alias("pages"), F.sum("seconds").alias("seconds")).withColumn("pages_per_s", F.when(F.col("seconds") > 0, F.col("pages") / F.col("seconds")))
