"""Counterfactual bias reports: variants that differ in identity alone, and the gaps between groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counterfactuals(cases: DataFrame, groups: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Every case in every group (and context). Groups and contexts are dimensions of a few rows."""
    out = cases.join(F.broadcast(groups), F.lit(True))
    return out if contexts is None else out.join(F.broadcast(contexts), F.lit(True))


def group_statistics(scores: DataFrame, group: str = "group", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, sample deviation (null for one) and number by group."""
    return scores.groupBy(*by, group).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("stdev"), F.count("*").alias("n"))


def group_gap(statistics: DataFrame, group: str = "group", by: tuple[str, ...] = ()) -> DataFrame:
    """The gap between the best and the worst mean, and whose they are (the first of equals)."""
    return statistics.groupBy(*by).agg(
        (F.max("mean") - F.min("mean")).alias("gap"),
        F.min(F.struct((-F.col("mean")).alias("m"), F.col(group).alias("g")))["g"].alias("highest"),
        F.min(F.struct(F.col("mean").alias("m"), F.col(group).alias("g")))["g"].alias("lowest"),
    )


def within_case_spread(scores: DataFrame, case: str = "case_id", group: str = "group", score: str = "score") -> DataFrame:
    """Mean and largest range of group means within a case, over cases with more than one group."""
    means = scores.groupBy(case, group).agg(F.avg(score).alias("mean"))
    spread = means.groupBy(case).agg((F.max("mean") - F.min("mean")).alias("spread"), F.count("*").alias("n")).where("n > 1")
    return spread.agg(F.avg("spread").alias("mean_spread"), F.max("spread").alias("max_spread"), F.count("*").alias("cases"))


def gap_reduction(gaps: DataFrame, before: str, after: str, arm: str = "arm") -> DataFrame:
    """How much smaller the gap of one arm is than that of the other, in points and per cent."""
    first = F.max(F.when(F.col(arm) == before, F.col("gap")))
    second = F.max(F.when(F.col(arm) == after, F.col("gap")))
    out = gaps.agg(first.alias("gap_before"), second.alias("gap_after"))
    return out.withColumn("reduction", F.col("gap_before") - F.col("gap_after")).withColumn("reduction_pct", F.try_divide(F.col("reduction") * 100, F.col("gap_before")))


def arm_reports(scores: DataFrame, *, arm: str = "arm", group: str = "group", score: str = "score") -> DataFrame:
    """By arm: scored, failed (rows without a score), gap, and a report in text, groups from the best mean
    to the worst. Groups are few; their statistics are what is gathered."""
    stats = group_statistics(scores.where(F.col(score).isNotNull()), group, score, (arm,))
    lines = F.sort_array(F.collect_list(F.struct((-F.col("mean")).alias("m"), F.col(group).alias("g"), F.format_string("    %-3s n=%3d mean=%.4f", group, "n", "mean").alias("line"))))
    told = stats.groupBy(arm).agg(F.transform(lines, lambda x: x["line"]).alias("lines"))
    gaps = group_gap(stats, group, (arm,))
    counts = scores.groupBy(arm).agg(F.count(score).alias("scored"), F.count_if(F.col(score).isNull()).alias("failed"))
    joined = counts.join(told, arm, "left").join(gaps, arm, "left")
    head = F.format_string("[%s] scored=%d failed=%d", arm, "scored", "failed")
    end = F.format_string("    group gap = %.4f (%s - %s)", "gap", "highest", "lowest")
    text = F.array_join(F.concat(F.array(head), F.coalesce("lines", F.array().cast("array<string>")), F.when(F.col("gap").isNotNull(), F.array(end)).otherwise(F.array().cast("array<string>"))), "\n")
    return joined.select(arm, "scored", "failed", "gap", text.alias("report"))
