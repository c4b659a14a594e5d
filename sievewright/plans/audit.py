"""The counterfactual audit from texts to a report: the same resumes under other names, scored with and without identity.

Each variant is structured once and de-identified in the same projection; the two arms are read off that row, so they
differ only in what a scorer can see. The variants of a case stay in one row until then, so that what they say alike of
their employment is read once. A variant that cannot be read or still identifies has no score and counts as failed
in its arm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Written
from . import bias
from . import profiles as pf

IDENTIFIED, BLIND = "identified", "anonymised"


def identified_view(profile: Column) -> Column:
    """What a scorer sees of an identified profile: the shape of the anonymised one, with name, place and institutions."""
    who = profile["identity"]
    header = F.nullif(F.concat_ws(", ", who["full_name"], who["suburb"], who["state"]), F.lit(""))
    summary = F.coalesce(F.concat_ws(". ", header, profile["summary"]), F.lit(""))
    return F.struct(
        F.nullif(summary, F.lit("")).alias("summary"), profile["skills"].alias("skills"), profile["experience"].alias("experience"), profile["total_years_experience"].alias("total_years_experience"),
        profile["universities"].alias("institution_tiers"), F.coalesce(who["suburb"], who["state"]).alias("region"), profile["work_rights"].alias("work_rights"),
        profile["languages"].alias("languages"), profile["affiliations"].alias("job_relevant_affiliations"), profile["certifications"].alias("certifications"),
    )


def blind_view(anonymised: Column) -> Column:
    names = ("summary", "skills", "experience", "total_years_experience", "institution_tiers", "region", "work_rights", "languages", "job_relevant_affiliations", "certifications")
    return F.struct(*[anonymised[n].alias(n) for n in names])


def scored_arms(cases: DataFrame, scorer: Callable[[Column], Column]) -> DataFrame:
    """(case_id, group, arm, score) of cases(case_id, variants), variants an array of struct(group, text); a null score has failed."""
    read = pf.deidentified(pf.structured_variants(cases.select("case_id", "variants"), "variants"), F.concat_ws(":", "case_id", "group"))
    seen = F.when(F.col("profile").isNotNull(), scorer(identified_view(F.col("profile")))).cast("double")
    blind = F.when(F.col("status") == "ready", scorer(blind_view(F.col("anonymised")))).cast("double")
    arms = F.array(F.struct(F.lit(IDENTIFIED).alias("arm"), seen.alias("score")), F.struct(F.lit(BLIND).alias("arm"), blind.alias("score")))
    return read.select("case_id", "group", F.explode(arms).alias("a")).select("case_id", "group", "a.arm", "a.score")


def audit_report(cases: DataFrame, scorer: Callable[[Column], Column]) -> DataFrame:
    """By arm: scored, failed, gap between group means, mean and largest spread within a case, the report in text, and
    how much smaller the gap is without identity. Scores are written once and read by every figure."""
    scores = Written(scored_arms(cases, scorer)).rows
    reports = bias.arm_reports(scores)
    means = scores.where("score is not null").groupBy("arm", "case_id", "group").agg(F.avg("score").alias("mean"))
    spread = means.groupBy("arm", "case_id").agg((F.max("mean") - F.min("mean")).alias("spread"), F.count("*").alias("n")).where("n > 1")
    spread = spread.groupBy("arm").agg(F.avg("spread").alias("mean_spread"), F.max("spread").alias("max_spread"))
    reduced = bias.gap_reduction(reports, IDENTIFIED, BLIND)
    # one row of figures
    return reports.join(spread, "arm", "left").join(F.broadcast(reduced.select("reduction", "reduction_pct")), F.lit(True))
