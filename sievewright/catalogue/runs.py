"""Runs: screening, outcomes, scores, shortlists, ensembles and the audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ranking, screening
from ..plans.fields import condition, count_where, field, where
from ..plans.screening import Rule
from ..sources.candidates import profiles, table
from .registry import CANDIDATES, query

KEY = "candidate_ref"
STATES = ("eligible", "needs_manual_review", "excluded", "withdrawn")


def rules() -> list[Rule]:
    return [
        Rule("years", condition("years", ">=", 4)),
        Rule("rights", condition("work_rights", "in", ["citizen", "permanent_resident", "unrestricted"])),
        Rule("roles", count_where("role", ">=", 2, where("role", "months", ">=", 60))),
    ]


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.outcomes(profiles(spark, sf_dir, with_roles=True), rules())


_SCREEN = f"""{CANDIDATES},
c AS (SELECT candidate_ref, count(*) FILTER (WHERE months >= 60) AS low, count(*) FILTER (WHERE months >= 60) + count(*) FILTER (WHERE months IS NULL) AS high FROM r GROUP BY candidate_ref),
t AS (SELECT p.candidate_ref, years >= 4 AS a, (CASE WHEN rights IS NOT NULL THEN coalesce(unrestricted, false) OR rights IN ('citizen', 'permanent_resident') END) AS b, CASE WHEN (low >= 2) = (high >= 2) THEN low >= 2 END AS c FROM p LEFT JOIN c ON c.candidate_ref = p.candidate_ref),
o AS (SELECT candidate_ref, CASE WHEN NOT (a AND b AND c) THEN 'excluded' WHEN (a AND b AND c) IS NULL THEN 'needs_manual_review' ELSE 'eligible' END AS outcome FROM t)"""


@query(f"{_SCREEN} SELECT candidate_ref, outcome FROM o")
def q_screen_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir)


@query(
    f"{_SCREEN} SELECT candidate_ref, 'years' AS rule_id, a AS value FROM t UNION ALL SELECT candidate_ref, 'rights', b FROM t UNION ALL SELECT candidate_ref, 'roles', c FROM t"
)
def q_screen_rules_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen(profiles(spark, sf_dir, with_roles=True), rules()).select(KEY, "rule_id", "value")


@query(f"{_SCREEN} SELECT s.outcome, count(o.candidate_ref) AS n FROM (VALUES ('eligible'), ('needs_manual_review'), ('excluded'), ('withdrawn')) AS s(outcome) LEFT JOIN o ON o.outcome = s.outcome GROUP BY s.outcome")
def q_outcome_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.counts_by(screened(spark, sf_dir), "outcome", list(STATES))


@query(
    f"{CANDIDATES} SELECT CASE WHEN v THEN 'matched' WHEN NOT v THEN 'not_matched' ELSE 'indeterminate' END AS bucket, count(*) AS n FROM (SELECT years >= 6 AND unrestricted AS v FROM p) GROUP BY 1"
)
def q_query_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = condition("years", ">=", 6) & condition("work_rights", "is", "unrestricted")
    return screening.query(profiles(spark, sf_dir), wanted).groupBy("bucket").agg(F.count("*").alias("n"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_ref, run_id, position and score of all candidates."""
    years = F.coalesce(ranking.depth_score(field("years"), 10), F.lit(0.0))
    parts = [
        (ranking.clause_score(condition("years", ">=", 6).value), 3),
        (ranking.clause_score(condition("work_rights", "is", "citizen").value, F.lit(0.5)), 2),
        (years, 1.5),
    ]
    people = profiles(spark, sf_dir)
    return people.select(KEY, (F.col(KEY) % 3).alias("run_id"), F.col(KEY).alias("position"), ranking.weighted_score(parts).alias("score"))


_SCORED = f"""{CANDIDATES},
w AS (SELECT candidate_ref, candidate_ref % 3 AS run_id, CASE WHEN years >= 6 THEN 1.0::DOUBLE ELSE 0.0 END AS a, CASE WHEN rights = 'citizen' THEN 1.0::DOUBLE WHEN rights IS NULL THEN 0.5 ELSE 0.0 END AS b,
CASE WHEN years IS NULL THEN 0 ELSE least(1.0::DOUBLE, years / 10) * 0.8::DOUBLE + least(0.2::DOUBLE, greatest(0.0::DOUBLE, (years - 10) / 20.0::DOUBLE)) END AS c FROM p),
x AS (SELECT candidate_ref, run_id, round(least(greatest((a * 3.0::DOUBLE + b * 2.0::DOUBLE + c * 1.5::DOUBLE) / 6.5::DOUBLE, 0), 1), 4) AS score FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, candidate_ref) AS rank, count(*) OVER (PARTITION BY run_id) AS n FROM x)"""


@query(f"{_SCORED} SELECT candidate_ref, score FROM x")
def q_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(KEY, "score")


@query(f"{_SCORED} SELECT run_id, candidate_ref, score, rank, CASE WHEN rank <= 10 THEN 'shortlist' ELSE 'below_cutoff' END AS section FROM k")
def q_rank_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.shortlist(scored(spark, sf_dir), 10).select("run_id", KEY, "score", "rank", "section")


@query(f"{_SCORED} SELECT run_id, candidate_ref, score, rank FROM k WHERE rank > 10")
def q_below_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.shortlist(scored(spark, sf_dir), 10).where("section = 'below_cutoff'").select("run_id", KEY, "score", "rank")


@query(f"{_SCORED} SELECT candidate_ref, score FROM x ORDER BY score DESC, candidate_ref LIMIT 10")
def q_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(scored(spark, sf_dir), 10).select(KEY, "score")


@query(f"{_SCORED}, c AS (SELECT run_id, score AS cutoff FROM k WHERE rank = 10 AND n > 10) SELECT k.run_id, candidate_ref, score, rank FROM k JOIN c ON k.run_id = c.run_id WHERE abs(score - cutoff) <= 0.08")
def q_borderline_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.borderline(scored(spark, sf_dir), 10, 0.08).select("run_id", KEY, "score", "rank")


@query(f"{_SCORED} SELECT k.candidate_ref, rank, c_name AS full_name FROM k LEFT JOIN customer ON k.candidate_ref = c_custkey WHERE rank <= 10")
def q_identity_reattached(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ranking.shortlist(scored(spark, sf_dir), 10).where("section = 'shortlist'")
    identities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(KEY), F.col("c_name").alias("full_name"))
    return ranking.with_identity(chosen, identities).select(KEY, "rank", "full_name")


@query(f"{_SCREEN} SELECT p.candidate_ref, p.years AS total_years_experience FROM p SEMI JOIN (SELECT * FROM o WHERE outcome <> 'excluded') e ON e.candidate_ref = p.candidate_ref")
def q_eligible_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = screened(spark, sf_dir).where("outcome <> 'excluded'")
    return profiles(spark, sf_dir).join(left, KEY, "left_semi").select(KEY, "total_years_experience")


@query(f"{_SCORED} SELECT candidate_ref, CASE WHEN rights IS NOT NULL AND score >= 0.5 THEN score ELSE 0.0 END AS score FROM x JOIN p USING (candidate_ref)")
def q_upsert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those whose work rights are stated are scored again."""
    old = scored(spark, sf_dir).select(KEY, F.lit(0.0).alias("score"))
    stated = profiles(spark, sf_dir).where(field("work_rights").isNotNull()).select(KEY)
    new = scored(spark, sf_dir).join(stated, KEY, "left_semi").select(KEY, F.when(F.col("score") >= 0.5, F.col("score")).alias("score"))
    return screening.upsert_results(old, new, [KEY])


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, member and score: the members of an ensemble are the event types."""
    by = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("member"))
    return by.agg(F.max("value").alias("score"))


_VOTES = "WITH v AS (SELECT user_id, event_type AS member, max(value) AS score FROM events GROUP BY 1, 2)"


@query(f"{_VOTES} SELECT user_id, round(median(score), 4) AS median_score, count(*) AS members, round(max(score) - min(score), 4) AS spread FROM v GROUP BY user_id")
def q_ensemble_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ensemble(votes(spark, sf_dir), ["user_id"], F.lit(100.0)).select("user_id", "median_score", "members", "spread")


@query(
    f"{_VOTES} SELECT user_id, count(*) FILTER (WHERE score >= 100)::BIGINT AS include_votes, 2 * count(*) FILTER (WHERE score >= 100) > count(*) AS majority, count(*) FILTER (WHERE score >= 100) IN (0, count(*)) AS unanimous FROM v GROUP BY user_id"
)
def q_votes_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ensemble(votes(spark, sf_dir), ["user_id"], F.lit(100.0)).select("user_id", "include_votes", "majority", "unanimous")


@query(
    f"{_VOTES}, m AS (SELECT user_id, median(score) AS m FROM v GROUP BY user_id), d AS (SELECT v.user_id, member, row_number() OVER (PARTITION BY v.user_id ORDER BY abs(score - m), member) AS k FROM v JOIN m ON v.user_id = m.user_id) SELECT user_id, member AS representative FROM d WHERE k = 1"
)
def q_representative_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ensemble(votes(spark, sf_dir), ["user_id"], F.lit(100.0)).select("user_id", "representative")


@query(
    "SELECT subject, stage, event FROM (SELECT CAST(user_id AS VARCHAR) AS subject, 'run' AS stage, event_type AS event, ts AS happened, event_id FROM events WHERE event_type IN ('error', 'signup') "
    "UNION ALL SELECT CAST(user_id AS VARCHAR), 'batch', event_type, ts, event_id FROM events WHERE event_type = 'view') ORDER BY happened, event_id LIMIT 2000"
)
def q_audit_trail_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest 2,000 rows of a run's and its batch's trail; the limit is that of an audit read."""
    events = table(spark, sf_dir, "events")

    def part(stage, kinds):
        chosen = events.where(F.col("event_type").isin(*kinds))
        return chosen.select(F.col("user_id").cast("string").alias("subject"), F.lit(stage).alias("stage"), F.col("event_type").alias("event"), F.col("ts").alias("at"), "event_id")

    trail = part("run", ["error", "signup"]).unionByName(part("batch", ["view"]))
    return trail.orderBy("at", "event_id").limit(2000).select("subject", "stage", "event")
