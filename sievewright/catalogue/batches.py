"""Batches, runs and criteria: overviews, pages, searches, second reads and breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import batches, criteria, ranking, screening
from ..plans.criteria import Criterion
from ..plans.fields import condition, field
from ..sources.candidates import profiles, table
from .corpus import WORDINGS
from .registry import CANDIDATES, query
from .runs import _SCORED, scored

KEY = "candidate_ref"


@query(
    "SELECT n_nationkey AS batch_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS candidates, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS runs FROM nation"
)
def q_batch_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are batches, customers candidates, suppliers runs."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("batch_id"))
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("batch_id"))
    return batches.overview(nations, people, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("batch_id")))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 26")
def q_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 25 and one more; the limit is the feature."""
    return batches.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 100, 25)


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def q_stage_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage that takes the segment from customers in debt."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    stage = people.where("c_acctbal < 0").select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"))
    return batches.staged(people.drop("c_acctbal"), stage, "c_custkey", ("c_mktsegment",))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no urgent order refers to."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return batches.orphans(table(spark, sf_dir, "customer").select("c_custkey"), urgent, "c_custkey")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%red%' OR p_type ILIKE '%red%'")
def q_run_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.search(table(spark, sf_dir, "part"), "RED", ["p_name", "p_type"]).select("p_partkey")


@query("SELECT c_custkey AS candidate_ref FROM customer ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 50")
def q_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty by reference as text; the limit is the feature."""
    return batches.in_text_order(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(KEY)), KEY, 50)


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, ts FROM events ORDER BY ts, event_id LIMIT 2000) ORDER BY ts DESC, event_id DESC LIMIT 20")
def q_audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 of the oldest 2,000 rows; both limits are those of the audit read."""
    return batches.tail(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["ts", "event_id"], 20).select("event_id", "event_type")


@query(
    f"{_SCORED}, c AS (SELECT run_id, score AS cutoff FROM k WHERE rank = 10 AND n > 10), b AS (SELECT k.candidate_ref FROM k JOIN c ON k.run_id = c.run_id WHERE abs(score - cutoff) <= 0.08) "
    "SELECT candidate_ref FROM x WHERE candidate_ref IN (SELECT candidate_ref FROM b) OR candidate_ref IN (SELECT candidate_ref FROM p WHERE rights IS NULL)"
)
def q_second_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates near the cut and those whose work rights are not stated."""
    scores = scored(spark, sf_dir)
    unsure = profiles(spark, sf_dir).where(field("work_rights").isNull()).select(KEY)
    return batches.second_read(scores, ranking.borderline(scores, 10, 0.08), unsure, [KEY])


@query(f"{_SCORED} SELECT run_id, score AS cutoff FROM k WHERE rank = least(25, n)")
def q_ensemble_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.cutoffs(ranking.ranked(scored(spark, sf_dir)), 25)


@query(
    f"{CANDIDATES} SELECT candidate_ref, CASE WHEN NOT EXISTS (SELECT 1 FROM r WHERE r.candidate_ref = p.candidate_ref) THEN 'skipped' WHEN years >= 6 AND rights = 'citizen' THEN 'matched' "
    "WHEN NOT (years >= 6 AND rights = 'citizen') THEN 'not_matched' ELSE 'indeterminate' END AS bucket FROM p"
)
def q_query_with_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without a role have no profile to ask; they are skipped and said so."""
    wanted = condition("years", ">=", 6) & condition("work_rights", "is", "citizen")
    has_roles = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias(KEY)).distinct().withColumn("known", F.lit(True))
    asked = profiles(spark, sf_dir).join(has_roles, KEY, "left")
    bucket = F.when(F.col("known").isNull(), "skipped").when(wanted.value, "matched").when(~wanted.value, "not_matched").otherwise("indeterminate")
    return asked.select(KEY, bucket.alias("bucket"))


@query(
    f"{CANDIDATES}, b AS (SELECT candidate_ref, CASE WHEN rights = 'citizen' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS a, CASE WHEN years IS NULL THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, least(1.0::DOUBLE, years / 8.0) * 0.8::DOUBLE + least(0.2::DOUBLE, greatest(0.0::DOUBLE, (years - 8.0) / 20.0::DOUBLE))), 3) END AS d, CAST(years AS INTEGER) AS y, rights FROM p) "
    "SELECT candidate_ref, round((a * 2.0 + d * 2.0) / 4.0, 4) AS score, CASE WHEN y IS NULL THEN 'Years of professional experience not stated in the resume.' ELSE y || ' years of professional experience.' END AS evidence, "
    "CASE WHEN a >= d THEN 'citizen' ELSE 'experience_depth' END AS strongest FROM b"
)
def q_criteria_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference that a rule decides, and depth of experience."""
    prefer = Criterion("citizen", 2.0, condition("work_rights", "is", "citizen"))
    depth, said = criteria.depth(field("years"), 8.0)
    parts = criteria.breakdown([(prefer, None, None), (Criterion("experience_depth", 2.0), depth, said)])
    made = profiles(spark, sf_dir).select(KEY, parts.alias("parts"))
    strongest = F.regexp_extract(criteria.rationale(F.col("parts")), "^Strongest on ([a-z_]+):", 1)
    return made.select(KEY, criteria.overall(F.col("parts")).alias("score"), F.col("parts")[1]["evidence"].alias("evidence"), strongest.alias("strongest"))


#: Which wordings are risky, told by hand.
_FLAGS = {0: ("native_speaker", "high"), 2: ("cultural_fit", "high"), 3: ("recent_graduate", "high"), 4: ("local_experience", "review"), 6: ("physical_ability", "review"), 7: ("career_gap", "high"), 8: ("employer_prestige", "review"), 10: ("age_coded", "high"), 11: ("citizenship_only", "review")}
_TRAIL = [(k, "rule_risky" if _FLAGS.get(k, ("", ""))[1] == "high" else "rule_applicable", _FLAGS.get(k, ("", "none"))[1]) for k in range(len(WORDINGS))]
_TRAIL += [(k, "rule_risk_flagged", name) for k, (name, _) in _FLAGS.items()]


@query("SELECT CAST(p_partkey AS BIGINT) AS rule_id, t.event, t.detail FROM part JOIN (VALUES " + ", ".join(f"({k}, '{e}', '{d}')" for k, e, d in _TRAIL) + f") AS t(wording, event, detail) ON t.wording = p_size % {len(WORDINGS)}")
def q_rule_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of the rules that parts stand for, each worded as its size says; what is found in a wording is told by hand in the SQL."""
    worded = F.element_at(F.array(*map(F.lit, WORDINGS)), F.col("p_size").cast("int") % len(WORDINGS) + 1)
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("rule_id"), worded.alias("wording"))
    return batches.rule_trail(rules, F.lit(None).cast("timestamp")).select("rule_id", "event", "detail")


_RULES = "SELECT p_partkey AS rule_id, CASE WHEN p_retailprice > 1000 THEN 'require' ELSE 'prefer' END AS kind, CASE WHEN p_size > 40 THEN 'risky' WHEN p_size > 30 THEN 'unmappable' ELSE 'applicable' END AS verdict, p_size > 5 AS parsed FROM part"


@query(
    f"WITH r AS ({_RULES}), a AS (SELECT * FROM r WHERE verdict = 'applicable' AND parsed) SELECT 'applied' AS view, rule_id FROM a UNION ALL SELECT 'requirements', rule_id FROM a WHERE kind = 'require' "
    "UNION ALL SELECT 'preferences', rule_id FROM a WHERE kind = 'prefer' UNION ALL SELECT 'flagged', rule_id FROM r WHERE verdict = 'risky'"
)
def q_rule_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are rules; price and size make their kind and verdict."""
    size = F.col("p_size")
    kind = F.when(F.col("p_retailprice") > 1000, "require").otherwise("prefer")
    verdict = F.when(size > 40, "risky").when(size > 30, "unmappable").otherwise("applicable")
    return screening.rule_views(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), kind.alias("kind"), verdict.alias("verdict"), (size > 5).alias("parsed")))
