"""Resumes written from the tables and read back: structuring, de-identification, identity swaps.

A customer's orders of one year are the roles of a resume. What its text is read back as is known from
the tables, so the SQL says it without reading any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import resume as rs
from ..plans import audit
from ..plans import profiles as pf
from ..sources.candidates import table
from .registry import query

#: Titles, employers and tasks of the roles, by priority of the order.
TITLES = {"1-URGENT": "Head of Delivery", "2-HIGH": "Senior Engineer", "3-MEDIUM": "Engineer", "4-NOT SPECIFIED": "Graduate Analyst", "5-LOW": "Junior Clerk"}
LEVELS = {"1-URGENT": "head", "2-HIGH": "senior", "3-MEDIUM": None, "4-NOT SPECIFIED": "graduate", "5-LOW": "junior"}


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_ref, full_name and text."""
    people = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.initcap(F.concat_ws(" ", F.lower("c_mktsegment"), F.lower("n_name")))
    orders = table(spark, sf_dir, "orders")
    title = F.element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), F.col("o_orderpriority"))
    end = F.when(F.col("o_orderstatus") == "P", F.lit("Present")).otherwise(F.date_format(F.add_months("o_orderdate", (F.col("o_orderkey") % 30).cast("int")), "MMM yyyy"))
    dates = F.concat(F.lit("Harbour Bank, "), F.date_format("o_orderdate", "MMM yyyy"), F.lit(" - "), end)
    task = F.concat(F.lit("Led a team of "), (F.col("o_orderkey") % 90 + 1).cast("string"))
    job = F.struct(F.col("o_orderkey").alias("job_order"), title.alias("job_title"), dates.alias("duration_str"), F.array(task).alias("tasks"))
    jobs = orders.groupBy("o_custkey").agg(F.collect_list(job).alias("jobs"))
    joined = people.join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("name", name)
    # few bytes, from which Spark would make few tasks, but much work for each: writing the texts and reading them
    joined = joined.repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    empty = F.array().cast(jobs.schema["jobs"].dataType)
    place = F.when(F.col("c_custkey") % 2 == 0, "University of Queensland, Australia, 2011")
    text = rs.rendered(F.col("name"), F.coalesce("jobs", empty), institution=place, suburb=F.when(F.col("c_custkey") % 3 == 0, "Ascot"))
    text = F.concat(text, F.lit("\n\nSKILLS\nKafka, Spark; Flink\n\nAFFILIATIONS\nIEEE, chess club\n\nHolds full work rights. 2 months notice"))
    return joined.select(F.col("c_custkey").alias("candidate_ref"), F.col("name").alias("full_name"), text.alias("text"))


#: What the resumes say, from the tables. The tables' names of nations have one word or two.
_SAID = """WITH who AS (SELECT c_custkey AS candidate_ref, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS full_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
job AS (SELECT o_custkey AS candidate_ref, o_orderpriority AS p, o_orderstatus = 'P' AS current, o_orderkey % 90 + 1 AS team, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 30 END AS months FROM orders),
j AS (SELECT candidate_ref, count(*) AS roles, count(*) FILTER (WHERE current) AS current_roles, sum(months) AS months, max(team) AS team, count(*) FILTER (WHERE p = '1-URGENT') AS heads, count(*) FILTER (WHERE p = '2-HIGH') AS seniors,
sum(months) FILTER (WHERE p = '1-URGENT') AS managed FROM job GROUP BY candidate_ref)"""


@query(
    f"{_SAID} SELECT who.candidate_ref, full_name, CASE WHEN candidate_ref % 3 = 0 THEN 'Ascot' END AS suburb, CASE WHEN candidate_ref % 3 = 0 THEN 'QLD' END AS state, "
    "CAST(coalesce(roles, 0) AS INTEGER) AS roles, CAST(coalesce(current_roles, 0) AS INTEGER) AS current_roles, CAST(months AS DOUBLE) AS months, CAST(team AS INTEGER) AS team, CAST(coalesce(heads, 0) AS INTEGER) AS heads, CAST(coalesce(seniors, 0) AS INTEGER) AS seniors, "
    "round(CAST(managed AS DOUBLE) / 12, 1) AS management_years, CASE WHEN candidate_ref % 2 = 0 THEN 7 END AS aqf_level, 3 AS skills, 'visa_unrestricted' AS status, 8.0::DOUBLE AS notice FROM who LEFT JOIN j USING (candidate_ref)"
)
def q_structured_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of profiles read from rendered resumes."""
    read = pf.structured_profiles(resumes(spark, sf_dir))
    p = F.col("profile")
    months = F.filter(F.transform(p["experience"], lambda r: r["months"]), lambda m: m.isNotNull())
    return read.select(
        "candidate_ref", p["identity"]["full_name"].alias("full_name"), p["identity"]["suburb"].alias("suburb"), p["identity"]["state"].alias("state"), F.size(p["experience"]).alias("roles"),
        F.size(F.filter(p["experience"], lambda r: r["is_current"])).alias("current_roles"), F.when(F.size(months) > 0, F.aggregate(months, F.lit(0.0), lambda a, b: a + b)).alias("months"),
        p["people_managed_max"].alias("team"), F.size(F.filter(p["experience"], lambda r: r["seniority"] == "head")).alias("heads"),
        F.size(F.filter(p["experience"], lambda r: r["seniority"] == "senior")).alias("seniors"), p["management_years"].alias("management_years"),
        F.array_max(F.transform(p["qualifications"], lambda q: q["aqf_level"])).alias("aqf_level"), F.size(p["skills"]).alias("skills"), p["work_rights"]["status"].alias("status"), p["availability_weeks"].alias("notice"),
    )


@query(
    f"{_SAID} SELECT who.candidate_ref, 'ready' AS status, CASE WHEN candidate_ref % 3 = 0 THEN 'Greater Brisbane / South East Queensland' END AS region, "
    "CASE WHEN candidate_ref % 2 = 0 THEN 'Australian university (Group of Eight)' END AS tier, CAST(6 + CASE WHEN candidate_ref % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN candidate_ref % 2 = 0 THEN 3 ELSE 0 END AS INTEGER) AS redactions, 0 AS leaks FROM who"
)
def q_deidentified_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of whom: name, e-mail, telephone and three lines of affiliations are noted for all."""
    out = pf.deidentified(pf.structured_profiles(resumes(spark, sf_dir)), F.col("candidate_ref").cast("string"))
    a = F.col("anonymised")
    return out.select("candidate_ref", "status", a["region"].alias("region"), F.get(a["institution_tiers"], F.lit(0)).alias("tier"), F.size("redactions").alias("redactions"), F.size("leaks").alias("leaks"))


@query(f"{_SAID} SELECT candidate_ref, 0 AS old_name, 1 AS new_name, 'jane.roe@email.com' AS email, candidate_ref % 2 = 0 AS moved FROM who")
def q_identity_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterfactual variants: another name, e-mail and institution in the same resume."""
    made = resumes(spark, sf_dir).withColumn("text", pf.swapped(F.col("text"), F.col("full_name"), F.lit("Jane Roe"), institution=F.lit("Hill College")))
    return made.select(
        "candidate_ref", F.regexp_count(F.lower("text"), F.lower(F.col("full_name"))).alias("old_name"), F.regexp_count("text", F.lit("Jane Roe")).alias("new_name"),
        F.regexp_extract("text", rs.EMAIL, 0).alias("email"), F.contains("text", F.lit("Hill College, Australia, 2011")).alias("moved"),
    )


#: Who takes the place of the candidate in each group.
NAMES = {"A": "Ann Lee", "B": "Bob Ray", "C": "Cyd Day"}


@query(
    "WITH v AS (SELECT c_custkey, g, least(1.0::DOUBLE, coalesce(n, 0) / 40.0::DOUBLE) AS s FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey, (VALUES ('A'), ('B'), ('C')) AS t(g)), "
    "a AS (SELECT c_custkey, g, arm, CASE WHEN c_custkey % 50 > 0 THEN s + CASE WHEN arm = 'identified' AND g = 'A' THEN 0.1::DOUBLE WHEN arm = 'identified' AND g = 'B' THEN 0.025::DOUBLE ELSE 0 END END AS score FROM v, (VALUES ('identified'), ('anonymised')) AS t(arm)), "
    "m AS (SELECT arm, g, avg(score) AS mean FROM a GROUP BY 1, 2), k AS (SELECT arm, c_custkey, max(score) - min(score) AS spread FROM a WHERE score IS NOT NULL GROUP BY 1, 2) "
    "SELECT arm, (SELECT count(score) FROM a AS x WHERE x.arm = m.arm) AS scored, (SELECT count(*) - count(score) FROM a AS x WHERE x.arm = m.arm) AS failed, round(max(mean) - min(mean), 6) AS gap, "
    "(SELECT round(avg(spread), 6) FROM k WHERE k.arm = m.arm) AS mean_spread, 100.0::DOUBLE AS reduction_pct FROM m GROUP BY arm"
)
def q_counterfactual_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every resume under three names, scored by somebody who likes one name more than another, with and without identity;
    one resume in fifty is cut so short that it cannot be read."""
    given = resumes(spark, sf_dir)

    def variant(text, group):
        return F.struct(group.alias("group"), F.when(F.col("candidate_ref") % 50 == 0, F.substring(text, 1, 60)).otherwise(text).alias("text"))

    texts = pf.swapped_all(F.col("text"), F.col("full_name"), F.array(*map(F.lit, NAMES.values())))
    variants = F.zip_with(texts, F.array(*map(F.lit, NAMES)), variant)
    cases = given.select(F.col("candidate_ref").alias("case_id"), variants.alias("variants"))

    def scorer(p):
        liked = F.when(F.contains(p["summary"], F.lit("Ann")), 0.1).when(F.contains(p["summary"], F.lit("Bob")), 0.025).otherwise(0.0)
        return F.least(F.lit(1.0), F.size(p["experience"]) / F.lit(40.0)) + liked

    report = audit.audit_report(cases, scorer)
    return report.select("arm", "scored", "failed", F.round("gap", 6).alias("gap"), F.round("mean_spread", 6).alias("mean_spread"), F.round("reduction_pct", 6).alias("reduction_pct"))
