"""Conditions on profiles: leaves, connectives, records, aggregates, named fields and reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verdicts as v
from ..plans.fields import aggregate_where, any_where, condition, count_where, field, where
from ..sources.candidates import profiles, table
from .registry import CANDIDATES, query

KEY = "candidate_ref"


def _on_profiles(where: str) -> str:
    return f"{CANDIDATES} SELECT candidate_ref, {where} AS verdict FROM p"


def _on_roles(where: str) -> str:
    """A verdict per candidate from an aggregate of its roles; none for those without roles."""
    return f"{CANDIDATES} SELECT p.candidate_ref, (SELECT CASE WHEN count(*) > 0 THEN {where} END FROM r WHERE r.candidate_ref = p.candidate_ref) AS verdict FROM p"


@query(_on_profiles("years >= 6"))
def q_compare_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select(KEY, condition("years_experience", ">=", 6).value.alias("verdict"))


@query(f"{CANDIDATES} SELECT candidate_ref, years >= 6 AS ge, years <= 6 AS le, years > 6 AS gt, years < 6 AS lt, years = 6 AS eq, years <> 6 AS ne FROM p")
def q_compare_ops6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = {">=": "ge", "<=": "le", ">": "gt", "<": "lt", "=": "eq", "!=": "ne"}
    return profiles(spark, sf_dir).select(KEY, *[condition("years", op, 6).value.alias(name) for op, name in ops.items()])


@query("SELECT p_partkey, contains(lower(p_name), 'red widget deluxe') OR contains('red widget deluxe', lower(p_name)) AS verdict, NOT (contains(lower(p_name), 'widget') OR contains('widget', lower(p_name))) AS differs FROM part")
def q_text_loose_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    equal = v.text_equals(name, "Red Widget Deluxe", "part")
    differs = v.text_equals(name, "widget", "part", negate=True)
    return table(spark, sf_dir, "part").select("p_partkey", equal.value.alias("verdict"), differs.value.alias("differs"))


@query("SELECT p_partkey, contains(lower(p_name), 'red') OR contains(lower(p_name), 'bolt') AS verdict FROM part")
def q_text_has_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", v.text_has(F.col("p_name"), ["Red", "bolt"], "part").value.alias("verdict"))


@query("SELECT p_partkey, contains(lower(p_name), 'red') AND contains(lower(p_name), 'bolt') AS verdict FROM part")
def q_text_has_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", v.text_has(F.col("p_name"), ["Red", "bolt"], "part", every=True).value.alias("verdict"))


@query(_on_profiles("rights = 'citizen'"))
def q_enum_is(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select(KEY, condition("work_rights", "is", "citizen").value.alias("verdict"))


@query(_on_profiles("rights IN ('citizen', 'permanent_resident')"))
def q_enum_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select(KEY, condition("work_rights", "in", ["citizen", "permanent_resident"]).value.alias("verdict"))


@query(_on_profiles("rights <> 'citizen'"))
def q_enum_not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select(KEY, condition("work_rights", "!=", "citizen").value.alias("verdict"))


@query(f"{CANDIDATES} SELECT candidate_ref, CASE WHEN rights IS NOT NULL THEN unrestricted END AS unrestricted, CASE WHEN rights IS NULL THEN NULL WHEN unrestricted THEN true ELSE rights = 'requires_sponsorship' END AS either FROM p")
def q_work_rights_unrestricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select(
        KEY, condition("work_rights", "is", "unrestricted").value.alias("unrestricted"), condition("work_rights", "in", ["unrestricted", "requires_sponsorship"]).value.alias("either")
    )


@query(_on_roles("bool_or(is_current) = true"))
def q_bool_is_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir, with_roles=True, role_fields=("is_current",)).select(KEY, condition("has_current_role", "is", True).value.alias("verdict"))


@query(_on_roles("bool_or(title = '1-URGENT') OR bool_or(title = '2-HIGH')"))
def q_list_has_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir, with_roles=True, role_fields=("title",)).select(KEY, condition("role_titles", "has any", ["urgent", "2-HIGH"]).value.alias("verdict"))


@query(_on_roles("bool_or(title = '1-URGENT') AND bool_or(title = '2-HIGH')"))
def q_list_has_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir, with_roles=True, role_fields=("title",)).select(KEY, condition("role_titles", "has all", ["urgent", "2-HIGH"]).value.alias("verdict"))


@query(_on_profiles("CAST(NULL AS BOOLEAN)"))
def q_empty_list_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select(KEY, condition("certifications", "has any", ["AWS"]).value.alias("verdict"))


@query(_on_profiles("years >= 6 AND rights = 'citizen'"))
def q_kleene_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = condition("years", ">=", 6) & condition("work_rights", "is", "citizen")
    return profiles(spark, sf_dir).select(KEY, both.value.alias("verdict"))


@query(_on_profiles("years >= 6 OR rights = 'citizen'"))
def q_kleene_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    either = condition("years", ">=", 6) | condition("work_rights", "is", "citizen")
    return profiles(spark, sf_dir).select(KEY, either.value.alias("verdict"))


@query(_on_profiles("NOT (years >= 6)"))
def q_kleene_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select(KEY, (~condition("years", ">=", 6)).value.alias("verdict"))


_UNKNOWN = "'The resume does not state {}, so this rule could not be applied. Routed to manual review.'"
_YEARS = (
    "CASE WHEN years IS NULL THEN " + _UNKNOWN.format("years of professional experience") + " ELSE 'Candidate has ' || CAST(CAST(years AS BIGINT) AS VARCHAR) || "
    "' years of professional experience; the rule requires at least 6 years. This ' || CASE WHEN years >= 6 THEN 'meets' ELSE 'does not meet' END || ' the requirement.' END"
)
_RIGHTS = "CASE WHEN rights IS NULL THEN " + _UNKNOWN.format("work rights status") + " ELSE 'Work rights status is ' || rights || '; the rule requires citizen.' END"


@query(f"{CANDIDATES} SELECT candidate_ref, {_YEARS} AS reason FROM p")
def q_reason_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select(KEY, condition("years", ">=", 6).reason.alias("reason"))


@query(
    f"{CANDIDATES}, t AS (SELECT candidate_ref, years >= 6 AS a, rights = 'citizen' AS b, {_YEARS} AS ra, {_RIGHTS} AS rb FROM p) "
    "SELECT candidate_ref, CASE WHEN NOT a THEN ra WHEN NOT b THEN rb ELSE CASE WHEN a IS NULL AND b IS NULL THEN ra || ' ' || rb WHEN a IS NULL THEN ra WHEN b IS NULL THEN rb ELSE ra || ' ' || rb END END AS reason FROM t"
)
def q_reason_and_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = condition("years", ">=", 6) & condition("work_rights", "is", "citizen")
    return profiles(spark, sf_dir).select(KEY, both.reason.alias("reason"))


@query(
    f"{CANDIDATES}, t AS (SELECT candidate_ref, years >= 6 AS a, rights = 'citizen' AS b, {_YEARS} AS ra, {_RIGHTS} AS rb FROM p) "
    "SELECT candidate_ref, CASE WHEN a THEN ra WHEN b THEN rb WHEN a IS NULL AND b IS NULL THEN 'Could not decide an alternative: ' || ra || ' ' || rb "
    "WHEN a IS NULL THEN 'Could not decide an alternative: ' || ra WHEN b IS NULL THEN 'Could not decide an alternative: ' || rb "
    "ELSE 'None of the alternatives were met: (a) ' || ra || '; (b) ' || rb END AS reason FROM t"
)
def q_reason_or_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    either = condition("years", ">=", 6) | condition("work_rights", "is", "citizen")
    return profiles(spark, sf_dir).select(KEY, either.reason.alias("reason"))


# ---------------------------------------------------------------- records and aggregates


def _months(least: float):
    return where("role", "months", ">=", least)


@query(_on_roles("bool_or(months >= 90 AND seniority = 'senior')").replace("bool_or(months >= 90 AND seniority = 'senior')", "CASE WHEN count(*) FILTER (WHERE months >= 90 AND seniority = 'senior') > 0 THEN true WHEN count(*) > count(*) FILTER (WHERE (months >= 90 AND seniority = 'senior') IS NOT NULL) THEN NULL ELSE false END"))
def q_any_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = any_where("role", _months(90) & where("role", "seniority", "is", "senior"))
    return profiles(spark, sf_dir, with_roles=True, role_fields=("months", "seniority", "employment_type")).select(KEY, found.value.alias("verdict"))


_LOW, _HIGH = "count(*) FILTER (WHERE months >= 60)", "(count(*) FILTER (WHERE months >= 60) + count(*) FILTER (WHERE months IS NULL))"


@query(_on_roles(f"CASE WHEN ({_LOW} >= 3) = ({_HIGH} >= 3) THEN {_LOW} >= 3 END"))
def q_count_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir, with_roles=True, role_fields=("months", "seniority", "employment_type")).select(KEY, count_where("role", ">=", 3, _months(60)).value.alias("verdict"))


@query(
    f"{CANDIDATES} SELECT p.candidate_ref, (SELECT CASE WHEN count(*) > 0 AND ({_LOW} = 3) = ({_HIGH} = 3) THEN {_LOW} = 3 END FROM r WHERE r.candidate_ref = p.candidate_ref) AS both_ends, "
    f"(SELECT CASE WHEN count(*) > 0 AND ({_LOW} = 3) = ({_HIGH} = 3) AND NOT ({_LOW} < 3 AND {_HIGH} > 3) THEN {_LOW} = 3 END FROM r WHERE r.candidate_ref = p.candidate_ref) AS strict FROM p"
)
def q_count_equals_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (count_where("role", "=", 3, _months(60), strict=s) for s in (False, True))
    return profiles(spark, sf_dir, with_roles=True, role_fields=("months", "seniority", "employment_type")).select(KEY, one.value.alias("both_ends"), two.value.alias("strict"))


def _aggregate(spark, sf_dir, func, op, target, test=None):
    found = aggregate_where(func, "role", "months", op, target, test)
    return profiles(spark, sf_dir, with_roles=True, role_fields=("months", "seniority", "employment_type")).select(KEY, found.value.alias("verdict"))


@query(_on_roles("CASE WHEN count(months) = count(*) THEN sum(months) >= 400 WHEN coalesce(sum(months), 0) >= 400 AND count(months) > 0 THEN true END"))
def q_sum_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregate(spark, sf_dir, "sum", ">=", 400)


@query(_on_roles("CASE WHEN count(months) = count(*) THEN max(months) >= 90 WHEN max(months) >= 90 THEN true END"))
def q_max_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregate(spark, sf_dir, "max", ">=", 90)


@query(_on_roles("CASE WHEN count(months) = count(*) THEN min(months) <= 10 END"))
def q_min_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregate(spark, sf_dir, "min", "<=", 10)


@query(_on_roles("CASE WHEN count(months) = count(*) THEN round(avg(months), 2) >= 50 END"))
def q_avg_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregate(spark, sf_dir, "avg", ">=", 50)


@query(
    _on_roles(
        "CASE WHEN count(*) FILTER (WHERE employment_type = 'permanent' AND months IS NULL) + count(*) FILTER (WHERE employment_type IS NULL) = 0 THEN coalesce(sum(months) FILTER (WHERE employment_type = 'permanent'), 0) >= 100 "
        "WHEN coalesce(sum(months) FILTER (WHERE employment_type = 'permanent'), 0) >= 100 THEN true END"
    )
)
def q_sum_agg_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregate(spark, sf_dir, "sum", ">=", 100, where("role", "employment_type", "is", "permanent"))


# ---------------------------------------------------------------- named fields


@query(
    f"{CANDIDATES} SELECT p.candidate_ref, sum(months) AS total_role_months, max(months) AS longest_role_months, min(months) AS shortest_role_months, "
    "round(sum(months) / count(months), 1) AS average_role_months FROM p LEFT JOIN r ON r.candidate_ref = p.candidate_ref GROUP BY p.candidate_ref"
)
def q_named_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("total_role_months", "longest_role_months", "shortest_role_months", "average_role_months")
    return profiles(spark, sf_dir, with_roles=True).select(KEY, *map(field, names))


@query(
    f"{CANDIDATES} SELECT p.candidate_ref, CAST(nullif(count(role_id), 0) AS BIGINT) AS role_count, CAST(CASE WHEN count(role_id) > 0 THEN count(*) FILTER (WHERE is_current) END AS BIGINT) AS current_role_count, "
    "CAST(CASE WHEN count(role_id) > 0 THEN count(*) FILTER (WHERE seniority = 'executive') END AS BIGINT) AS leadership_role_count, "
    "CAST(CASE WHEN count(role_id) > 0 THEN count(*) FILTER (WHERE employment_type = 'contract') END AS BIGINT) AS contract_role_count, "
    "CAST(CASE WHEN count(role_id) > 0 THEN count(*) FILTER (WHERE employment_type = 'permanent') END AS BIGINT) AS permanent_role_count FROM p LEFT JOIN r ON r.candidate_ref = p.candidate_ref GROUP BY p.candidate_ref"
)
def q_named_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("role_count", "current_role_count", "leadership_role_count", "contract_role_count", "permanent_role_count")
    return profiles(spark, sf_dir, with_roles=True).select(KEY, *[field(n).cast("long").alias(n) for n in names])


@query(
    f"{CANDIDATES}, x AS (SELECT *, row_number() OVER (PARTITION BY candidate_ref ORDER BY is_current DESC, began DESC, role_id) AS k FROM r) "
    "SELECT p.candidate_ref, x.title AS latest_role_title, x.months AS latest_role_months, x.seniority AS latest_seniority FROM p LEFT JOIN x ON x.candidate_ref = p.candidate_ref AND k = 1"
)
def q_latest_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir, with_roles=True).select(KEY, *map(field, ("latest_role_title", "latest_role_months", "latest_seniority")))


@query(
    f"{CANDIDATES}, x AS (SELECT candidate_ref, max(CASE seniority WHEN 'graduate' THEN 1 WHEN 'junior' THEN 2 WHEN 'mid' THEN 3 WHEN 'senior' THEN 4 WHEN 'executive' THEN 10 END) AS k FROM r GROUP BY candidate_ref) "
    "SELECT p.candidate_ref, CASE k WHEN 1 THEN 'graduate' WHEN 2 THEN 'junior' WHEN 3 THEN 'mid' WHEN 4 THEN 'senior' WHEN 10 THEN 'executive' END AS highest_seniority FROM p LEFT JOIN x ON x.candidate_ref = p.candidate_ref"
)
def q_highest_seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir, with_roles=True, role_fields=("seniority",)).select(KEY, field("highest_seniority"))


@query(
    f"{CANDIDATES} SELECT p.candidate_ref, CAST(nullif(count(name), 0) AS BIGINT) AS skill_count, CAST(nullif(count(*) FILTER (WHERE category IN ('tool', 'technical')), 0) AS BIGINT) AS technical_skill_count, "
    "max(s.years) AS max_skill_years, CAST(nullif(count(DISTINCT lower(name)) FILTER (WHERE category IN ('tool', 'technical')), 0) AS BIGINT) AS technology_count FROM p LEFT JOIN s ON s.candidate_ref = p.candidate_ref GROUP BY p.candidate_ref"
)
def q_technologies_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = profiles(spark, sf_dir, with_skills=True)
    counts = [field(n).cast("long").alias(n) for n in ("skill_count", "technical_skill_count", "technology_count")]
    return named.select(KEY, *counts, field("max_skill_years"))


@query(
    f"{CANDIDATES} SELECT candidate_ref, clearance AS security_clearance, CASE WHEN clearance <> '' THEN true END AS has_clearance, management AS management_years, "
    "CASE WHEN management <> 0 THEN true END AS has_management_experience, rights = 'requires_sponsorship' AS requires_sponsorship FROM p"
)
def q_named_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("security_clearance", "has_clearance", "management_years", "has_management_experience", "requires_sponsorship")
    return profiles(spark, sf_dir).select(KEY, *map(field, names))


def _one(name: str):
    """A list field as one text of its items in order, whatever their order in the list."""
    return F.array_join(F.array_sort(field(name)), "|").alias(name)


def _agg(column: str, where: str = "true") -> str:
    return f"string_agg({column}, '|' ORDER BY {column}) FILTER (WHERE {where} AND {column} IS NOT NULL)"


_LEVEL = "CASE k % 4 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 9 END"


@query(
    f"SELECT k AS candidate_ref, nullif(k % 4, 0) AS language_count, CASE k % 4 WHEN 1 THEN 'English' WHEN 2 THEN 'English|Hindi' WHEN 3 THEN 'English|French|Hindi' END AS languages, CASE WHEN k % 4 > 0 THEN k % 4 >= 2 END AS multilingual, "
    "nullif(k % 3, 0) AS certification_count, CASE k % 3 WHEN 1 THEN 'AWS Certified' WHEN 2 THEN 'AWS Certified|CISSP' END AS certifications, CASE WHEN k % 3 > 0 THEN true END AS has_certifications, "
    "nullif(k % 2, 0) AS licence_count, CASE WHEN k % 2 = 1 THEN 'Forklift' END AS licences, CASE WHEN k % 2 = 1 THEN true END AS has_licence, "
    "nullif(k % 3, 0) AS project_count, CASE k % 3 WHEN 1 THEN 'Project 1' WHEN 2 THEN 'Project 1|Project 2' END AS project_names, CASE k % 3 WHEN 1 THEN 'Flink' WHEN 2 THEN 'Flink|Flink|Kafka' END AS project_technologies, CASE WHEN k % 3 > 0 THEN true END AS has_projects, "
    "CASE WHEN k % 5 > 0 THEN k % 5 - 1 END AS publications_count, CASE WHEN k % 5 > 0 THEN k % 5 > 1 END AS has_publications, CASE WHEN k % 7 > 3 THEN k % 7 END AS people_managed_max, CASE WHEN k % 6 > 0 THEN k % 6 END AS availability_weeks "
    "FROM (SELECT c_custkey AS k FROM customer)"
)
def q_named_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields on languages, certificates, licences, projects and publications."""
    people = profiles(spark, sf_dir, with_extras=True)
    counts = [field(n).cast("long").alias(n) for n in ("language_count", "certification_count", "licence_count", "project_count", "publications_count", "people_managed_max", "availability_weeks")]
    flags = [field(n) for n in ("multilingual", "has_certifications", "has_licence", "has_projects", "has_publications")]
    return people.select(KEY, *counts, *flags, *map(_one, ("languages", "certifications", "licences", "project_names", "project_technologies")))


@query(
    f"SELECT k AS candidate_ref, {_LEVEL} AS aqf, nullif(k % 4, 0) AS qualification_count, CASE WHEN k % 4 > 0 THEN k % 4 - 1 END AS degree_count, {_LEVEL} >= 7 AS has_degree, {_LEVEL} >= 8 AS has_postgraduate, {_LEVEL} >= 9 AS has_masters, {_LEVEL} >= 10 AS has_doctorate, "
    "CASE k % 4 WHEN 1 THEN 'Diploma of IT' WHEN 2 THEN 'Bachelor of Arts' WHEN 3 THEN 'Master of IT' END AS highest_qualification, CASE k % 4 WHEN 1 THEN 'Diploma of IT' WHEN 2 THEN 'Bachelor of Arts|Diploma of IT' WHEN 3 THEN 'Bachelor of Arts|Diploma of IT|Master of IT' END AS qualification_titles, "
    "CASE k % 4 WHEN 1 THEN 'IT' WHEN 2 THEN 'Arts|IT' WHEN 3 THEN 'Arts|IT' END AS fields_of_study, CASE k % 4 WHEN 1 THEN 'Diploma' WHEN 2 THEN 'Bachelor Degree|Diploma' WHEN 3 THEN 'Bachelor Degree|Diploma|Masters Degree' END AS aqf_labels "
    "FROM (SELECT c_custkey AS k FROM customer)"
)
def q_named_qualifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = profiles(spark, sf_dir, with_extras=True)
    counts = [field(n).cast("long").alias(n) for n in ("aqf", "qualification_count", "degree_count")]
    plain = [field(n) for n in ("has_degree", "has_postgraduate", "has_masters", "has_doctorate", "highest_qualification")]
    return people.select(KEY, *counts, *plain, *map(_one, ("qualification_titles", "fields_of_study", "aqf_labels")))


@query(
    f"{CANDIDATES}, e AS (SELECT *, CASE WHEN role_id % 4 > 0 THEN 'Employer ' || role_id % 4 END AS employer, CASE role_id % 3 WHEN 0 THEN 'Banking' WHEN 1 THEN 'retail' END AS industry, row_number() OVER (PARTITION BY candidate_ref, is_current ORDER BY began DESC, role_id) AS nth, "
    "row_number() OVER (PARTITION BY candidate_ref, is_current, months IS NOT NULL ORDER BY began DESC, role_id) AS nth_stated FROM r) "
    f"SELECT p.candidate_ref, {_agg('title')} AS role_titles, {_agg('title', 'is_current')} AS current_role_titles, {_agg('employer')} AS employers, {_agg('industry')} AS industries, {_agg('employment_type')} AS employment_types, {_agg('seniority')} AS seniorities, "
    "nullif(count(DISTINCT industry), 0) AS industry_count, max(title) FILTER (WHERE is_current AND nth = 1) AS current_role_title, max(months) FILTER (WHERE is_current AND nth_stated = 1) AS current_role_months, "
    "CASE WHEN bool_or(is_current) THEN max(employment_type) FILTER (WHERE is_current AND nth = 1) ELSE max(employment_type) FILTER (WHERE nth = 1) END AS latest_employment_type, bool_or(is_current) AS has_current_role, "
    "CAST(max(CASE seniority WHEN 'graduate' THEN 1 WHEN 'junior' THEN 2 WHEN 'mid' THEN 3 WHEN 'senior' THEN 4 WHEN 'executive' THEN 10 END) AS BIGINT) AS seniority_level, "
    "CASE WHEN count(role_id) = 0 THEN NULL WHEN bool_or(role_id % 2 = 1) THEN 'kafka|spark' ELSE 'kafka' END AS technologies FROM p LEFT JOIN e ON e.candidate_ref = p.candidate_ref GROUP BY p.candidate_ref"
)
def q_named_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields on roles: lists, the current and the latest one, technologies that differ in case alone."""
    people = profiles(spark, sf_dir, with_roles=True)
    lists = map(_one, ("role_titles", "current_role_titles", "employers", "industries", "employment_types", "seniorities"))
    plain = [field(n) for n in ("current_role_title", "current_role_months", "latest_employment_type", "has_current_role")]
    tools = F.array_join(F.array_sort(F.transform(field("technologies"), F.lower)), "|").alias("technologies")
    return people.select(KEY, *lists, *plain, field("industry_count").cast("long").alias("industry_count"), field("seniority_level").cast("long").alias("seniority_level"), tools)


@query(
    f"{CANDIDATES} SELECT p.candidate_ref, " + ", ".join(f"sha256(coalesce({_agg('name', w)}, '')) AS {n}" for n, w in (
        ("skills", "true"), ("technical_skills", "category = 'technical'"), ("tool_skills", "category = 'tool'"), ("soft_skills", "category = 'soft'"), ("domain_skills", "category = 'domain'"),
        ("language_skills", "category = 'language'"), ("expert_skills", "proficiency = 'expert'"), ("skills_with_years", "s.years IS NOT NULL"),
    )) + " FROM p LEFT JOIN s ON s.candidate_ref = p.candidate_ref GROUP BY p.candidate_ref"
)
def q_named_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of skills by category, rating and stated years, as digests of their names in order."""
    names = ("skills", "technical_skills", "tool_skills", "soft_skills", "domain_skills", "language_skills", "expert_skills", "skills_with_years")
    people = profiles(spark, sf_dir, with_skills=True)
    return people.select(KEY, *[F.sha2(F.coalesce(F.array_join(F.array_sort(field(n)), "|"), F.lit("")), 256).alias(n) for n in names])


@query(f"{CANDIDATES} SELECT candidate_ref, rights AS work_rights, CASE WHEN rights IS NOT NULL THEN unrestricted END AS work_rights_unrestricted, years AS years_experience FROM p")
def q_named_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select(KEY, *map(field, ("work_rights", "work_rights_unrestricted", "years_experience")))
