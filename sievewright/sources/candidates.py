"""Candidate profiles as a view over the driver's tables: customers with their orders as roles and
their line items as skills. What a status of P would say is left unsaid, so unknowns occur.

Only what a query asks for is joined: a query on the customers' own columns reads nothing else. Roles
and skills are nested per candidate by one aggregation each, on the key that they are joined by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RIGHTS = {"BUILDING": "citizen", "MACHINERY": "permanent_resident", "AUTOMOBILE": "requires_sponsorship", "FURNITURE": "visa_unrestricted", "HOUSEHOLD": "unknown"}
SENIORITY = {"1-URGENT": "executive", "2-HIGH": "senior", "3-MEDIUM": "mid", "4-NOT SPECIFIED": "junior", "5-LOW": "graduate"}

ROLE = (
    "title string, employer string, start string, end string, is_current boolean, months double, summary string, seniority string, "
    "industry string, employment_type string, team_size int, technologies array<string>"
)
SKILL = "name string, category string, years double, proficiency string, evidence string"
QUALIFICATION = (
    "title string, institution string, field_of_study string, completion_year int, country string, aqf_level int, aqf_label string, aqf_confidence double"
)
PROJECT = "name string, summary string, technologies array<string>, months double"

#: What a profile holds; a null or an empty list was not said.
PROFILE = (
    f"candidate_ref bigint, summary string, skills array<struct<{SKILL}>>, experience array<struct<{ROLE}>>, total_years_experience double, "
    f"qualifications array<struct<{QUALIFICATION}>>, institution_tiers array<string>, region string, "
    "work_rights struct<status string, visa_subclass string, unrestricted boolean, evidence string>, languages array<string>, "
    f"job_relevant_affiliations array<string>, certifications array<string>, projects array<struct<{PROJECT}>>, licences array<string>, "
    "security_clearance string, management_years double, people_managed_max int, publications_count int, availability_weeks double"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(column: str, names: dict[str, str]):
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(column))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per role, flat."""
    said, key = F.col("o_orderstatus") != "P", F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("candidate_ref"), F.col("o_orderkey").alias("role_id"), F.col("o_orderdate").alias("began"),
        F.col("o_orderpriority").alias("title"), (F.col("o_orderdate") >= "2001-01-01").alias("is_current"),
        F.when(said, F.floor(F.col("o_totalprice") / 5000).cast("double")).alias("months"), F.when(said, _named("o_orderpriority", SENIORITY)).alias("seniority"),
        F.when(F.col("o_orderstatus") == "F", "permanent").when(F.col("o_orderstatus") == "O", "contract").alias("employment_type"),
        F.when(key % 4 > 0, F.concat(F.lit("Employer "), (key % 4).cast("string"))).alias("employer"), F.when(key % 3 == 0, "Banking").when(key % 3 == 1, "retail").alias("industry"),
        F.nullif(key % 5, F.lit(0)).cast("int").alias("team_size"), F.when(key % 2 == 0, F.array(F.lit("Kafka"))).otherwise(F.array(F.lit("spark"), F.lit("kafka"))).alias("technologies"),
    )


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per skill, flat."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("candidate_ref"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        "candidate_ref", F.col("p_name").alias("name"), F.col("l_orderkey").alias("at"), F.col("l_linenumber").alias("place"),
        F.when(F.col("l_returnflag") == "R", "tool").when(F.col("l_returnflag") == "A", "technical").otherwise("soft").alias("category"),
        F.when(F.col("l_quantity") > 5, F.floor(F.col("l_quantity") / 5).cast("double")).alias("years"),
        F.when(F.col("l_linestatus") == "F", "expert").otherwise("beginner").alias("proficiency"),
    )


def _nested(flat: DataFrame, order: list, fields: str, name: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """One array of records per candidate, in the order of ``order``; fields that ``only`` does not name are null."""
    kinds = [f.strip().split(" ", 1) for f in fields.split(", ")]
    record = F.struct(*[(F.col(n) if n in flat.columns and (only is None or n in only) else F.lit(None)).cast(k).alias(n) for n, k in kinds])
    packed = flat.select("candidate_ref", F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], record.alias("record")).alias("x"))
    listed = packed.groupBy("candidate_ref").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return listed.select("candidate_ref", F.transform("x", lambda v: v["record"]).alias(name))


def _first(items: list, n) -> Column:
    return F.slice(F.array(*items), F.lit(1), n.cast("int"))


def _extras() -> dict[str, Column]:
    """What a candidate's number stands for: languages, awards, projects and the like."""
    k = F.col("c_custkey")
    awards = [("Diploma of IT", "IT", 5, "Diploma"), ("Bachelor of Arts", "Arts", 7, "Bachelor Degree"), ("Master of IT", None, 9, "Masters Degree")]

    def award(title, study, level, label):
        return F.struct(
            F.lit(title).alias("title"), F.lit(None).cast("string").alias("institution"), F.lit(study).cast("string").alias("field_of_study"), F.lit(None).cast("int").alias("completion_year"),
            F.lit(None).cast("string").alias("country"), F.lit(level).alias("aqf_level"), F.lit(label).alias("aqf_label"), F.lit(1.0).alias("aqf_confidence"),
        )

    def project(n, tools):
        return F.struct(F.lit(f"Project {n}").alias("name"), F.lit(None).cast("string").alias("summary"), F.array(*map(F.lit, tools)).alias("technologies"), F.lit(2.0 * n).alias("months"))

    return {
        "languages": _first([F.lit(x) for x in ("English", "Hindi", "French")], k % 4), "certifications": _first([F.lit("AWS Certified"), F.lit("CISSP")], k % 3),
        "licences": _first([F.lit("Forklift")], k % 2), "projects": _first([project(1, ["Flink"]), project(2, ["Flink", "Kafka"])], k % 3), "qualifications": _first([award(*a) for a in awards], k % 4),
        "publications_count": F.when(k % 5 > 0, k % 5 - 1).cast("int"), "people_managed_max": F.when(k % 7 > 3, k % 7).cast("int"), "availability_weeks": F.when(k % 6 > 0, k % 6).cast("double"),
    }


def profiles(spark: SparkSession, sf_dir: str, *, with_roles: bool = False, with_skills: bool = False, with_extras: bool = False, role_fields: tuple[str, ...] | None = None) -> DataFrame:
    """A row per candidate with the columns of PROFILE; newest roles first. Only ``role_fields`` of roles are read, if given:
    Spark prunes columns of a table, but not fields of records that it gathers."""
    people = table(spark, sf_dir, "customer")
    balance = F.col("c_acctbal")
    status = _named("c_mktsegment", RIGHTS)
    base = people.select(
        F.col("c_custkey").alias("candidate_ref"),
        F.when(balance >= 0, F.floor(balance / 500).cast("double")).alias("total_years_experience"),
        F.struct(
            status.alias("status"), F.lit(None).cast("string").alias("visa_subclass"),
            F.when(status != "unknown", status != "requires_sponsorship").alias("unrestricted"), F.lit(None).cast("string").alias("evidence"),
        ).alias("work_rights"),
        F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("Clearance of nation "), F.col("c_nationkey").cast("string"))).alias("security_clearance"),
        F.when(balance > 5000, F.floor((balance - 5000) / 1000).cast("double")).alias("management_years"),
        *[c.alias(n) for n, c in (_extras() if with_extras else {}).items()],
    )
    if with_roles:
        flat = roles(spark, sf_dir)
        base = base.join(_nested(flat, [-F.col("began").cast("timestamp").cast("long"), F.col("role_id")], ROLE, "experience", role_fields), "candidate_ref", "left")
    if with_skills:
        flat = skills(spark, sf_dir)
        base = base.join(_nested(flat, [F.col("at"), F.col("place"), F.col("name"), F.col("category"), F.col("years"), F.col("proficiency")], SKILL, "skills"), "candidate_ref", "left")
    schema = spark.createDataFrame([], PROFILE).schema
    out = []
    for field in schema:
        column = F.col(field.name) if field.name in base.columns else F.lit(None).cast(field.dataType)
        if field.dataType.typeName() == "array":
            column = F.coalesce(column, F.array().cast(field.dataType))
        out.append(column.alias(field.name))
    return base.select(*out)
