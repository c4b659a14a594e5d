"""Criteria, statuses and summaries on small rows."""

from pyspark.sql import functions as F

from sievewright.plans import batches, criteria, screening
from sievewright.plans import profiles as pf
from sievewright.sources import documents


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_default_criteria_stand_in_for_preferences():
    mine = [criteria.Criterion("sql", 2.0)]
    assert [c.key for c in criteria.criteria_for(mine)] == ["sql", "role_relevance"]
    assert [c.key for c in criteria.criteria_for([])] == ["required_skills", "experience_depth", "role_relevance", "desirable_skills", "qualification"]


def test_skills(spark):
    held = F.array(F.lit("Apache Kafka"), F.lit(" "), F.lit("go"), F.lit(None))
    assert tuple(one(spark, *criteria.skills_score(["kafka", " Golang ", "Rust"], held, "required"))) == (2 / 3, "Holds 2/3 required skills (kafka,  Golang ). Missing: Rust.")
    assert tuple(one(spark, *criteria.skills_score(["", "  "], held, "desirable"))) == (0.0, "Holds 0/2 desirable skills (none).")
    assert tuple(one(spark, *criteria.skills_score([], held, "desirable"))) == (0.5, "No desirable skills specified for the role.")


def test_relevance_and_qualification(spark):
    titles = F.array(F.lit("Senior Data Engineer"), F.lit(None))
    assert tuple(one(spark, *criteria.relevance("Data Platform Engineer, IT", titles))) == (0.667, "Role history matches 2/3 terms in the role title (data, engineer).")
    assert one(spark, *criteria.relevance("Chef", F.lit(None).cast("array<string>")))[0] == 0.5
    assert tuple(one(spark, *criteria.qualification(F.lit(7), 9))) == (0.778, "Highest qualification is AQF level 7.")
    assert tuple(one(spark, *criteria.qualification(F.lit(None).cast("int"), 9))) == (0.0, "No qualification with a recognised AQF equivalent.")


def test_statuses(spark):
    cases = [(False, 0, 0, "queued"), (True, 0, 2, "running"), (True, 1, 0, "failed"), (True, 0, 0, "complete")]
    table = spark.createDataFrame(cases, "whole boolean, failed int, open int, wanted string")
    assert all(r.got == r.wanted for r in table.select(batches.run_status(F.col("whole"), F.col("failed"), F.col("open")).alias("got"), "wanted").collect())
    rows = spark.createDataFrame([("a.PDF", None), ("b.txt", "leak"), ("c.docx", "too_short")], "name string, error string")
    assert [r.status for r in batches.routed(rows).orderBy("name").collect()] == ["ready", "failed", "manual_review"]


def test_audit_rows(spark):
    row = screening.audit(spark.createDataFrame([(7, "x")], "candidate_ref int, why string"), "screen", "excluded", F.col("why"), F.lit(None).cast("timestamp")).first()
    assert tuple(row) == ("7", None, "screen", "excluded", '{"detail":"x"}')


def test_documents_by_name(spark):
    names = spark.createDataFrame([("cv.PDF",), (".hidden.txt",), ("notes.exe",), ("a.docx",)], "name string")
    assert {r.name: r.ok for r in names.select("name", documents.is_document(F.col("name")).alias("ok")).collect()}["notes.exe"] is False


def test_a_summary_in_lines(spark):
    text = "JO DOE\njo@x.org\n\nSUMMARY\nBuilds 6 years of pipelines\n\nEXPERIENCE\nEngineer — Bank, Mar 2019 - Mar 2021\n- built things\n\nSKILLS\nKafka, Spark"
    said = pf.structured_profiles(spark.createDataFrame([(text,)], "text string")).select(pf.summary_text(F.col("profile"))).first()[0]
    assert said == "Builds 6 years of pipelines\n6 years of professional experience\nSkills: Kafka; Spark\nRoles: Engineer, Bank" or said.split("\n")[0] == "Builds 6 years of pipelines"
    assert "Roles: Engineer, Bank" in said and "Kafka" in said and "6 years of professional experience" in said
