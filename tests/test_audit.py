"""The variants of a case: read as if each stood alone, though their employment is read once."""

from pyspark.sql import functions as F

from sievewright.functions import resume as rs
from sievewright.plans import audit
from sievewright.plans import profiles as pf

ROLES = "EXPERIENCE :\nHead of Delivery — Harbour Bank, Mar 2015 - Apr 2019\n- Led a team of 12\n\nChıef Clerk | Union Church, 2019 - now\n* ſupervised 9 people\n"
REST = "  Education\nPhD in Physics, Monash University, 2004\nSKILLS\nKafka, Spark\nAFFILIATIONS:\nIEEE, chess club\n\nNo visa. Holds full work rights.Notice: 2\nmonths"
CASES = [
    (1, [("A", f"Ann Lee\nann@x.org | 0400 000 000 | Ascot, QLD\n{ROLES}{REST}"), ("B", f"Bob Ray\nbob@x.org\n{ROLES}{REST}"), ("C", f"Cyd Day\n{ROLES.replace('Harbour', 'Cyd Day')}{REST}")]),
    (2, [("A", None), ("B", "too short"), ("C", f"Cyd Day\n{REST} and years of talk that make it long enough")]),
    (3, []),
]


def test_variants_are_read_as_if_alone(spark):
    cases = spark.createDataFrame(CASES, "case_id int, variants array<struct<group:string,text:string>>")
    together = pf.deidentified(pf.structured_variants(cases, "variants"), F.lit("x"))
    alone = cases.select("case_id", F.explode("variants").alias("v")).select("case_id", "v.*")
    alone = pf.deidentified(pf.structured_profiles(alone), F.lit("x"))

    def rows(df):
        return {(r.case_id, r.group): r[2:] for r in df.select("case_id", "group", "text", "error", "profile", "anonymised", "redactions", "leaks", "status").collect()}

    got = rows(together)
    assert got == rows(alone) and len(got) == 6
    one = got[1, "A"][2]
    assert [(r.seniority, r.months, r.team_size) for r in one.experience] == [("head", 49.0, 12), ("executive", None, 9)]
    assert (one.work_rights.status, one.work_rights.evidence, one.availability_weeks) == ("visa_unrestricted", "Holds full work rights", 8.0)
    assert got[1, "C"][2].experience[0].employer == "Cyd Day Bank" and got[1, "C"][3].experience[0].employer == "[redacted] Bank"
    assert [r.employer for r in got[1, "A"][3].experience] == ["Harbour Bank", None]


def test_employment_is_read_before_variants_are_parted(spark):
    cases = spark.createDataFrame(CASES, "case_id int, variants array<struct<group:string,text:string>>")
    plan = audit.scored_arms(cases, lambda p: F.size(p["experience"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(rs.DATE) == 1 and plan.index(rs.DATE) > plan.rindex("Generate explode")


def test_all_new_names_at_once(spark):
    texts = [("ANN LEE\nann.lee@x.org\nAnn and Lee, annlee | github.com/annlee", "Ann Lee"), ("Ann\nLee met ANN\nLEE", "Ann\nLee"), ("x", None), (None, "Ann Lee")]
    table = spark.createDataFrame(texts, "text string, old string")
    news = ["Bob Ray", None, "Cyd"]
    each = [pf.swapped(F.col("text"), F.col("old"), F.lit(n).cast("string")).alias(f"n{k}") for k, n in enumerate(news)]
    got = table.select(pf.swapped_all(F.col("text"), F.col("old"), F.array(*[F.lit(n).cast("string") for n in news])).alias("all"), *each).collect()
    assert all(list(r.all) == list(r[1:]) for r in got)
    assert got[0].all == ["Bob Ray\nbob.ray@email.com\nBob and Ray, annlee | github.com/bobray", texts[0][0], "Cyd\ncyd@email.com\nCyd and Cyd, annlee | github.com/cyd"]
