"""Truth tables, sentences and text functions on small rows, and the sources and streams."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from sievewright.functions import resume as rs
from sievewright.functions import text as tx
from sievewright.operators import verdicts as v
from sievewright.plans import fields, ingest, ranking, screening
from sievewright.plans import profiles as pf
from sievewright.plans.fields import aggregate_where, any_where, condition, count_where, where
from sievewright.sources import documents as sources
from sievewright.sources.candidates import PROFILE
from sievewright.streaming import queue


def skill(name, category, years=None, proficiency=None):
    return {"name": name, "category": category, "years": years, "proficiency": proficiency}


@pytest.fixture(scope="module")
def people(spark):
    lists = ("skills", "experience", "qualifications", "institution_tiers", "languages", "job_relevant_affiliations", "certifications", "projects", "licences")
    empty = {"candidate_ref": 2, "work_rights": {"status": "unknown"}} | {k: [] for k in lists}
    rich = empty | {
        "candidate_ref": 1,
        "total_years_experience": 6.0,
        "skills": [skill("Python", "technical", 4.0, "expert"), skill("AWS", "tool"), skill("Listening", "soft")],
        "experience": [
            {"title": "Senior Data Engineer", "months": 30.0, "is_current": True, "seniority": "senior", "industry": "banking", "employment_type": "permanent", "team_size": 4, "technologies": ["Kafka", "Spark"]},
            {"title": "Data Engineer", "months": 24.0, "is_current": False, "seniority": "mid", "industry": "retail", "employment_type": "contract", "technologies": []},
            {"title": "Analyst", "is_current": False, "technologies": []},
        ],
        "qualifications": [{"title": "Master of IT", "aqf_level": 9}, {"title": "Bachelor of Science", "aqf_level": 7}],
        "certifications": ["AWS Certified"],
        "languages": ["English", "Hindi"],
        "projects": [{"name": "Streaming", "technologies": ["Flink"], "months": 6.0}],
        "work_rights": {"status": "permanent_resident", "unrestricted": True},
        "management_years": 2.0,
        "people_managed_max": 4,
    }
    return spark.createDataFrame([rich, empty], PROFILE)


def values(people, column):
    return [r[0] for r in people.orderBy("candidate_ref").select(column).collect()]


T, N, U = True, False, None
CASES = [
    (lambda: condition("years_experience", ">=", 6), T, U),
    (lambda: condition("years_experience", ">", 6), N, U),
    (lambda: condition("years_experience", "!=", 6), N, U),
    (lambda: ~condition("years_experience", ">=", 10), T, U),
    (lambda: condition("certifications", "has any", ["aws"]), T, U),
    (lambda: condition("skill_count", ">=", 1), T, U),
    (lambda: condition("work_rights", "is", "unrestricted"), T, U),
    (lambda: condition("work_rights", "is", "citizen"), N, U),
    (lambda: condition("work_rights", "in", ["citizen", "permanent_resident"]), T, U),
    (lambda: condition("has_masters", "is", True), T, U),
    (lambda: condition("has_doctorate", "is", True), N, U),
    (lambda: condition("longest_role_months", ">=", 30), T, U),
    (lambda: condition("average_role_months", ">=", 27), T, U),
    (lambda: condition("leadership_role_count", ">=", 1), N, U),
    (lambda: condition("technologies", "has all", ["Kafka", "Flink"]), T, U),
    (lambda: condition("languages", "has any", ["French"]) & condition("years", ">=", 10), N, U),
    (lambda: condition("languages", "has any", ["French"]) | condition("years", ">=", 1), T, U),
    (lambda: any_where("skill", where("skill", "name", "=", "Python") & where("skill", "years", ">=", 3)), T, U),
    (lambda: any_where("role", where("role", "title", "has any", ["manager"])), N, U),
    (lambda: any_where("role", where("role", "months", ">=", 36)), U, U),
    (lambda: any_where("project", where("project", "name", "=", "streaming")), T, U),
    (lambda: condition("work_rights", "is", "Permanent Resident"), T, U),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_truth_table(people, k):
    build, rich, empty = CASES[k]
    verdict = build()
    assert values(people, verdict.value) == [rich, empty]
    assert all(values(people, verdict.reason))


def test_aggregates(people):
    year = where("role", "months", ">=", 12)
    assert [values(people, count_where("role", ">=", n, year).value)[0] for n in (2, 3, 4)] == [T, U, N]
    assert values(people, aggregate_where("sum", "role", "months", ">=", 50).value) == [T, U]
    assert values(people, aggregate_where("sum", "role", "months", "<=", 60).value) == [U, U]
    assert values(people, aggregate_where("avg", "role", "months", ">=", 10).value) == [U, U]
    assert values(people, aggregate_where("min", "role", "months", ">=", 10).value) == [U, U]
    assert values(people, count_where("role", ">=", 1, where("role", "industry", "=", "mining")).value) == [U, U]
    assert values(people, aggregate_where("min", "role", "months", ">=", 20, where("role", "title", "has any", ["engineer"])).value) == [T, U]
    assert values(people, aggregate_where("max", "skill", "years", ">=", 5, where("skill", "name", "=", "Python")).value) == [N, U]


REASONS = [
    (condition, ("years_experience", ">=", 8), "Candidate has 6 years of professional experience; the rule requires at least 8 years. This does not meet the requirement."),
    (condition, ("work_rights", "is", "unrestricted"), "Candidate does have unrestricted work rights; the rule requires that they do."),
    (condition, ("work_rights", "!=", "unrestricted"), "Candidate does have unrestricted work rights; the rule requires that they do not."),
    (condition, ("work_rights", "in", ["citizen", "visa_restricted"]), "Work rights status is permanent_resident; the rule accepts citizen, visa_restricted."),
    (condition, ("highest_seniority", "=", "lead"), "Highest seniority held is senior; the rule requires exactly lead."),
    (condition, ("skills", "has all", ["python", "Rust"]), "Candidate's skills do not include Rust. Listed skills: Python, AWS, Listening."),
    (condition, ("has_doctorate", "is", True), "Candidate does not have a doctorate (AQF 10); the rule requires that they do."),
    (condition, ("latest_role_title", "=", "data engineer"), 'Latest role title "Senior Data Engineer" matches "data engineer".'),
    (lambda: any_where("skill", where("skill", "name", "=", "Python") & where("skill", "years", ">=", 3)), (), (
        "Listed skill 'Python (4 years)' satisfies name = \"Python\" AND years >= 3: Skill name \"Python\" matches \"Python\". "
        "4 years with the skill; the rule requires at least 3 years. This meets the requirement."
    )),
    (lambda: any_where("role", where("role", "months", ">=", 36)), (), (
        "Could not tell whether any listed role satisfies months >= 36 (Analyst: months in the role is not stated for this role). Routed to manual review."
    )),
    (lambda: any_where("role", where("role", "title", "has any", ["manager"])), (), (
        "No listed role satisfies title HAS ANY (\"manager\"). Listed roles: Senior Data Engineer (30 months), Data Engineer (24 months), Analyst."
    )),
    (lambda: count_where("role", ">=", 3, where("role", "months", ">=", 12)), (), (
        "COUNT(role WHERE months >= 12) is between 2 and 3 because 1 role could not be assessed; the rule requires at least 3. Routed to manual review."
    )),
    (lambda: count_where("role", ">=", 2, where("role", "months", ">=", 12)), (), "COUNT(role WHERE months >= 12) is 2; the rule requires at least 2. This meets the requirement."),
    (lambda: aggregate_where("sum", "role", "months", "<=", 60), (), (
        "SUM(role.months) is 54 on the roles that state months in the role, but 1 could not be assessed; the rule requires no more than 60. Routed to manual review."
    )),
    (lambda: condition("years", ">=", 8) & condition("aqf", ">=", 7), (), "Candidate has 6 years of professional experience; the rule requires at least 8 years. This does not meet the requirement."),
    (lambda: condition("years", ">=", 8) | condition("aqf", ">=", 10), (), (
        "None of the alternatives were met: (a) Candidate has 6 years of professional experience; the rule requires at least 8 years. This does not meet the requirement.; "
        "(b) Candidate's highest qualification is AQF level 9; the rule requires at least AQF level 10. This does not meet the requirement."
    )),
    (lambda: ~condition("years", ">=", 8), (), "Candidate has 6 years of professional experience; the rule requires at least 8 years. This does not meet the requirement. The rule requires exactly that."),
]


@pytest.mark.parametrize("k", range(len(REASONS)))
def test_reasons_are_worded_as_written_here(people, k):
    build, given, wanted = REASONS[k]
    assert values(people, build(*given).reason)[0] == wanted


def test_reasons_of_unknowns(people):
    unknown = "so this rule could not be applied. Routed to manual review."
    assert values(people, condition("years", ">=", 8).reason)[1] == f"The resume does not state years of professional experience, {unknown}"
    assert values(people, any_where("project", where("project", "months", ">", 1)).reason)[1] == f"The resume lists no projects, {unknown}"
    assert values(people, count_where("skill", ">", 1).reason)[1] == "The resume lists no skills, so COUNT(skill) could not be computed. Routed to manual review."


def test_work_rights_where_limits_are_not_said(spark):
    rows = [{"candidate_ref": k, "work_rights": {"status": s, "unrestricted": u}} for k, (s, u) in enumerate([("citizen", None), ("visa_restricted", None), ("visa_restricted", False), ("unknown", True), ("visa_restricted", True)])]
    people = spark.createDataFrame(rows, PROFILE)
    assert values(people, condition("work_rights", "in", ["citizen", "unrestricted"]).value) == [T, N, N, U, T]
    assert values(people, condition("work_rights", "is", "unrestricted").value) == [U, U, N, U, T]
    assert values(people, condition("work_rights", "!=", "unrestricted").value) == [U, U, T, U, N]
    assert "whether work rights are unrestricted" in values(people, condition("work_rights", "is", "unrestricted").reason)[0]


def test_nesting_does_not_multiply(people):
    rule = condition("years", ">=", 6)
    for k in range(20):
        other = condition("aqf", ">=", 9 + k)
        rule = rule & other if k % 2 else rule | other
    begin = time.perf_counter()
    assert values(people, rule.value)[1] is None and len(values(people, rule.reason)[0]) < 4000
    assert time.perf_counter() - begin < 20


def test_numbers_are_said_with_six_digits(spark):
    said = {0.0: "0", 6.0: "6", 27.5: "27.5", 100000.0: "100000", 1234567.0: "1.23457e+06", 0.00001: "1e-05", 1 / 3: "0.333333", -120.0: "-120", 99999.96: "100000", 1e20: "1e+20"}
    rows = spark.createDataFrame([(x,) for x in said], "x double").select("x", v.plain_number(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in rows} == said == {x: f"{x:g}" for x in said}


def test_all_fields_build(people):
    assert len(fields.FIELDS) == 74
    rich, empty = people.orderBy("candidate_ref").select(*[fields.field(n) for n in fields.FIELDS]).collect()
    assert rich["technologies"] == ["Kafka", "Spark", "Flink", "Python", "AWS"] and rich["highest_seniority"] == "senior"
    assert [n for n in fields.FIELDS if empty[n] is not None] == []


def test_names(spark):
    with pytest.raises(fields.ForbiddenField):
        condition("suburb", "=", "x")
    with pytest.raises(fields.UnknownField, match="years_experience"):
        condition("years_experienc", ">=", 1)
    with pytest.raises(TypeError):
        condition("years", "has any", ["x"])
    with pytest.raises(fields.ForbiddenField, match="Age Discrimination Act 2004"):
        where("role", "start", "=", "2019")
    with pytest.raises(fields.UnknownField, match="did you mean months"):
        where("role", "month", ">=", 1)
    with pytest.raises(ValueError, match="one of"):
        condition("highest_seniority", "is", "wizard")
    with pytest.raises(TypeError):
        aggregate_where("sum", "role", "title", ">=", 1)
    assert where("skills", "name", "=", "Python").said == 'name = "Python"'
    assert len(fields.FORBIDDEN) == 41 and sum(len(r.fields) for r in fields.RECORDS.values()) == 23
    rule = screening.Rule("a", condition("years", ">=", 1), wording="Native English speaker only")
    with pytest.raises(screening.RuleRefused):
        screening.add_rule([], rule, spark)


def test_scores(spark):
    rows = [(1, k, s) for k, s in enumerate((0.90, 0.80, 0.72, 0.70, 0.68, 0.40))]
    scores = spark.createDataFrame(rows, "run_id int, position int, score double")
    assert sorted(r.position for r in ranking.borderline(scores, 3, 0.05).collect()) == [2, 3, 4]
    assert ranking.borderline(scores, 6, 0.05).count() == 0 and ranking.borderline(scores, 0, 0.05).count() == 0
    for width in (2, 100_000):
        ranked = ranking.ranked(scores.unionByName(scores.withColumn("position", F.col("position") + 6)), width=width)
        assert [r.position for r in ranked.orderBy("rank").collect()] == [0, 6, 1, 7, 2, 8, 3, 9, 4, 10, 5, 11]
    votes = spark.createDataFrame([(1, "a", 0.80), (1, "b", 0.82), (1, "c", 0.10)], "k int, member string, score double")
    (e,) = ranking.ensemble(votes, ["k"], F.lit(0.5)).collect()
    assert (e.median_score, e.include_votes, e.majority, e.unanimous, e.representative) == (0.8, 2, True, False, "a")


def test_text(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert one(tx.sentences(F.lit("First one. - second\n* third item\n4) fourth; ok"))) == ["First one.", "second", "third item", "fourth;"]
    assert one(tx.risk_findings(F.lit("must be able to lift up to 5 kg"))) == []
    assert [f["id"] for f in one(tx.risk_findings(F.lit("Native speaker, one of us")))] == ["native_speaker", "cultural_fit"]
    levels = {"PhD": 10, "Master of IT": 9, "Grad Cert": 8, "Bachelor of Arts": 7, "Certificate IV": 4, "Certificate of completion": None}
    assert {t: one(tx.qualification_level(F.lit(t)))["level"] for t in levels} == levels
    text = "Jane Roe, jane.roe@x.org, +61 400 000 000. JANE wrote it."
    tokens = tx.identity_tokens(F.lit("Jane Roe"), F.lit("jane.roe@x.org"))
    clean = one(tx.scrub(F.lit(text), tokens))
    assert not any(t in clean.lower() for t in ("jane", "roe", "@", "400")) and "wrote it" in clean
    assert one(tx.leaks(F.lit("by jane"), tokens)) == ["jane"]
    assert one(tx.html_text(F.lit("<p>a &lt; b</p><script>x</script> c"))) == "a < b c"
    assert one(tx.months_between_marks(F.lit("2019-03"), F.lit("2021"))) == 22


def test_duplicates_and_references(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id int, content string")
    assert [r.duplicate_of for r in ingest.mark_duplicates(docs).orderBy("doc_id").collect()] == [None, None, 1]
    split = ingest.split_errors(spark.createDataFrame([(None,), ("short",), ("x" * 30_000,)], "text string")).collect()
    assert [(r.error, r.truncated) for r in split] == [("unreadable", False), ("too_short", False), (None, True)]


def test_folder_and_archives(spark, tmp_path):
    batch = tmp_path / "b1"
    batch.mkdir()
    (batch / "a.txt").write_text("hello")
    (batch / ".hidden.txt").write_text("no")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("inner/c.txt", "see")
        z.writestr("__MACOSX/c.txt", "no")
    (batch / "z.zip").write_bytes(packed.getvalue())
    (batch / "bad.zip").write_bytes(b"not a zip")
    files = sources.folder(spark, str(tmp_path))
    assert {r.batch_id for r in files.select("batch_id").collect()} == {"b1"}
    found = {r.filename: (r.content, r.error is not None) for r in sources.expand_archives(files).collect()}
    assert bytes(found["a.txt"][0]) == b"hello" and bytes(found["c.txt"][0]) == b"see" and found["bad.zip"][1]
    sized = spark.createDataFrame([("b", "1", 6), ("b", "2", 6), ("b", "3", 4)], "batch_id string, path string, length long")
    assert [r.taken for r in sources.within_total(sized, 10).orderBy("path").collect()] == [True, False, True]


EVENTS = [
    (1, "d", "claim", None), (3, "d", "fail", "TIMEOUT"), (40, "d", "claim", None), (50, "d", "fail", "OCR_FAILED"), (200, "d", "claim", None), (210, "d", "fail", "TIMEOUT"),
    (1, "e", "claim", None), (2, "e", "fail", "CORRUPT"), (5, "f", "claim", None),
]


def event_rows(spark, rows):
    frame = spark.createDataFrame([(float(t), k, d, kind, code) for k, (t, d, kind, code) in enumerate(rows)], "t double, event_id long, document_id string, kind string, code string")
    return frame.select(F.timestamp_seconds("t").alias("event_ts"), "event_id", "document_id", "kind", "code")


def test_attempts_and_jobs(spark):
    found = queue.attempts(event_rows(spark, EVENTS)).orderBy("event_id").collect()
    waits = [r.available_at and (r.available_at - r.event_ts).total_seconds() for r in found]
    assert [(r.document_id, r.attempt, r.status) for r in found] == [("d", 1, "PENDING"), ("d", 2, "PENDING"), ("d", 3, "FAILED"), ("e", 1, "FAILED")]
    assert waits == [30.0, 120.0, None, None]
    states = spark.createDataFrame([("d", "j", "FAILED"), ("e", "j", "SUCCEEDED")], "document_id string, job_id string, status string")
    assert queue.job_status(states).first()["status"] == "PARTIAL_SUCCESS"


def test_windows_and_repeats_over_streams(spark, tmp_path):
    events = event_rows(spark, EVENTS).select("event_ts", "event_id", F.col("kind").alias("event_type"), F.lit(1.0).alias("value"))
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    once = queue.first_of_each(stream, ["event_id"], ts="event_ts")
    once.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.table("once").collect()) == list(range(len(EVENTS)))
    counted = queue.windowed_counts(stream, ts="event_ts", size="1 minute")
    counted.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sum(r.n for r in spark.table("windowed").collect()) == 2 * len(EVENTS)


RESUME = """ANH NGUYEN
anh.nguyen@mail.com | 0412 345 678 | Sunnybank, QLD
linkedin.com/in/anhnguyen

SUMMARY
Data engineer Anh with 8 years of commercial experience. Australian citizen.

EXPERIENCE
Senior Data Engineer — Queensland Bank, Mar 2019 - Present
- Led a team of 6 for Anh's unit
Engineer — Labor Party
Jan 2015 - Dec 2018
- contractor work in payments

EDUCATION
Master of IT, University of Queensland, 2014
Bachelor of Science
Hanoi University, China, 2011

SKILLS
Python, SQL; Spark, python

LANGUAGES
English, Vietnamese

AFFILIATIONS
IEEE member, Vietnamese Student Union, chess club

CERTIFICATIONS
Forklift licence
AWS Certified

PROJECTS
Loader - Kafka, Flink
"""


def test_resumes_are_structured_and_deidentified(spark):
    docs = spark.createDataFrame([(1, RESUME), (2, "short"), (3, None), (4, RESUME.replace("Python,", "Nguyen,"))], "id int, text string")
    out = {r.id: r for r in pf.deidentified(pf.structured_profiles(docs), F.concat(F.lit("Candidate "), F.col("id"))).collect()}
    assert [(out[k].error, out[k].status) for k in (1, 2, 3, 4)] == [(None, "ready"), ("too_short", "manual_review"), ("unreadable", "manual_review"), (None, "failed")]
    p, a = out[1].profile, out[1].anonymised
    assert tuple(p.identity) == ("Anh Nguyen", "anh.nguyen@mail.com", "0412 345 678", "Sunnybank", "QLD", "Australia", ["linkedin.com/in/anhnguyen"])
    assert [s.name for s in p.skills] == ["Python", "SQL", "Spark"]
    assert [(r.title, r.employer, r.start, r.end, r.is_current, r.months, r.seniority, r.employment_type, r.team_size) for r in p.experience] == [
        ("Senior Data Engineer", "Queensland Bank", "2019-03", None, True, None, "senior", None, 6), ("Engineer", "Labor Party", "2015-01", "2018-12", False, 47.0, None, "contract", None),
    ]
    assert [(q.title, q.institution, q.completion_year, q.country, q.aqf_level) for q in p.qualifications] == [
        ("Master of IT", "University of Queensland", 2014, "Australia", 9), ("Bachelor of Science", "Hanoi University", 2011, "China", 7),
    ]
    assert (p.work_rights.status, p.total_years_experience, p.people_managed_max, p.licences) == ("citizen", 8.0, 6, ["Forklift licence"])
    assert (p.projects[0].name, p.projects[0].technologies) == ("Loader", ["Kafka", "Flink"])
    assert (a.summary, a.region) == ("Data engineer [redacted] with 8 years of commercial experience. Australian citizen.", "Greater Brisbane / South East Queensland")
    assert a.institution_tiers == ["Australian university (Group of Eight)", "Overseas university"] and a.job_relevant_affiliations == ["IEEE member"]
    assert [r.employer for r in a.experience] == ["Queensland Bank", None] and all(q.institution is None and q.completion_year is None for q in a.qualifications)
    assert sorted({r.field for r in out[1].redactions if r.action == "removed"}) == [
        "affiliations", "experience.employer", "identity.email", "identity.full_name", "identity.links", "identity.phone",
        "qualifications.completion_year", "qualifications.country", "qualifications.institution",
    ]
    assert out[4].leaks == ["Nguyen"]


def test_readers(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert tuple(one(rs.date_range(F.lit("2017 - 2021")))) == ("2017", "2021", False, 48.0)
    assert one(rs.notice_weeks(F.lit("notice period: 2 months"))) == 8.0
    assert [one(rs.coerced(F.lit(x), "seniority", fields.SENIORITY)) for x in ("Sr", "c-level", "Team Lead", "senior")] == ["senior", "executive", None, "senior"]
    assert "'Wizard' is not a recognised value" in one(rs.coercion_note(F.lit("Wizard"), "seniority", fields.SENIORITY, "role 'x'"))
    answers = ['{"a": 1}', 'so <think>{"b"}</think> ```json\n{"a": 1}\n``` done', 'it is {"a": 1} then', "none"]
    assert [one(rs.recovered_json(F.lit(x))) for x in answers] == ['{"a": 1}'] * 3 + [None]
    found = one(tx.risk_details(tx.risk_findings(F.lit("Native speaker"))))
    assert found[0].attributes == ["race", "national or ethnic origin"] and found[0].statutes[0].startswith("Racial Discrimination Act 1975")
    assert one(tx.merged_findings(tx.risk_findings(F.lit("Native speaker")), tx.risk_findings(F.lit("native speaker, one of us"))))[1].id == "cultural_fit"
    hinted = {n: [h for h in tx.RISK_HINTS[n]] for n, _, _ in tx.RISK_PATTERNS}
    assert all(hinted.values())
    assert [f.id for f in one(tx.risk_findings(F.lit("big 4 consultancies; aged 30 to 40; lives in the inner north; nat\u0131ve speaker")))] == ["native_speaker", "age_coded", "employer_prestige", "postcode_or_suburb"]


def test_evidence_of_work_rights_is_found_in_linear_time(spark):
    text = "x" * 200_000 + "\nHolds full work rights, and more. Else"
    began = time.perf_counter()
    found = spark.createDataFrame([(text,)], "t string").select(rs.work_rights(F.col("t")).alias("r")).first().r
    assert (found.status, found.evidence) == ("visa_unrestricted", "Holds full work rights, and more") and time.perf_counter() - began < 20
