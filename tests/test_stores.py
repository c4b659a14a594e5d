"""Tables that are kept, streams into them, places in an order, and answers of models."""

import io
import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievewright.functions import answers
from sievewright.plans import memo, numbering
from sievewright.plans import profiles as pf
from sievewright.sources import corpus
from sievewright.sources.shared import Written
from sievewright.sources.versioned import RunResults, VersionedTable
from sievewright.streaming import queue
from sievewright.streaming.sink import AuditTrail, LateRows

DAY = datetime(2024, 1, 1)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_places_in_an_order(spark):
    rows = [(s, (k * 37) % 101, k) for s, n in (("hot", 900), ("b", 60), (None, 30)) for k in range(n)] + [("b", None, 1), ("hot", 5, 0), ("hot", 5, 0)]
    table = spark.createDataFrame(rows, "source string, at int, _tie int")
    wanted = []
    for s in ("hot", "b", None):
        ours = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        wanted += [(*r, k) for k, r in enumerate(ours, 1)]
    for ranges in (1, 7, 40, None):
        assert listed(numbering.numbered(table, ["source"], ["at", "_tie"], ranges=ranges)) == sorted(wanted, key=repr)
    assert numbering.numbered(table.limit(0), ["source"], ["at"], into="n").columns == ["source", "at", "_tie", "n"]


def test_a_hot_group_is_dealt_to_many_ranges(spark):
    table = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"), F.xxhash64("id").alias("at"))
    placed = table.repartitionByRange(12, "source", "at").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(placed) == 12 and max(r["count"] for r in placed) < 2 * 60_000 / 12
    found = numbering.numbered(table, ["source"], ["at"], ranges=12)
    assert found.where("source = 'hot'").agg(F.countDistinct("place"), F.max("place")).first() == (20_000, 20_000)


def test_a_failed_write_leaves_the_old_state(spark, tmp_path):
    kept = VersionedTable(spark, f"file://{tmp_path}/kept")
    one = spark.createDataFrame([(1, "a")], "id int, said string")
    assert kept.replace(one) == 1 and listed(kept.read()) == [(1, "a")]
    with pytest.raises(Exception):
        kept.replace(one.withColumn("bad", F.raise_error(F.lit("lost"))))
    assert listed(kept.read()) == [(1, "a")] and kept.versions() == [1]
    kept.replace(kept.read().select("id", F.lit(2.5).alias("score")))
    assert listed(kept.read()) == [(1, 2.5)] and listed(kept.read(1)) == [(1, "a")]


def test_a_run_replaces_its_own_rows(spark, tmp_path):
    results = RunResults(spark, f"file://{tmp_path}/runs")
    results.replace(spark.createDataFrame([(1, "r1"), (2, "r1"), (3, "r2")], "ref int, run_id string"))
    results.replace(spark.createDataFrame([(9, "r1")], "ref int, run_id string"))
    assert listed(results.read()) == [(3, "r2"), (9, "r1")]
    plan = results.read().where("run_id = 'r1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_replayed_batches_and_pruned_audit_reads(spark, tmp_path):
    trail = AuditTrail(spark, f"file://{tmp_path}/audit")
    for batch, rows in ((0, [("r1", "a")]), (1, [("r1", "b"), ("r2", "c")]), (1, [("r1", "b"), ("r2", "c")])):
        trail.append(spark.createDataFrame(rows, "run_id string, event string"), batch)
    assert listed(trail.read().select("run_id", "event")) == [("r1", "a"), ("r1", "b"), ("r2", "c")]
    assert listed(trail.read("r2").select("event")) == [("c",)]
    assert "PartitionFilters: [isnotnull(run_id" in trail.read("r2")._jdf.queryExecution().executedPlan().toString()


def files(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, user_id long, event_id long, value double").coalesce(1).write.mode("append").json(f"{folder}/{k}")


def streamed(spark, folder, make, path, mode="append"):
    """What a stream over the folder's files, one at a time, leaves in a table."""
    source = spark.readStream.schema("ts timestamp, user_id long, event_id long, value double").option("maxFilesPerTrigger", 1).json(f"{folder}/*")
    made = make(source)
    made.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/c").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/out")


def test_windows_over_streams_are_those_over_tables(spark, tmp_path):
    rows = [(DAY + timedelta(minutes=7 * k + (k % 5) * 30), k % 3, k, 1.0) for k in range(60)]
    closing = [(DAY + timedelta(days=3), 99, 1000, 1.0)]
    files(spark, tmp_path / "in", [rows[:30], rows[30:], closing])
    table = spark.createDataFrame(rows, "ts timestamp, user_id long, event_id long, value double")
    for name, make in (("slide", lambda e: queue.sliding_counts(e, "1 hour", "20 minutes", late="12 hours")), ("session", lambda e: queue.session_windows(e, "25 minutes", late="12 hours"))):
        assert listed(streamed(spark, tmp_path / "in", make, tmp_path / name)) == listed(make(table)), name


def test_late_rows_go_aside_and_replays_part_alike(spark, tmp_path):
    parting = LateRows(spark, f"file://{tmp_path}/late", late="1 hour")
    batches = [[(DAY, 1)], [(DAY + timedelta(hours=5), 2), (DAY - timedelta(hours=2), 3)], [(DAY + timedelta(hours=3), 4), (DAY + timedelta(hours=4, minutes=30), 5)]]
    for k in (0, 1, 2, 1, 2):
        parting(spark.createDataFrame(batches[k], "ts timestamp, event_id long"), k)
    assert listed(spark.read.parquet(parting.in_time).select("event_id")) == [(1,), (2,), (5,)]
    assert listed(spark.read.parquet(parting.side).select("event_id")) == [(3,), (4,)]


def test_answers_are_made_profiles(spark):
    odd = [
        None, "", "no json", "[1]", "{}", '{"skills": null, "experience": "x", "work_rights": [], "languages": 5}',
        '{"skills": [{"name": "Go", "years": "1e2", "category": "Cloud"}, {"name": null}, "x", null], "experience": [{"is_current": "no", "team_size": 7.9, "months": "x", "employment_type": "Gig"}], "people_managed_max": "12.7", "total_years_experience": true, "languages": ["a", 0, false, 3, ""]}',
    ]
    found = [r.p for r in spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string").select("k", answers.normalised(F.col("t")).alias("p")).orderBy("k").collect()]
    assert found[:4] == [None] * 4
    for p in found[4:6]:
        assert (p.skills, p.experience, p.languages, p.work_rights.status, p.extraction_notes) == ([], [], [], "unknown", [])
    p = found[6]
    assert [(s.name, s.years, s.category) for s in p.skills] == [("Go", 100.0, "tool")]
    assert (p.experience[0].is_current, p.experience[0].team_size, p.experience[0].months, p.people_managed_max, p.languages) == (True, 7, None, 12, ["a", "3"])
    assert p.extraction_notes == ["role '?': employment_type 'Gig' is not a recognised value; recorded as None."]


def test_no_question_is_put_twice(spark):
    wanted = memo.keyed(spark.createDataFrame([(k, f"text {k % 3}" if k % 4 else None, q) for k in range(12) for q in ("a", "b")], "ref int, text string, question string"), "text", "e")
    none = spark.createDataFrame([], "ensemble string, digest string, question string, value boolean, votes long")
    first = memo.unanswered(wanted, none, "text")
    assert first.count() == 8 and first.select("digest", "text").distinct().count() == 4
    stored = memo.combined(first.withColumn("value", F.explode(F.array(F.lit(True), F.lit(True), F.lit(None).cast("boolean")))))
    assert {r.value for r in stored.collect()} == {True}
    assert memo.unanswered(wanted, stored, "text").count() == 0
    assert memo.remembered(wanted, stored, none).where("value").count() == 24


def test_the_cached_corpus(spark, tmp_path):
    for config, pages in (("resumes", [[{"user_id": "u1", "target_role": "r", "jobs": [{"job_order": 1, "job_title": "t", "duration_str": "d", "tasks": ["x"]}]}], [{"user_id": "u2"}, {}]]), ("summaries", [[{"user_id": "u1", "race": g, "first_name": g * 2} for g in "AB"] + [{"user_id": "u2", "race": "A", "first_name": "n"}]])):
        (tmp_path / config).mkdir()
        for k, rows in enumerate(pages):
            (tmp_path / config / f"{k}.json").write_text(json.dumps({"rows": [{"row": r} for r in rows]}, indent=1) + "\n" + json.dumps({"rows": None}))
    histories, names = (corpus.cached_corpus(spark, str(tmp_path), c) for c in ("resumes", "summaries"))
    assert histories.rdd.getNumPartitions() == 2 and histories.count() == 3
    assert [(r.variant_id, r.first_name, r.jobs[0].tasks) for r in corpus.cases(histories, names).orderBy("group").collect()] == [("u1:A", "AA", ["x"]), ("u1:B", "BB", ["x"])]
    with pytest.raises(Exception, match="no configuration"):
        corpus.cached_corpus(spark, str(tmp_path), "other")


def test_names_are_swapped_at_once(spark):
    cases = [("Ann Lee met ANN. ann.lee@x.org https://github.com/annlee", "Ann Lee", "Lee Ann", "Lee Ann met Lee. lee.ann@email.com https://github.com/leeann"), ("Bob Hill, Hill", "Bob Hill", "Cash $5 Man\\", "Cash $5 Man\\, $5"), ("x", None, "A B", "x"), ("Ann", "Ann", None, "Ann"), ("", "Ann Lee", "A B", "")]
    table = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, text string, old string, new string, wanted string")
    assert [(r.got, r.wanted) for r in table.orderBy("k").select(pf.swapped(F.col("text"), F.col("old"), F.col("new")).alias("got"), "wanted").collect()] == [(c[3], c[3]) for c in cases]


def test_names_are_found_on_the_lines_that_may_hold_them(spark):
    cases = [
        ("S\u0130m \u2014 SIM\n\u017fim\n\nsims, \u212aim", "Sim Kim", "A B", "B \u2014 A\nB\n\nsims, B"), ("Jean\nLuc here, Jean", "Jean\nLuc", "A B", "A B here, A"),
        ("\u00dcnal\n\u00fcnal \u2014 x", "\u00dcnal Oz", "A B", "A\nA \u2014 x"), ("", "Sim Kim", "A B", ""), ("\n", "Sim Kim", "A B", "\n"), (None, "Sim Kim", "A B", None),
    ]
    table = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, text string, old string, new string, wanted string")
    assert [r.got for r in table.orderBy("k").select(pf.swapped(F.col("text"), F.col("old"), F.col("new")).alias("got")).collect()] == [c[3] for c in cases]


def test_the_line_of_an_institution_is_looked_for_once(spark):
    """At every line it was looked for among all lines: 16 million searches here."""
    lines = "\n".join(["Engineer \u2014 Harbour Bank, in which nobody ever studied at all"] * 4000)
    table = spark.createDataFrame([(f"{lines}\nX, Univer\u017fity of Y, College Z\nCollege W",)], "text string")
    began = time.perf_counter()
    got = table.select(pf.swapped(F.col("text"), F.lit("Ann"), F.lit("Bob"), institution=F.lit("Hill"))).first()[0]
    assert got == f"{lines}\nX, Hill, College Z\nCollege W" and time.perf_counter() - began < 10


def test_helper_columns_do_not_clash(spark):
    text = "JO DOE\njo@x.org | 0400 000 000\n\nEXPERIENCE\nEngineer — Bank, Mar 2019 - Mar 2021\n- built things that last and last and last"
    table = spark.createDataFrame([(text, 5, 7, "p")], "text string, _text_read int, _roles int, _tokens string")
    read = pf.deidentified(pf.structured_profiles(table), F.lit("c1")).first()
    assert (read._text_read, read._roles, read._tokens, read.status) == (5, 7, "p", "ready")
    assert [r.months for r in read.profile.experience] == [24.0] and read.profile.identity.full_name == "Jo Doe"


def test_a_written_table_is_cleaned(spark):
    held = Written(spark.range(3))
    with held as rows:
        assert rows.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(held.path)


def test_cached_pages_stay_small_and_are_read_one_at_a_time(spark, tmp_path):
    rows = spark.range(400).selectExpr("cast(id as string) AS user_id", "'a' AS race", "repeat('é', 100) AS first_name").coalesce(1)
    corpus.write_pages(rows, str(tmp_path), "summaries", 2, most=20)
    texts = [p.read_text(encoding="utf-8") for p in (tmp_path / "summaries").glob("part-*")]
    pages = [json.loads(line)["rows"] for text in texts for line in text.splitlines()]
    assert len(pages) >= 15 and max(map(len, pages)) < 60 and sum(map(len, pages)) == 400
    assert corpus.cached_corpus(spark, str(tmp_path), "summaries").distinct().count() == 400

    class File(io.StringIO):
        most = 0

        def read(self, n):
            self.most = max(self.most, n)
            return super().read(n)

    file = File(" \n".join(t for t in texts) * 3 + " ")
    found = list(corpus._documents(file, 64))
    assert [p["rows"] for p in found] == [json.loads(line)["rows"] for text in texts for line in text.splitlines()] * 3
    assert file.most < 4 * max(len(json.dumps(p, ensure_ascii=False)) for p in found)
    with pytest.raises(json.JSONDecodeError):
        list(corpus._documents(io.StringIO('{"rows": []}\n{"rows": ['), 8))
