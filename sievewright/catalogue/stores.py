"""What is kept and read again: cached corpora, model answers, audit trails and results of runs.

Everything kept is made by Spark from the tables; the SQL says from the tables what must be read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..functions import resume as rs
from ..plans import memo
from ..sources import corpus
from ..sources.candidates import table
from ..sources.shared import shared_folder
from ..sources.versioned import RunResults
from ..streaming.sink import AuditTrail
from .registry import query


@query(
    "WITH n AS (SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN ['A'] WHEN 1 THEN ['A', 'B'] ELSE ['A', 'B', 'C'] END) AS g FROM customer), j AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) "
    "SELECT CAST(n.c_custkey AS VARCHAR) AS case_id, n.c_custkey || ':' || g AS variant_id, g || c.c_nationkey AS first_name, c_mktsegment AS target_role, CAST(coalesce(j.n, 0) AS INTEGER) AS jobs, CAST(1 + coalesce(j.n, 0) AS INTEGER) AS lines "
    "FROM n JOIN customer AS c USING (c_custkey) LEFT JOIN j ON o_custkey = c_custkey WHERE c_custkey % 3 > 0"
)
def q_corpus_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as work histories and two or three names for most of them, cached as pages, read back by the data
    source and joined; histories with a single name make no case."""
    folder = shared_folder(spark)
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("target_role"), "c_custkey", "c_nationkey")
    job = F.struct(F.col("o_orderkey").cast("int").alias("job_order"), F.col("o_orderpriority").alias("job_title"), F.lit("2001").alias("duration_str"), F.array(F.col("o_orderstatus")).alias("tasks"))
    jobs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(job).alias("jobs"))
    groups = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("A"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A"), F.lit("B"), F.lit("C")))
    pages = spark.sparkContext.defaultParallelism
    corpus.write_pages(people.join(jobs, "c_custkey", "left").select("user_id", "target_role", "jobs"), folder, "resumes", pages)
    corpus.write_pages(people.select("user_id", F.explode(groups).alias("race"), F.col("c_nationkey").cast("string").alias("n")).select("user_id", "race", F.concat("race", "n").alias("first_name")), folder, "summaries", pages)
    made = corpus.cases(corpus.cached_corpus(spark, folder, "resumes"), corpus.cached_corpus(spark, folder, "summaries"))
    text = rs.rendered(F.col("first_name"), F.col("jobs"))
    lines = 1 + F.regexp_count(text, F.lit("(?m)^- "))
    return made.select("case_id", "variant_id", "first_name", "target_role", F.size(F.coalesce("jobs", F.array().cast(made.schema["jobs"].dataType))).alias("jobs"), lines.alias("lines"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_ref and an answer as a model might word it: every fifth is no JSON, every third is fenced, and numbers,
    lists and names are missing or of other types here and there."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    years = F.when(k % 4 == 0, '"n/a"').otherwise(F.concat(F.lit('"'), F.floor(k % 40).cast("string"), F.lit('.5"')))
    skills = F.concat(F.lit('[{"name": "'), F.col("c_mktsegment"), F.lit('", "category": "Programming", "years": "'), (k % 7).cast("string"), F.lit('"}, {"name": " "}, null, {"name": "Kafka", "category": "Wizardry", "proficiency": "Fluent", "years": "many"}, 7]'))
    roles = F.concat(F.lit('[{"title": "Engineer", "seniority": "Sr", "months": '), (k % 90).cast("string"), F.lit(', "team_size": "'), (k % 12).cast("string"), F.lit('.9", "is_current": '), F.when(k % 2 == 0, "true").otherwise('""'), F.lit(', "technologies": ["Spark", null, ""]}, "x"]'))
    languages = F.when(k % 3 == 1, "null").otherwise('["English", "", null, "Hindi"]')
    rights = F.when(k % 6 == 5, '"citizen"').otherwise(F.concat(F.lit('{"status": "'), F.when(k % 2 == 0, "Permanent Resident").otherwise("by birth"), F.lit('"}')))
    body = F.concat(F.lit('{"total_years_experience": '), years, F.lit(', "skills": '), skills, F.lit(', "experience": '), roles, F.lit(', "languages": '), languages, F.lit(', "work_rights": '), rights, F.lit("}"))
    said = F.when(k % 5 == 0, F.concat(F.lit("I could not read this resume: "), F.col("c_name"))).when(k % 3 == 0, F.concat(F.lit("<think>{}</think>Here it is:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    # a file of one row group is one task, and every answer is much work
    return c.select(k.alias("candidate_ref"), said.alias("answer")).repartition(4 * spark.sparkContext.defaultParallelism, "candidate_ref")


@query(
    "WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m, c_custkey % 5 > 0 AS ok FROM customer) SELECT k AS candidate_ref, ok AS readable, CASE WHEN ok THEN 2 END AS skills, CASE WHEN ok THEN m || '/technical/' || (k % 7) || '.0; Kafka/other/?' END AS said, "
    "CASE WHEN ok AND k % 4 > 0 THEN k % 40 + 0.5::DOUBLE END AS years, CASE WHEN ok THEN CAST(k % 90 AS DOUBLE) END AS months, CASE WHEN ok THEN CAST(k % 12 AS INTEGER) END AS team, CASE WHEN ok THEN k % 2 = 0 END AS is_current, "
    "CASE WHEN ok THEN CASE WHEN k % 3 = 1 THEN 0 ELSE 2 END END AS languages, CASE WHEN ok THEN CASE WHEN k % 6 = 5 OR k % 2 = 1 THEN 'unknown' ELSE 'permanent_resident' END END AS status, CASE WHEN ok THEN CASE WHEN k % 6 <> 5 AND k % 2 = 1 THEN 2 ELSE 1 END END AS notes FROM c"
)
def q_normalised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = model_answers(spark, sf_dir).withColumn("p", answers.normalised(F.col("answer")))
    p, role = F.col("p"), F.get(F.col("p.experience"), F.lit(0))
    said = F.array_join(F.transform(p["skills"], lambda s: F.concat_ws("/", s["name"], s["category"], F.coalesce(s["years"].cast("string"), F.lit("?")))), "; ")
    known = p.isNotNull()
    return read.select(
        "candidate_ref", known.alias("readable"), F.when(known, F.size(p["skills"])).alias("skills"), F.when(known, said).alias("said"), p["total_years_experience"].alias("years"), role["months"].alias("months"),
        role["team_size"].alias("team"), role["is_current"].alias("is_current"), F.when(known, F.size(p["languages"])).alias("languages"), p["work_rights"]["status"].alias("status"), F.when(known, F.size(p["extraction_notes"])).alias("notes"),
    )


@query(
    "WITH w AS (SELECT p_partkey, p_brand || ' ' || p_type AS text, q FROM part, (VALUES ('long'), ('red')) AS q(q)), a AS (SELECT DISTINCT text, q FROM w) "
    "SELECT p_partkey, q AS question, CASE WHEN q = 'red' AND length(text) % 3 = 0 THEN true ELSE CASE WHEN q = 'long' THEN length(text) > 25 WHEN length(text) % 2 = 0 THEN length(text) > 25 END END AS value, "
    "CASE WHEN q = 'red' AND length(text) % 3 = 0 THEN 1 ELSE CASE WHEN q = 'long' THEN 3 ELSE 2 END END::BIGINT AS votes FROM w"
)
def q_remembered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are profiles with a text that many share; two questions of each, of which some answers are stored. The votes
    are made from what is asked for alone: of an even length both of 'red' agree, of an odd one they do not."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("text"))
    wanted = memo.keyed(parts.withColumn("question", F.explode(F.array(F.lit("long"), F.lit("red")))), "text", "two")
    stored = wanted.where((F.col("question") == "red") & (F.length("text") % 3 == 0)).select(*memo.KEY).distinct().withColumn("value", F.lit(True)).withColumn("votes", F.lit(1).cast("long"))
    asked = memo.unanswered(wanted, stored, "text")
    long = F.length("text") > 25
    cast = F.when(F.col("question") == "long", F.array(long, long, ~long)).otherwise(F.array(long, F.when(F.length("text") % 2 == 0, long).otherwise(~long)))
    answered = memo.combined(asked.withColumn("value", F.explode(cast)))
    return memo.remembered(wanted, stored, answered).select("p_partkey", "question", "value", "votes")


@query("SELECT user_id AS run_id, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1, 2")
def q_audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit rows of runs (users), written in three batches of which the second is replayed; nothing is there twice."""
    trail = AuditTrail(spark, shared_folder(spark), "bucket")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type", F.pmod(F.xxhash64("user_id"), F.lit(8)).alias("bucket"))
    for batch in (0, 1, 1, 2):
        trail.append(events.where(F.pmod("event_id", F.lit(3)) == batch), batch)
    return trail.read().groupBy("run_id", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT c_custkey AS candidate_ref, c_nationkey AS run_id, CASE WHEN c_nationkey < 5 THEN round(c_acctbal * 2, 2) ELSE c_acctbal END AS score FROM customer")
def q_replaced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of 25 runs (nations), of which five are screened again: their rows are replaced, the others stay."""
    results = RunResults(spark, shared_folder(spark))
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_ref"), F.col("c_nationkey").alias("run_id"), F.col("c_acctbal").alias("score"))
    results.replace(first)
    results.replace(first.where("run_id < 5").withColumn("score", F.round(F.col("score") * 2, 2)))
    return results.read().select("candidate_ref", F.col("run_id").cast(first.schema["run_id"].dataType).alias("run_id"), "score")
