"""The work queue and event-time queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.candidates import table
from ..streaming import queue
from .registry import query


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as those of documents on their way: a user is a document, a view a claim, an error a failure."""
    kind = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "error", "fail").otherwise("other")
    code = F.when(F.col("event_id") % 2 == 0, "TIMEOUT").otherwise("CORRUPT")
    return table(spark, sf_dir, "events").select(F.col("ts").alias("event_ts"), "event_id", F.col("user_id").alias("document_id"), kind.alias("kind"), code.alias("code"))


@query(
    "WITH c AS (SELECT user_id AS document_id, event_id, event_type, count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events) "
    "SELECT document_id, event_id, attempt, CASE WHEN event_id % 2 = 0 AND attempt < 3 THEN 'PENDING' ELSE 'FAILED' END AS status, CASE WHEN event_id % 2 = 0 AND attempt < 3 THEN CASE WHEN attempt <= 1 THEN 30 ELSE 120 END END AS waits FROM c WHERE event_type = 'error'"
)
def q_queue_retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failure with its attempt, what becomes of the document and how long it waits."""
    found = queue.attempts(queue_events(spark, sf_dir))
    waits = F.round(F.unix_micros("available_at") / 1e6 - F.unix_micros(F.col("event_ts").cast("timestamp")) / 1e6).cast("int")
    return found.select("document_id", "event_id", "attempt", "status", waits.alias("waits"))


@query(
    "WITH l AS (SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' ELSE 'PENDING' END AS status FROM events GROUP BY user_id), "
    "c AS (SELECT user_id % 10 AS job_id, count(*) FILTER (WHERE status = 'SUCCEEDED')::BIGINT AS succeeded, count(*) FILTER (WHERE status = 'FAILED')::BIGINT AS failed, count(*) AS n FROM l GROUP BY 1) "
    "SELECT job_id, CASE WHEN succeeded + failed < n THEN 'PROCESSING' WHEN failed = 0 THEN 'SUCCEEDED' WHEN succeeded = 0 THEN 'FAILED' ELSE 'PARTIAL_SUCCESS' END AS status, succeeded, failed FROM c"
)
def q_queue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    status = F.when(F.col("last") == "purchase", "SUCCEEDED").when(F.col("last") == "error", "FAILED").otherwise("PENDING")
    return queue.job_status(last.select((F.col("user_id") % 10).alias("job_id"), status.alias("status")))


@query("SELECT user_id, count(*) AS outstanding, CASE WHEN count(*) <= 0 THEN 0 ELSE least(10, 1 + (count(*) - 1) // 25) END::BIGINT AS workers FROM events WHERE event_type = 'view' GROUP BY user_id")
def q_autoscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("outstanding"))
    return open_.withColumn("workers", queue.workers(F.col("outstanding")))


@query("SELECT count(*) AS outstanding, count(*) FILTER (WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE)::BIGINT AS failed_last_minute FROM events WHERE event_type IN ('view', 'error')")
def q_queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    recent = (F.col("event_type") == "error") & (F.col("ts") >= F.col("last") - F.expr("interval 1 minute"))
    return events.where(F.col("event_type").isin("view", "error")).join(F.broadcast(last), F.lit(True)).agg(F.count("*").alias("outstanding"), F.count_if(recent).alias("failed_last_minute"))


@query("SELECT event_type, count(*) AS outstanding, (max((SELECT max(epoch_us(ts)) FROM events) - epoch_us(ts)) // 1000000)::BIGINT AS oldest_s FROM events GROUP BY event_type")
def q_queue_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type of event how many wait and how long the oldest has, as of the last event."""
    events = table(spark, sf_dir, "events").select("event_type", "ts")
    last = events.agg(F.max("ts").alias("last"))
    return queue.backlog(events.join(F.broadcast(last), F.lit(True)), F.col("last"), ["event_type"])


@query("SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' AND o_orderstatus IN ('O', 'P') GROUP BY 1")
def q_outstanding_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lines of orders that are open or in part: documents and their jobs."""
    documents = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linestatus").alias("status"))
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("job_status"), "o_orderpriority")
    found = queue.outstanding(documents, jobs, "job_id", document_states=["O"], job_states=["O", "P"])
    return found.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_event_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = queue.windowed_counts(table(spark, sf_dir, "events"))
    return out.withColumn("total", F.round("total", 4))


@query(
    "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200 THEN 0 ELSE 1 END AS new FROM events), "
    "n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) "
    "SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM n GROUP BY user_id, session"
)
def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.sessions(table(spark, sf_dir, "events"), 7200)


@query(
    "WITH s AS (SELECT unnest([0, 1, 2, 3]) AS k), w AS (SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS window_start, value FROM events, s) "
    "SELECT window_start, window_start + INTERVAL 4 HOUR AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY window_start"
)
def q_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hours from every hour on."""
    return queue.sliding_counts(table(spark, sf_dir, "events"), "4 hours", "1 hour").withColumn("total", F.round("total", 4))


@query(
    "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), "
    "n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM n GROUP BY user_id, session"
)
def q_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.session_windows(table(spark, sf_dir, "events"), "2 hours")
