"""Event streams: attempts and their retries, roll-ups of jobs, windows, sessions and late data.

Spark's scheduler, checkpoints and exactly-once sinks do what a work queue with leases would; what is
left to compute is what the events say. All of it is declared on DataFrames and runs on tables, and
the windowed and deduplicating parts on streams too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3
#: Seconds to wait after the first and after every later failure, and what may be tried again.
BACK_OFF_S = (30, 120)
RETRYABLE = ("TIMEOUT", "PARSER_FAILED", "OCR_FAILED")


def attempts(events: DataFrame, *, document: str = "document_id", ts: str = "event_ts", order: str = "event_id") -> DataFrame:
    """A row per failure in events(document, ts, order, kind, code): its attempt (the claims so far), what
    becomes of the document, and from when on it may be claimed again (null if it may not).

    Rows are ordered within a document, never across."""
    so_far = Window.partitionBy(document).orderBy(ts, order)
    claimed = events.withColumn("attempt", F.count_if(F.col("kind") == "claim").over(so_far))
    again = F.col("code").isin(*RETRYABLE) & (F.col("attempt") < MAX_ATTEMPTS)
    wait = F.when(F.col("attempt") <= 1, BACK_OFF_S[0]).otherwise(BACK_OFF_S[1])
    return claimed.where("kind = 'fail'").select(
        document, ts, order, "attempt", "code", F.when(again, "PENDING").otherwise("FAILED").alias("status"), F.when(again, F.timestamp_seconds(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 + wait)).alias("available_at")
    )


def first_of_each(events: DataFrame, keys: list[str], *, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Events without repeats; on a stream, repeats are known as long as the watermark keeps them."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def latest(changes: DataFrame) -> DataFrame:
    """The last state of each document."""
    return changes.groupBy("document_id").agg(F.max_by(F.struct("job_id", "status", "attempts"), F.struct("at", "attempts")).alias("s")).select("document_id", "s.*")


def job_status(documents: DataFrame, status: str = "status", job: str = "job_id") -> DataFrame:
    """PROCESSING while any document is open, then SUCCEEDED, FAILED or PARTIAL_SUCCESS."""
    good, bad = F.count_if(F.col(status) == "SUCCEEDED"), F.count_if(F.col(status) == "FAILED")
    verdict = F.when(good + bad < F.count("*"), "PROCESSING").when(bad == 0, "SUCCEEDED").when(good == 0, "FAILED").otherwise("PARTIAL_SUCCESS")
    return documents.groupBy(job).agg(verdict.alias("status"), good.alias("succeeded"), bad.alias("failed"))


def workers(outstanding: Column, most: int = 10, per_worker: int = 25) -> Column:
    """min(most, 1 + (n - 1) / per_worker), none for none."""
    return F.when(outstanding <= 0, 0).otherwise(F.least(F.lit(most), 1 + F.floor((outstanding - 1) / per_worker))).cast("long")


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Events by tumbling window and type; on a stream, late rows are taken up to the watermark."""
    if late and events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap_s: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions of a user, parted by gaps longer than gap_s seconds."""
    by_user = Window.partitionBy(user).orderBy(ts, "event_id")
    second = F.col(ts).cast("timestamp").cast("long")
    fresh = F.coalesce(second - F.lag(second).over(by_user) > gap_s, F.lit(True)).cast("int")
    numbered = events.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(by_user))
    return numbered.groupBy(user, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def sliding_counts(events: DataFrame, size: str, slide: str, *, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Events by sliding window: a row counts in each window of ``size`` that begins at a multiple of ``slide`` and holds it."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")


def session_windows(events: DataFrame, gap: str, *, user: str = "user_id", ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Sessions of a user, parted where ``gap`` or more passes without an event, on tables and streams alike; Spark merges
    the sessions of a task before it shuffles them. On a stream a session is given once the watermark has passed its end."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.max(ts).alias("ended"), F.count("*").alias("n")).select(user, F.col("w.start").alias("started"), "ended", "n")


def outstanding(documents: DataFrame, jobs: DataFrame, job: str, *, document_states: list[str], job_states: list[str], document_status: str = "status", job_status: str = "job_status") -> DataFrame:
    """Documents in one of the states whose job is in one of its own; both sides are filtered before they meet."""
    return documents.where(F.col(document_status).isin(*document_states)).join(jobs.where(F.col(job_status).isin(*job_states)), job)


def backlog(waiting: DataFrame, now: Column, by: list[str], *, ts: str = "ts") -> DataFrame:
    """By group how many rows wait and the seconds that the oldest has waited."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return waiting.groupBy(*by).agg(F.count("*").alias("outstanding"), F.floor(F.max(age) / 1e6).cast("long").alias("oldest_s"))
