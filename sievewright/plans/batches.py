"""Batches and runs as tables: overviews, pages, searches, statuses and the trail of rule compilation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

AUDIT_ROWS = 2000  # what an audit read takes, oldest first


def overview(batches: DataFrame, candidates: DataFrame, runs: DataFrame, *, batch: str = "batch_id") -> DataFrame:
    """batches with their numbers of candidates and runs, each counted before it is joined."""
    counted = [df.groupBy(batch).agg(F.count("*").alias(name)) for df, name in ((candidates, "candidates"), (runs, "runs"))]
    out = batches
    for counts in counted:
        out = out.join(counts, batch, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("candidates", "runs")})


def page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The rows behind a key, in its order: one more than a page, which tells whether another follows."""
    behind = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return behind.orderBy(key).limit(size + 1)


def search(rows: DataFrame, wanted: str, columns: list[str]) -> DataFrame:
    """Rows of which some column holds the text, whatever its case; a blank search finds all."""
    if not wanted.strip():
        return rows
    pattern = f"%{wanted.strip()}%"
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.ilike(F.col(c), F.lit(pattern)), F.lit(False))
    return rows.where(found)


def tail(trail: DataFrame, order: list[str], last: int, read: int = AUDIT_ROWS) -> DataFrame:
    """The last rows of the first ``read`` of a trail."""
    return trail.orderBy(*order).limit(read).orderBy(*[F.desc(c) for c in order]).limit(last)


def in_text_order(rows: DataFrame, ref: str, size: int) -> DataFrame:
    """The first rows by reference as text, in which 10 comes before 2."""
    return rows.orderBy(F.col(ref).cast("string")).limit(size)


def second_read(scores: DataFrame, borderline: DataFrame, ambiguous: DataFrame, key: list[str]) -> DataFrame:
    """Whom an ensemble reads again: those near the cut, and those that are ambiguous and scored."""
    near = borderline.select(*key)
    unsure = ambiguous.select(*key).join(scores.select(*key), key, "left_semi")
    return near.unionByName(unsure).distinct()


def cutoffs(ranked: DataFrame, size: int, by: str = "run_id", score: str = "score") -> DataFrame:
    """By run the score at place min(size, number of candidates), of ranked(run, rank, score)."""
    within = ranked.where(F.col("rank") <= size)
    return within.groupBy(by).agg(F.max_by(score, "rank").alias("cutoff"))


def run_status(batch_complete: Column, failed: Column, open_: Column) -> Column:
    """A run waits for its batch, then is running until nothing is open, and failed if anything failed."""
    return F.when(~batch_complete, "queued").when(open_ > 0, "running").when(failed > 0, "failed").otherwise("complete")


def staged(candidates: DataFrame, stage: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """candidates with the columns that a stage writes, for those it has a row for; null is written too.
    A stage may write the allowed columns only, and has one row for a key."""
    written = [c for c in stage.columns if c != key]
    if refused := sorted(set(written) - set(allowed)):
        raise ValueError(f"a stage may not write {', '.join(refused)}")
    new = stage.select(key, F.struct(*written).alias("_new"))
    joined = candidates.join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) for c in written}).drop("_new")


def orphans(stored: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """What is stored and nothing refers to."""
    return stored.join(referenced.select(key), key, "left_anti")


def routed(documents: DataFrame, error: str = "error") -> DataFrame:
    """documents with status: what could not be read goes to manual review, never to rejection; what
    leaked or is missing has failed."""
    status = F.when(F.col(error).isNull(), "ready").when(F.col(error).isin("leak", "missing"), "failed").otherwise("manual_review")
    return documents.withColumn("status", status)


def rule_trail(rules: DataFrame, at: Column, *, wording: str = "wording") -> DataFrame:
    """Audit rows of compiled rules(rule_id, wording): one for each verdict and one for each finding."""
    found = rules.withColumn("_findings", tx.risk_findings(F.col(wording)))
    risk = tx.highest_risk(F.col("_findings"))
    verdict = F.when(risk == "high", "rule_risky").otherwise("rule_applicable")
    first = F.array(F.struct(verdict.alias("event"), risk.alias("detail")))
    each = F.transform("_findings", lambda f: F.struct(F.lit("rule_risk_flagged").alias("event"), f["id"].alias("detail")))
    return found.select("rule_id", F.lit("compile").alias("stage"), at.alias("at"), F.explode(F.concat(first, each)).alias("e")).select("rule_id", "stage", "at", "e.*")


def gate(queries: DataFrame, *, wording: str = "wording", literals: str | None = None) -> DataFrame:
    """queries with findings and gate: rejected at a high risk of the wording or a literal, warned at a
    lower one, else open."""
    findings = tx.risk_findings(F.col(wording))
    if literals is not None:
        findings = tx.merged_findings(findings, tx.risk_findings(F.array_join(F.col(literals), "\n")))
    risk = tx.highest_risk(F.col("findings"))
    return queries.withColumn("findings", findings).withColumn("gate", F.when(risk == "high", "rejected").when(risk == "review", "warned").otherwise("open"))
