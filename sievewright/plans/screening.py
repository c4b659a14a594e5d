"""Screening: rules over profiles, outcomes per rule and per candidate, ad-hoc queries and audit rows.

A rule is a Verdict with an id. All rules of a set are columns of one projection over the profiles;
the long form unpivots them. A rule whose wording is of high risk is never applied.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.verdicts import Verdict


@dataclass(frozen=True)
class Rule:
    id: str
    verdict: Verdict
    wording: str = ""
    kind: str = "require"  # or prefer
    weight: float = 1.0


class RuleRefused(ValueError):
    """The wording reads as a proxy for a protected attribute."""


def wording_risks(df: DataFrame, column: str) -> DataFrame:
    """df with findings and risk of its rule wordings."""
    return df.withColumn("findings", text.risk_findings(F.col(column))).withColumn("risk", text.highest_risk(F.col("findings")))


def screen(profiles: DataFrame, rules: list[Rule], key: str = "candidate_ref") -> DataFrame:
    """A row per candidate and required rule: rule_id, value, reason."""
    required = [r for r in rules if r.kind == "require"]
    cells = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), r.verdict.value.alias("value"), r.verdict.reason.alias("reason")) for r in required])
    return profiles.select(key, F.explode(cells).alias("cell")).select(key, "cell.*")


def outcome(rules: list[Rule]) -> Column:
    """excluded if any rule is FALSE, else needs_manual_review if any is UNKNOWN, else eligible."""
    values = [r.verdict.value for r in rules if r.kind == "require"]
    if not values:
        return F.lit("eligible")
    together = reduce(Column.__and__, values)
    return F.when(~together, "excluded").when(together.isNull(), "needs_manual_review").otherwise("eligible")


def outcomes(profiles: DataFrame, rules: list[Rule], key: str = "candidate_ref") -> DataFrame:
    """A row per candidate, in one pass over the profiles; rules read only the fields they name."""
    return profiles.select(key, outcome(rules).alias("outcome"))


def counts_by(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows by value, with zero for values that do not occur."""
    dimension = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(dimension).join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def query(profiles: DataFrame, verdict: Verdict, key: str = "candidate_ref") -> DataFrame:
    """key, bucket (matched, not_matched or indeterminate) and reason."""
    bucket = F.when(verdict.value, "matched").when(~verdict.value, "not_matched").otherwise("indeterminate")
    return profiles.select(key, bucket.alias("bucket"), verdict.reason.alias("reason"))


def refuse_risky(rules: list[Rule], spark) -> list[Rule]:
    """The rules, unless the wording of one is of high risk."""
    rows = spark.createDataFrame([(r.id, r.wording) for r in rules], "id string, wording string")
    bad = [r["id"] for r in wording_risks(rows, "wording").where("risk = 'high'").collect()]  # one row per rule
    if bad:
        raise RuleRefused(f"wording of high risk: {', '.join(sorted(bad))}")
    return rules


def rule_views(rules: DataFrame) -> DataFrame:
    """(view, rule_id) for rules(rule_id, kind, verdict, parsed): applied (applicable and parsed), of these
    the requirements and the preferences, and flagged, the risky ones."""
    applied = (F.col("verdict") == "applicable") & F.col("parsed")
    views = {"applied": applied, "requirements": applied & (F.col("kind") == "require"), "preferences": applied & (F.col("kind") == "prefer"), "flagged": F.col("verdict") == "risky"}
    return rules.select(F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in views.items()]))).alias("view"), "rule_id")


def add_rule(rules: list[Rule], rule: Rule, spark) -> list[Rule]:
    if rule.id in {r.id for r in rules}:
        raise ValueError(f"there is a rule {rule.id} already")
    return [*rules, *refuse_risky([rule], spark)]


def remove_rule(rules: list[Rule], rule_id: str) -> list[Rule]:
    return [r for r in rules if r.id != rule_id]


def audit(df: DataFrame, stage: str, event: str, detail: Column, at: Column, key: str = "candidate_ref") -> DataFrame:
    """Rows for the append-only trail."""
    return df.select(F.col(key).cast("string").alias("subject"), at.alias("at"), F.lit(stage).alias("stage"), F.lit(event).alias("event"), F.to_json(F.struct(detail.alias("detail"))).alias("detail"))


def upsert_results(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values over old ones; a null keeps what was there."""
    others = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in others])
    return old.join(renamed, keys, "full_outer").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in others])
