"""Answers kept by what was asked: each question of each distinct profile is put once, ever.

The key is the content: the SHA-256 of the profile's text, the ensemble and the question. What is asked for is
reduced to distinct keys, keys that the store has are set aside by an anti-join, and only the others reach the
votes; the answers are joined back to everybody who has that profile. A profile that fills the corpus is one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("ensemble", "digest", "question")


def keyed(wanted: DataFrame, text: str, ensemble: str) -> DataFrame:
    """wanted(question, text) with digest and ensemble; a null text is that of an empty profile."""
    return wanted.withColumn("digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withColumn("ensemble", F.lit(ensemble))


def unanswered(wanted: DataFrame, stored: DataFrame, text: str) -> DataFrame:
    """The distinct keys of keyed rows that the store lacks, with the profile's text once."""
    missing = wanted.select(*KEY).distinct().join(stored.select(*KEY), list(KEY), "left_anti")
    texts = wanted.join(missing.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first(text).alias(text))
    return missing.join(texts, "digest").select(*KEY, text)


def combined(votes: DataFrame) -> DataFrame:
    """KEY and value of votes(KEY, value): true or false by a majority of all votes, null included; else null."""
    yes, no, n = F.count_if(F.col("value")), F.count_if(~F.col("value")), F.count("*")
    return votes.groupBy(*KEY).agg(F.when(2 * yes > n, True).when(2 * no > n, False).alias("value"), n.alias("votes"))


def remembered(wanted: DataFrame, stored: DataFrame, answered: DataFrame) -> DataFrame:
    """Keyed rows with value and votes, from the store or from what was answered now; null where neither has it."""
    columns = [*KEY, "value", "votes"]
    known = stored.select(*columns).unionByName(answered.select(*columns)).dropDuplicates(list(KEY))
    return wanted.join(known, list(KEY), "left")


def evidence_holds(vote_evidence: Column, text: Column) -> Column:
    """A vote counts if what it quotes stands in the profile."""
    from ..functions.text import evidence_found

    return evidence_found(vote_evidence, text)
