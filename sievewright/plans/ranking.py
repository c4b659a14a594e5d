"""Scores, borderline bands, ensembles and shortlists.

No run is sorted in one task: ranks come from counts by score and range of positions, the top k
from a bounded sort, and the band around the cut is a filter on its score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clause_score(value: Column, judged: Column | None = None) -> Column:
    """1 or 0 where a rule decides, else what a model said, else 0."""
    return F.coalesce(F.when(value, F.lit(1.0)).when(~value, F.lit(0.0)), judged if judged is not None else F.lit(None).cast("double"), F.lit(0.0))


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of scores, kept in 0 to 1, to four places."""
    total = sum((score * F.lit(float(w)) for score, w in parts), F.lit(0.0))
    return F.round(F.least(F.greatest(total / F.lit(float(sum(w for _, w in parts))), F.lit(0.0)), F.lit(1.0)), 4)


def depth_score(years: Column, target: float) -> Column:
    """min(1, y/t) x 0.8 and up to 0.2 for years beyond the target; null for years that are not known."""
    score = F.least(F.lit(1.0), years / target) * 0.8 + F.least(F.lit(0.2), F.greatest(F.lit(0.0), (years - target) / 20.0))
    return F.when(years.isNotNull(), score)  # least and greatest pass over nulls


def ranked(scores: DataFrame, by: str = "run_id", score: str = "score", position: str = "position", width: int = 100_000) -> DataFrame:
    """scores with rank, 1 for the best; ties keep the order of position, a number.

    A run may hold most of the rows, so it is not sorted in one task: rows are numbered within their
    run, score and range of positions, and the ranges' offsets come from counts of them. Scores are of
    four places, so a run has some ten thousand of them at most.
    """
    bin_ = F.floor(F.col(position) / width)
    binned = scores.withColumn("_bin", bin_)
    counts = binned.groupBy(by, score, "_bin").agg(F.count("*").alias("_n"))
    before = (Window.unboundedPreceding, -1)
    better = Window.partitionBy(by).orderBy(F.desc(score)).rowsBetween(*before)
    earlier = Window.partitionBy(by, score).orderBy("_bin").rowsBetween(*before)
    per_score = counts.groupBy(by, score).agg(F.sum("_n").alias("_n")).withColumn("_better", F.coalesce(F.sum("_n").over(better), F.lit(0))).drop("_n")
    offsets = counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").join(per_score, [by, score])
    within = F.row_number().over(Window.partitionBy(by, score, "_bin").orderBy(position))
    out = binned.withColumn("_within", within).join(offsets, [by, score, "_bin"])
    return out.select(*scores.columns, (F.col("_better") + F.col("_earlier") + F.col("_within")).cast("long").alias("rank"))


def top_k(scores: DataFrame, k: int, score: str = "score", position: str = "position") -> DataFrame:
    """The best k of one run, by a bounded sort."""
    return scores.orderBy(F.desc(score), F.asc(position)).limit(k)


def shortlist(scores: DataFrame, size: int, by: str = "run_id") -> DataFrame:
    """ranked scores with section: shortlist up to the size, below_cutoff after it."""
    return ranked(scores, by).withColumn("section", F.when(F.col("rank") <= size, "shortlist").otherwise("below_cutoff"))


def borderline(scores: DataFrame, size: int, margin: float, by: str = "run_id") -> DataFrame:
    """Scores within the margin of the cut; none if everybody or nobody is in."""
    marked = ranked(scores, by)
    cut = marked.where(F.col("rank").isin(size, size + 1)).groupBy(by).agg(F.max(F.when(F.col("rank") == size, F.col("score"))).alias("cutoff"), F.count("*").alias("_n"))
    return marked.join(cut.where("_n = 2").drop("_n"), by).where(F.abs(F.col("score") - F.col("cutoff")) <= margin)


def ensemble(votes: DataFrame, keys: list[str], cutoff: Column, score: str = "score", member: str = "member") -> DataFrame:
    """Median of the members' scores, votes to include, majority, unanimity, spread and the member
    that is nearest to the median (the first of equals)."""
    included = F.col(score) >= cutoff
    by = votes.groupBy(*keys).agg(
        F.median(score).alias("median_score"),
        F.count("*").alias("members"),
        F.count_if(included).alias("include_votes"),
        (F.max(score) - F.min(score)).alias("spread"),
        F.collect_list(F.struct(F.col(member).alias("member"), F.col(score).alias("score"))).alias("_all"),
    )
    nearest = F.array_min(F.transform("_all", lambda v: F.struct(F.abs(v["score"] - F.col("median_score")).alias("d"), v["member"].alias("member"))))
    return by.select(
        *keys, F.round("median_score", 4).alias("median_score"), "members", "include_votes",
        (2 * F.col("include_votes") > F.col("members")).alias("majority"),
        ((F.col("include_votes") == 0) | (F.col("include_votes") == F.col("members"))).alias("unanimous"),
        F.round("spread", 4).alias("spread"), nearest["member"].alias("representative"),
    )


def with_identity(entries: DataFrame, identities: DataFrame, key: str = "candidate_ref") -> DataFrame:
    """Identity put back on a finished shortlist, by a left join on the reference."""
    return entries.join(identities, key, "left")
