"""Mixing sources to target weights: how many words of each source a training mix takes.

Words are counted per source; the sources' weights share the corpus's words; a target stops at
``max_repeats`` times its source's size and the excess is shared again among the rest, by weight,
until none is above. A document is then taken floor(rate) times plus one more time with the
fraction as probability, drawn from a hash of the seed and its id, so reruns and retries agree.

Defined results: a null text has size 0; null is a source of its own and comes last; rows that
repeat an id draw alike; an empty table gives an empty mix; a corpus without words has targets
of 0; extra columns are carried through and result columns replace input columns of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, source_size, target, rate) from sizes(source, size).

    One row per source after a partial aggregation, so the windows see sources, not documents.
    With the sources in the order of cap / weight, the level that the words of the first k caps
    leave for the rest rises until the first source that stays below its cap and falls from
    there; its maximum is the level at which all sources are filled.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    listed = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    level = (total - before).cast("double") / behind.cast("double")
    filled = listed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("weight").cast("double") * F.col("level"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    return filled.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def uniform(seed: int, doc_id: str | Column) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(name, 256), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def with_rates(docs: DataFrame, targets: DataFrame, source: str, max_broadcast_sources: int = 50_000) -> DataFrame:
    """docs with the target's columns. Few sources are broadcast; many are joined with the
    documents of each source dealt over 32 salts, so that a hot source meets no single task."""
    few = targets.limit(max_broadcast_sources + 1).count() <= max_broadcast_sources
    name, salt, dealt = fresh(docs, "mix_source", "mix_salt", "mix_dealt")
    targets = targets.withColumnRenamed("source", name)
    if few:
        return docs.join(F.broadcast(targets), F.col(source).eqNullSafe(F.col(name)), "left").drop(name)
    salted = targets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(31))))
    left = docs.withColumn(dealt, F.pmod(F.xxhash64(*docs.columns), F.lit(32)).cast("int"))
    return left.join(salted, F.col(source).eqNullSafe(F.col(name)) & (F.col(dealt) == F.col(salt)), "left").drop(name, salt, dealt)


def copies(seed: int, doc_id: str | Column, rate: str = "rate") -> Column:
    """floor(rate), and one more with the fraction as probability."""
    whole = F.floor(rate)
    return (whole + F.when(uniform(seed, doc_id) < F.col(rate) - whole, 1).otherwise(0)).cast("long")


def mix_counts(sized: DataFrame, *, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken for sized(doc_id, source, size)."""
    rated = with_rates(sized, source_targets(sized), "source")
    return rated.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(seed, "doc_id")).alias("taken"))


def mix_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: every document as often as it is taken; columns as given."""
    targets = source_targets(docs.select(F.col(source).alias("source"), word_count(text).alias("size")), weights, max_repeats)
    rate, size, target, n = fresh(docs, "mix_rate", "mix_size", "mix_target", "mix_copies")
    targets = targets.select("source", F.col("source_size").alias(size), F.col("target").alias(target), F.col("rate").alias(rate))
    rated = with_rates(docs, targets, source).withColumn(n, copies(seed, doc_id, rate).cast("int"))
    return rated.where(F.col(n) > 0).withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, CAST([1, 2, 3][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS weight FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), CAST(weight AS DOUBLE) * max(level) OVER ()) AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0 END AS rate, CAST(('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
