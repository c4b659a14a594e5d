"""Places in an order, without a task that sees a whole group.

Rows are dealt to ranges of (group, order) whose bounds Spark samples from the composite order, sorted within
their range and written once, each with the number of its range and its place there. Counts by range and group
then say how many rows of the group stand in earlier ranges. A group that is a third of all rows fills a third
of the ranges; what is summed by one task is a row for each range that a group touches.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Written, fresh

ROWS_OF_A_RANGE = 1_000_000


def numbered(rows: DataFrame, by: list[str], order: list[str], *, into: str = "place", ranges: int | None = None) -> DataFrame:
    """rows with their place from 1 in the order within equal ``by``; nulls come first and are equal as a group.

    Rows that are equal in all of ``by`` and ``order`` are told apart by a hash of the whole row, and are numbered
    in any order if they are equal altogether. The ranges are as many as rows need at a million each.
    """
    tie, range_, at, first, before = fresh(rows, "tie", "range", "at", "first", "before")
    if ranges is None:
        ranges = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS_OF_A_RANGE))
    told = rows.withColumn(tie, F.xxhash64(*[F.to_json(F.struct(c)) if rows.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in rows.columns]))
    keys = [*by, *order, tie]
    # monotonically_increasing_id is the number of the partition and below it the place in the partition
    placed = told.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    placed = Written(placed.drop(tie).withColumn(range_, F.shiftright(at, 33))).rows
    counts = placed.groupBy(*by, range_).agg(F.min(at).alias(first), F.count("*").alias("n"))
    earlier = Window.partitionBy(*by).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, range_, first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    names = fresh(placed, *[f"of_{k}" for k in range(len(by) + 1)])
    offsets = offsets.select(*[F.col(c).alias(n) for c, n in zip([*by, range_], names)], first, before)
    same = F.col(range_) == F.col(names[-1])
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    out = placed.join(offsets, same)
    return out.select(*rows.columns, (F.col(at) - F.col(first) + F.col(before) + 1).alias(into))
