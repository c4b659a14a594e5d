"""Sharding by minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group that no cut divides. The groups are ordered by a hash of the
text; the smallest capacity for which filling shard after shard greedily needs no more than the
given number is found by binary search, and the cuts are made there. The driver never sees
groups: it searches over histograms of at most 65,536 and a few thousand more bins of the ordered
groups, with the cuts bounded from both sides, and asks Spark to split only those bins in which a
cut may fall, until the smallest feasible capacity over the true groups is certain.

Defined results: a null text counts as empty and all empties are one group; ties of size do not
matter; repeated rows are rows of a group; an empty table gives no rows; extra columns are carried
through, and result columns replace input columns of the same name.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

KEY_BITS = 63
FIRST_BITS = 16
STEP_BITS = 8
SPLITS_A_ROUND = 256


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def group_key(text: Column) -> Column:
    """63 bits in whose order the groups stand: all of CRC-32, then 31 bits of another hash."""
    text = F.coalesce(text, F.lit(""))
    return F.shiftleft(F.crc32(text), 31).bitwiseOR(F.xxhash64(text).bitwiseAND((1 << 31) - 1))


class _Segments:
    """Runs of neighbouring groups with their bytes; whole runs are known, their insides may not be."""

    def __init__(self, rows):
        self.rows = sorted(rows)  # (first key, bits, bytes, groups)
        self.ends = np.cumsum([r[2] for r in self.rows]).tolist()
        self.total = self.ends[-1]
        self.open = [r[3] > 1 for r in self.rows]

    def reach(self, start: int, capacity: int, hopeful: bool) -> int:
        """Where a shard from start ends at the latest; hopeful: if groups were as small as can be."""
        want = start + capacity
        k = bisect_right(self.ends, want)
        if k == len(self.ends):
            return self.total
        below = self.ends[k - 1] if k else 0
        return want if hopeful and self.open[k] else below

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity, hopeful)
            out.append(at)
        return out

    def smallest(self, shards: int, hopeful: bool) -> int:
        low, high = 0, self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, hopeful)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low


    def even_cuts(self, capacity: int, shards: int) -> list[int]:
        """Ends of shards within the capacity, the least of which is as large as it can be.

        From every end of a run it is known whether the rest can be cut into a number of shards
        between the bounds; of the ends that leave such a rest the one nearest the fair end is taken.
        """
        at = np.array([0, *self.ends], np.int64)
        last = np.searchsorted(at, at + capacity, "right")

        def completions(least: int) -> list[np.ndarray]:
            first = np.minimum(np.searchsorted(at, at + least), last)
            out = [np.arange(len(at)) == len(at) - 1]
            for _ in range(shards):
                known = np.concatenate(([0], np.cumsum(out[-1])))
                out.append(known[last] > known[first])
            return out

        low, high = 0, self.total // shards
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if completions(middle)[shards][0] else (low, middle - 1)
        rest, out, k = completions(low), [], 0
        for left in range(shards, 0, -1):
            begin = max(int(np.searchsorted(at, at[k] + low)), min(k + 1, len(at) - 1))
            ends = np.flatnonzero(rest[left - 1][begin : last[k]]) + begin
            k = int(ends[np.argmin(np.abs(at[ends] - (at[k] + (self.total - at[k]) / left)))])
            out.append(int(at[k]))
        return out


def _histogram(groups: DataFrame, bits: int) -> DataFrame:
    width = KEY_BITS - bits
    first = F.shiftleft(F.shiftright("key", width), width)
    return groups.groupBy(first.alias("first")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))


def _split(groups: DataFrame, segments: _Segments, chosen: list) -> _Segments:
    """The segments with the chosen ones, all of the same depth, taken apart."""
    bits = chosen[0][1]
    width = KEY_BITS - bits
    inside = groups.where(F.shiftleft(F.shiftright("key", width), width).isin([r[0] for r in chosen]))
    deeper = min(KEY_BITS, bits + STEP_BITS)
    split = [(r["first"], deeper, r["bytes"], r["n"]) for r in _histogram(inside, deeper).collect()]
    return _Segments([r for r in segments.rows if r not in set(chosen)] + split)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and the first keys of shards 1, 2, ... for groups(key, bytes)."""
    segments = _Segments([(r["first"], FIRST_BITS, r["bytes"], r["n"]) for r in _histogram(groups, FIRST_BITS).collect()] or [(0, FIRST_BITS, 0, 0)])
    while (low := segments.smallest(shards, True)) < (high := segments.smallest(shards, False)):
        near, far = segments.cuts(low, shards, False), segments.cuts(high, shards, True)
        wanted = []
        for k, row in enumerate(segments.rows):
            start = segments.ends[k] - row[2]
            if segments.open[k] and row[1] < KEY_BITS and any(start <= b and segments.ends[k] >= a for a, b in zip(near, far)):
                wanted.append(row)
        wanted = sorted(wanted, key=lambda r: -r[2])[:SPLITS_A_ROUND]
        # all bins of one round that have the same depth are split by one aggregation
        bits = min(r[1] for r in wanted)
        segments = _split(groups, segments, [r for r in wanted if r[1] == bits])
    ends = segments.even_cuts(high, shards)
    while len(segments.rows) < shards and any(o and r[1] < KEY_BITS for o, r in zip(segments.open, segments.rows)):
        # groups that share a bin, where there are fewer bins than shards
        bits = min(r[1] for o, r in zip(segments.open, segments.rows) if o and r[1] < KEY_BITS)
        segments = _split(groups, segments, [r for o, r in zip(segments.open, segments.rows) if o and r[1] == bits])
        ends = segments.even_cuts(high, shards)
    cuts = []
    for at in ends[:-1]:
        k = bisect_right(segments.ends, at)
        cuts.append(segments.rows[k][0] if k < len(segments.rows) else 1 << KEY_BITS)
    return high, cuts


def shard_of(key: Column, cuts: list[int]) -> Column:
    shard = F.lit(0)
    for cut in cuts:
        if cut < 1 << KEY_BITS:
            shard = shard + F.when(key >= F.lit(cut), 1).otherwise(0)
    return shard.cast("int")


def _cuts(keyed: DataFrame, shards: int, scratch: Scratch) -> list[int]:
    groups = scratch.save(keyed.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    _, cuts = minimax_cuts(groups, shards)
    scratch.drop("groups")
    return cuts


def assign_shards(docs: DataFrame, shards: int = 16, *, text: str = "text") -> DataFrame:
    """docs with the column ``shard``; the texts are not shuffled."""
    scratch = Scratch(docs.sparkSession, "shard")
    cuts = _cuts(docs.select(group_key(F.col(text)).alias("key"), text_size(F.col(text)).alias("size")), shards, scratch)
    return docs.withColumn("shard", shard_of(group_key(F.col(text)), cuts))


def shard_slots(docs: DataFrame, shards: int = 16, *, doc_id: str = "doc_id", text: str = "text", buckets: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, a row per document.

    Slots number the rows of a shard without gaps. Rows are numbered within buckets of their
    hash, and the buckets' offsets, at most shards x buckets of them, are broadcast.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    column = F.col(text)
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), text_size(column).alias("size"), F.crc32(F.coalesce(column, F.lit(""))).alias("text_crc32"), group_key(column).alias("key")
    )
    narrow = scratch.save(narrow, "narrow")
    cuts = _cuts(narrow, shards, scratch)
    bucket = F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int")
    dealt = narrow.withColumn("shard", shard_of(F.col("key"), cuts)).withColumn("bucket", bucket)
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "key")) - 1
    numbered = dealt.withColumn("within", within).join(F.broadcast(offsets), ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
