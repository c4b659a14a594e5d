"""Hard negatives by block matrix multiplication over rows and dimensions.

Rows become integer vectors and are cut into pieces, packed matrices of the rows of one bucket of labels that were
read together. A task gets a panel of anchors and a stripe of pieces; it joins the pieces into tiles and multiplies
blocks of anchors with tiles, chunk by chunk of the dimensions, whose partial tiles it adds. A score tile is looked
through where it is made and then forgotten: no score is written or shuffled, and of each task only the best rows of
each list leave, which are merged over the stripes.

This is done twice, because windows are known only when positives are. Positives come from the rows of the anchor's
bucket of labels alone, negatives from all rows, so that a pair is multiplied little more than once. A list that is full
lets pass only what beats its last row; the first tiles of a task are narrow, so that lists fill before most rows come.

Every anchor meets every row by contract, so the work is anchors times rows. A panel's anchors with their lists take
PANEL bytes at most, a stripe STRIPE rows; a row is sent once for each panel, an anchor once for each stripe. Should the
lists that tasks leave take more than MAX_SCRATCH bytes, anchors are worked through in rounds.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no
part; vectors are padded with zeros to the longest (so an empty one scores 0 with all); rows that repeat an
id are rows of their own, and each that is an anchor is one; equal scores of equal ids stand in any order;
a label without another row has no positives, and a positive whose window is empty no rows. Components are
rounded down into 64 bits, and sums beyond 64 bits wrap. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

ANCHORS, ROWS, DIMS = 256, 1024, 32  # of a tile
NARROW = 64  # rows of a task's first tile
BUCKETS = 256  # of labels
FAN = 8  # panels made for the cores' sake
PANEL = 1 << 25  # bytes of a task's anchors and their lists
STRIPE = 1 << 20  # rows of a task
MAX_SCRATCH = 1 << 38  # bytes of lists that the tasks of a round leave
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

# ---------------------------------------------------------------- pieces

#: An anchor is a piece of its own as well. Row, id, label (a place in names) and part are packed arrays.
PIECE = "anchor long, anchor_id long, bucket int, n int, dims int, row binary, id binary, names array<string>, label binary, part binary"


def _rounded(values: np.ndarray) -> np.ndarray:
    """Doubles rounded down, those beyond 64 bits to the nearest that is not."""
    down = np.floor(values)
    inside = (down >= -(2.0**63)) & (down < 2.0**63)
    return np.where(inside, np.where(inside, down, 0).astype(np.int64), np.where(down < 0, LEAST, MOST))


def _cut(scale: float):
    """Pieces of the rows (row, id, label, bucket, anchor, v) whose components are all finite."""

    def cut(batches):
        for batch in batches:
            v = batch.column("v")
            sizes, values = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)  # a null is read as NaN
            bad = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~np.isfinite(values), out=bad[1:])
            ends = np.cumsum(sizes)
            good = bad[ends] == bad[ends - sizes]
            dims = int(sizes[good].max(initial=0))
            whole = np.zeros((int(good.sum()), dims), np.int64)
            with np.errstate(over="ignore"):
                whole[np.arange(dims) < sizes[good, None]] = _rounded(scale * values[np.repeat(good, sizes)])
            row, ids, bucket, anchor = (batch.column(c).to_numpy(zero_copy_only=False)[good] for c in ("row", "id", "bucket", "anchor"))
            label = batch.column("label").dictionary_encode()
            names, label = label.dictionary.to_pylist(), label.indices.to_numpy()[good]
            order = np.argsort(bucket, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
            out: dict[str, list] = {c.split()[0]: [] for c in PIECE.split(", ")}
            for at, is_anchor in chain(((g, False) for g in groups), ((k, True) for k in np.flatnonzero(anchor)[:, None])):
                part = whole[at]
                kind = next(k for k in (np.int16, np.int32, np.int64) if part.min(initial=0) >= np.iinfo(k).min and part.max(initial=0) <= np.iinfo(k).max)
                used, places = np.unique(label[at], return_inverse=True)
                piece = (row[at[0]] if is_anchor else None, ids[at[0]] if is_anchor else None, bucket[at[0]], len(at), dims, row[at].tobytes(), ids[at].tobytes(), [names[k] for k in used], places.astype(np.int32).tobytes(), part.astype(kind).tobytes())
                for column, value in zip(out.values(), piece, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.list_(pa.string())] + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out.values(), kinds, strict=True)], names=list(out))

    return cut


class Piece(NamedTuple):
    task: int
    anchor: int | None
    scores: list[int] | None  # of an anchor's positives, once they are known
    row: np.ndarray
    id: np.ndarray
    names: list[str]
    label: np.ndarray
    part: np.ndarray


def _read(batches) -> Iterator[Piece]:
    for batch in batches:
        plain = [batch.column(c).to_pylist() for c in ("task", "anchor", "scores", "n", "dims", "names")]
        packed = [batch.column(c) for c in ("row", "id", "label", "part")]
        for k, (task, anchor, scores, n, dims, names) in enumerate(zip(*plain, strict=True)):
            row, ids, label, part = (c[k].as_buffer() for c in packed)
            kind = np.dtype(f"i{part.size // (n * dims)}" if dims else np.int64)
            yield Piece(task, anchor, scores, np.frombuffer(row, np.int64), np.frombuffer(ids, np.int64), names, np.frombuffer(label, np.int32), np.frombuffer(part, kind).reshape(n, dims))


def _joined(pieces: list[Piece], numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids, labels as numbers, and the matrix of the pieces."""
    dims = max(p.part.shape[1] for p in pieces)
    parts = [p.part if p.part.shape[1] == dims else np.pad(p.part, ((0, 0), (0, dims - p.part.shape[1]))) for p in pieces]
    labels = [np.array([numbers.setdefault(s, len(numbers)) for s in p.names], np.int64)[p.label] for p in pieces]
    return np.concatenate([p.row for p in pieces]), np.concatenate([p.id for p in pieces]), np.concatenate(labels), np.concatenate(parts)


# ---------------------------------------------------------------- products


def exact(x: np.ndarray) -> np.ndarray:
    """x as floats, doubles or whole numbers: the first in which its products with all that are so held are exact.

    No partial sum of a product is larger than the product of the two vectors' lengths."""
    longest = math.sqrt(np.square(x, dtype=np.float64).sum(axis=1).max(initial=0))
    return x.astype(np.float32 if longest < 2.0**11 else np.float64 if longest < 2.0**25 else np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of what ``exact`` or 64-bit whole numbers hold."""
    if a.dtype != b.dtype and np.int64 in (a.dtype, b.dtype):
        a, b = a.astype(np.int64), b.astype(np.int64)
    return a @ b.T


def _scores(a: np.ndarray, b: np.ndarray, chunk: int) -> np.ndarray:
    """The score tile: the sum of the partial tiles of the chunks of dimensions that both have."""
    dims = min(a.shape[1], b.shape[1])
    total = product(a[:, : min(dims, chunk)], b[:, : min(dims, chunk)])
    for at in range(chunk, dims, chunk):
        total += product(a[:, at : min(dims, at + chunk)], b[:, at : min(dims, at + chunk)])
    return total


def _tiles(pieces: Iterable[Piece], wide: int, numbers: dict[str, int]):
    held: list[Piece] = []
    width = min(NARROW, wide)
    for piece in chain(pieces, [None]):
        if piece is not None:
            held.append(piece)
        n = sum(len(p.row) for p in held)
        if not n or piece is not None and n < wide:
            continue
        row, ids, label, part = _joined(held, numbers)
        held, at = [], 0
        while at < n:
            end = at + width if n - at > 1.5 * width else n
            yield row[at:end], ids[at:end], label[at:end], exact(part[at:end])
            at, width = end, min(2 * width, wide)


# ---------------------------------------------------------------- lists


def _marked(tile: np.ndarray) -> np.ndarray:
    """The places of a tile that are marked, where few are: eight are looked at at once."""
    flat = tile.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    near = 8 * np.flatnonzero(flat.view(np.uint64))[:, None] + np.arange(8)
    return near[flat[near]]


def _order(where: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order by list, then score, highest first, then id, then row."""
    span = int(score.max()) - int(score.min()) + 1
    if (int(where.max()) + 1) * span > MOST:
        return np.lexsort((row, ids, ~score, where))
    key = where * span + (score.max() - score)  # one sort, and another of what it leaves equal
    order = np.argsort(key)
    equal = np.diff(key[order]) == 0
    tied = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
    some = order[tied]
    order[tied] = some[np.lexsort((row[some], ids[some], key[some]))]
    return order


class _Panel:
    """Anchors, the windows of each, and the best rows found so far in each window: of the anchor's label, or of others."""

    def __init__(self, pieces: list[Piece], numbers: dict[str, int], wanted: int, same: bool, low: int, high: int, tall: int):
        self.row, _, self.label, part = _joined(pieces, numbers)
        self.blocks = [(at, exact(part[at : at + tall])) for at in range(0, len(part), tall)]
        self.wanted, self.same = wanted, same
        self.windows = max(1 if p.scores is None else len(p.scores) for p in pieces)
        first, last = (np.full((len(part), self.windows), x) for x in (MOST, LEAST))  # nothing is inside
        for at, piece in enumerate(pieces):
            if piece.scores is None:
                first[at], last[at] = LEAST, MOST
            for k, s in enumerate(piece.scores or []):
                if s >= 0:
                    first[at, k], last[at, k] = min(-(-low * s // 100), MOST), min(high * s // 100, MOST)
        self.least, self.most = first, last  # a row's score must reach the one and not exceed the other
        lists = len(part) * self.windows
        self.score, self.id, self.found = np.zeros((lists, wanted), np.int64), np.zeros((lists, wanted), np.int64), np.full((lists, wanted), -1)
        self.last_id = np.full(lists, MOST)  # where the score is the least, ids must not be larger
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n_waiting = 0

    def meet(self, row: np.ndarray, ids: np.ndarray, label: np.ndarray, part: np.ndarray, chunk: int) -> None:
        for begin, a in self.blocks:
            scores = _scores(a, part, chunk)
            least, most = self.least[begin : begin + len(a)], self.most[begin : begin + len(a)]
            near = _marked(scores >= least.min(axis=1).astype(scores.dtype)[:, None])
            if len(near) <= scores.size // 16:
                self._take(begin, scores, near, slice(None), row, ids, label)
            else:  # windows lie deep among the scores
                for k in range(self.windows):
                    inside = scores >= least[:, k].astype(scores.dtype)[:, None]
                    inside &= scores <= most[:, k].astype(scores.dtype)[:, None]
                    self._take(begin, scores, _marked(inside), slice(k, k + 1), row, ids, label)
            if self.n_waiting > max(4096, self.score.size // 2):
                self.merge()

    def _take(self, begin: int, scores: np.ndarray, near: np.ndarray, windows: slice, row: np.ndarray, ids: np.ndarray, label: np.ndarray) -> None:
        at, column = np.divmod(near, scores.shape[1])
        score, at = scores.ravel()[near].astype(np.int64), at + begin
        fits = (self.label[at] == label[column]) == self.same
        if self.same:
            fits &= self.row[at] != row[column]
        at, column, score = at[fits], column[fits], score[fits]
        hit, k = np.nonzero((score[:, None] >= self.least[at, windows]) & (score[:, None] <= self.most[at, windows]))
        where, column, score = at[hit] * self.windows + (windows.start or 0) + k, column[hit], score[hit]
        fits = (score > self.least.ravel()[where]) | (ids[column] <= self.last_id[where])
        column = column[fits]
        self.waiting.append((where[fits], score[fits], ids[column], row[column]))
        self.n_waiting += len(column)

    def merge(self) -> None:
        """The lists with all that waits."""
        if not self.n_waiting:
            return
        new = [np.concatenate(x) for x in zip(*self.waiting, strict=True)]
        self.waiting, self.n_waiting = [], 0
        told = np.zeros(len(self.found), bool)
        told[new[0]] = True
        touched = np.flatnonzero(told)
        there = self.found[touched] >= 0
        old = [np.repeat(touched, there.sum(axis=1)), *(x[touched][there] for x in (self.score, self.id, self.found))]
        where, score, ids, row = (np.concatenate(x) for x in zip(old, new, strict=True))
        order = _order(where, score, ids, row)
        where = where[order]
        begins = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        rank = np.arange(len(where)) - np.repeat(begins, np.diff(np.append(begins, len(where))))
        best = rank < self.wanted
        to = where[best], rank[best]
        for x, values in ((self.score, score), (self.id, ids), (self.found, row)):
            x[to] = values[order[best]]
        full = touched[self.found[touched, -1] >= 0]
        self.least.ravel()[full], self.last_id[full] = self.score[full, -1], self.id[full, -1]

    def lists(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for at in range(0, len(self.found), 1 << 13):
            where, k = np.nonzero(self.found[at : at + (1 << 13)] >= 0)
            where += at
            columns = [self.row[where // self.windows], where % self.windows + 1, self.found[where, k], self.id[where, k], self.score[where, k]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "place", "row", "id", "score"])


def _look(wanted: int, same: bool, low: int, high: int, sizes: tuple[int, int, int]):
    tall, wide, chunk = sizes

    def look(batches):
        for _, pieces in groupby(_read(batches), key=lambda p: p.task):
            numbers: dict[str, int] = {}
            anchors, rest = [], iter(())
            for piece in pieces:  # the anchors are first
                if piece.anchor is None:
                    rest = chain([piece], pieces)
                    break
                anchors.append(piece)
            if not anchors:
                continue
            panel = _Panel(anchors, numbers, wanted, same, low, high, tall)
            for tile in _tiles(rest, wide, numbers):
                panel.meet(*tile, chunk)
            yield from panel.lists()

    return look


# ---------------------------------------------------------------- the job


class Deal(NamedTuple):
    """The tasks of a bucket: panels of anchors times stripes of rows, numbered from first."""

    bucket: int
    panels: int
    stripes: int
    first: int


def _dealt(counts: dict[int, tuple[int, int]], panel: int, tall: int, wide: int, cores: int) -> list[Deal]:
    """counts: the rows and anchors of each bucket; panel: the anchors of a task. Where cores would wait, panels are made
    smaller, up to FAN of them because each is sent all rows, and then stripes shorter, which each begin their lists anew."""
    pairs = sum(n * m for n, m in counts.values())
    out: list[Deal] = []
    first = 0
    for bucket, (n, m) in sorted(counts.items()):
        if n and m:
            wanted = math.ceil(2 * cores * n * m / pairs)
            panels = max(math.ceil(m / panel), min(math.ceil(m / tall), wanted, FAN))
            stripes = max(math.ceil(n / STRIPE), min(math.ceil(n / wide), math.ceil(wanted / panels)))
            out.append(Deal(bucket, panels, stripes, first))
            first += panels * stripes
    return out


def _meet(anchors: DataFrame, rows: DataFrame, deals: list[Deal], look) -> DataFrame:
    """The best rows (anchor, place of the window, row, id, score) of each task."""
    spark = anchors.sparkSession
    deal = F.broadcast(spark.createDataFrame(deals, "bucket int, panels int, stripes int, first int"))
    columns = ["anchor", "scores", "n", "dims", "row", "id", "names", "label", "part"]
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    share = lambda of, count: F.pmod(F.xxhash64(of), F.col(count)).cast("int")
    panel, stripe = share("anchor", "panels"), share("row", "stripes")
    a = anchors.join(deal, "bucket").select(*columns, (F.col("first") + panel * F.col("stripes")).alias("begin"), each("stripes").alias("k")).select((F.col("begin") + F.col("k")).alias("task"), *columns)
    b = rows.join(deal, "bucket").select(*columns, "stripes", (F.col("first") + stripe).alias("begin"), each("panels").alias("k")).select((F.col("begin") + F.col("k") * F.col("stripes")).alias("task"), *columns)
    tasks = deals[-1].first + deals[-1].panels * deals[-1].stripes
    dealt = a.unionByName(b).repartitionById(tasks, F.col("task")).sortWithinPartitions("task", F.col("anchor").isNull())
    return dealt.mapInArrow(look, "anchor long, place long, row long, id long, score long")


def _first(df: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    """The best rows of each key with their rank; Spark keeps the best of each task before it shuffles them."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, max_scratch: int = MAX_SCRATCH, sizes: tuple[int, int, int] = (ANCHORS, ROWS, DIMS),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each row of which
    ``anchors`` (over vec_id) holds and each of its first ``positives`` rows of its label, the first ``negatives``
    rows of other labels whose score is ``low`` to ``high`` % of the positive's."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    columns = [F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor")]
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull()).select(*columns)
    rows = rows.select("*", F.monotonically_increasing_id().alias("row"), F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    pieces = scratch.save(rows.mapInArrow(_cut(float(scale)), PIECE), "pieces")
    of_rows = pieces.where(F.col("anchor").isNull()).withColumn("scores", F.lit(None).cast("array<long>"))
    of_anchors = pieces.where(F.col("anchor").isNotNull()).drop("scores")
    counts = {r.bucket: (r.n, r.m, r.dims) for r in pieces.groupBy("bucket").agg(F.sum(F.when(F.col("anchor").isNull(), F.col("n")).otherwise(0)).alias("n"), F.count("anchor").alias("m"), F.max("dims").alias("dims")).collect()}
    n, m, dims = sum(x[0] for x in counts.values()), sum(x[1] for x in counts.values()), max((x[2] for x in counts.values()), default=0)
    cores, kept = spark.sparkContext.defaultParallelism, positives * negatives
    panel = lambda kept: max(1, PANEL // (8 * dims + 24 * kept))
    stripes = max((d.stripes for d in _dealt({0: (n, m)}, panel(kept), *sizes[:2], cores)), default=1)
    rounds = max(1, math.ceil(40 * kept * m * stripes / max_scratch))
    out = None
    for k in range(rounds):
        some = of_anchors.where(F.pmod(F.xxhash64("anchor", F.lit("round")), F.lit(rounds)) == k)
        deals = _dealt({b: (x[0], math.ceil(x[1] / rounds)) for b, x in counts.items()}, panel(positives), *sizes[:2], cores)
        if not deals:
            break
        near = _meet(some.withColumn("scores", F.lit(None).cast("array<long>")), of_rows, deals, _look(positives, True, low, high, sizes))
        best = scratch.save(_first(near.drop("place"), ["anchor"], positives), f"positives-{k}")
        # by rank, because the place of a score is the rank of its positive
        scores = best.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
        deals = _dealt({0: (n, math.ceil(m / rounds))}, panel(kept), *sizes[:2], cores)
        everywhere = F.lit(0).alias("bucket")
        found = _meet(some.join(scores, "anchor").withColumn("bucket", everywhere), of_rows.withColumn("bucket", everywhere), deals, _look(negatives, False, low, high, sizes))
        hard = _first(found, ["anchor", "place"], negatives).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        known = best.select("anchor", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        part = scratch.save(hard.join(known, ["anchor", "place"]), f"negatives-{k}")
        scratch.drop(f"positives-{k}")
        out = part if out is None else out.unionByName(part)
    named = of_anchors.select("anchor", "anchor_id")
    if out is None:
        return named.limit(0).select("anchor_id", *(F.lit(None).cast(kind).alias(c) for c, kind in (("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))))
    return out.join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def with_noise(vectors: DataFrame) -> DataFrame:
    """vectors whose label moves on by one, modulo ten, where vec_id is divisible by seven: the query's table."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: The query with the scores of all rows with each anchor.
SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.id AS anchor_id, b.row AS row, b.id AS id, a.label = b.label AS same, coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.id % 100 = 0 AND a.row <> b.row),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, row) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.id, n.row) QUALIFY row_number() OVER w <= 10
"""
