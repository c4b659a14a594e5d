"""What several operators share: scratch tables, text normalisation and components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Intermediate tables in the folder that all executors share.

    The folder is ``spark.checkpoint.dir``; only where that is unset and Spark runs in this one
    process (tests, a laptop) is a temporary one made, because executors elsewhere could not read
    it. ``save`` cuts lineage by writing Parquet, so a lost executor costs the tasks it ran and
    nothing before them. What a result still reads stays until the session ends.
    """

    _own: str | None = None

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            if Scratch._own is None:
                Scratch._own = tempfile.mkdtemp(prefix="sievewright-")
                atexit.register(shutil.rmtree, Scratch._own, True)
            base = f"file://{Scratch._own}"
        self.root = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        atexit.register(self._clean_at_exit)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing will read again."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clean(self) -> None:
        """Deletes all of them."""
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _clean_at_exit(self) -> None:
        if self.spark.sparkContext._jsc is not None:  # the session is still there
            self.clean()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that do not clash with those of df, for internal use."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- 64-bit hashing in numpy

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 to n - 1, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[s:e], equal for equal bytes; data is uint8."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


# ---------------------------------------------------------------- groups within a task


def sorted_groups(batches, keys: list[str]):
    """Runs of equal keys over sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        cuts = [*np.flatnonzero(change), batch.num_rows]
        at = 0
        for cut in cuts:
            if change[at] and held:
                yield pa.Table.from_batches(held)
                held = []
            if cut > at:
                held.append(batch.slice(at, cut - at))
            at = cut if cut < batch.num_rows else at
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def spanning_forest(near: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over the pairs of at least ``least``, after Prim."""
    n = len(near)
    best, parent = np.full(n, -1.0), np.full(n, -1)
    outside = np.ones(n, bool)
    edges = []
    for _ in range(n):
        k = int(np.argmax(np.where(outside, best, -2.0)))
        if best[k] >= least:
            edges.append((int(parent[k]), k))
        outside[k] = False
        closer = outside & (near[k] > best)
        best[closer] = near[k][closer]
        parent[closer] = k
    return edges


def forest(near: np.ndarray, symmetric: bool = False) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the graph whose pairs are marked, by breadth-first
    search; ``symmetric`` if rows and columns are the same nodes."""
    sides = (near, near) if symmetric else (near, np.ascontiguousarray(near.T))
    there = [np.ones(len(sides[1]), bool)] * 2 if symmetric else [np.ones(len(sides[1]), bool), np.ones(len(near), bool)]
    edges: list[tuple[int, int]] = []
    for root in np.flatnonzero(near.any(axis=1)):
        if not there[1][root]:
            continue
        there[1][root] = False
        waiting = [(0, int(root))]
        while waiting:
            side, node = waiting.pop()
            found = np.flatnonzero(sides[side][node] & there[side])
            there[side][found] = False
            edges += [(node, k) if side == 0 else (k, node) for k in found.tolist()]
            waiting += [(0 if symmetric else 1 - side, k) for k in found.tolist()]
    return edges


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the least node reachable.

    Alternates the large-star and small-star steps: each links nodes to the least neighbour
    of a node they touch, so no step makes more rows than there are edges, and the number of
    rounds grows with the logarithm of the component's size. A hub's neighbours are counted
    by partial aggregation and met again in a join that AQE can split, never in one group.
    """
    current = scratch.save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}-0"
    )
    before = None
    step = 0
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        step += 1
        following = scratch.save(small.where("u <> v").distinct(), f"{tag}-{step}")
        now = following.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        scratch.drop(f"{tag}-{step - 1}")
        current = following
        if now == before:
            break
        before = now
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


#: SQL for the least node reachable: needs nodes(id) and links(a, b) before it and gives component(id, least).
COMPONENTS_SQL = """reached AS (SELECT id, id AS other FROM nodes UNION SELECT reached.id, l.b FROM reached JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) AS l ON reached.other = l.a),
component AS (SELECT id, min(other) AS least FROM reached GROUP BY id)"""
