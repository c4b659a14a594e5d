"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

On a bounded sample of unit vectors, those whose hashes come first, the principal axes and rotations of
them are learnt, each by alternating signs and the best orthogonal map, so that a sign per axis balances
the bits and loses little of the angles. Substrings of the codes index Hamming tables, and vectors with
equal labels that share a substring are candidates. A substring's width grows with the number of vectors
that have the label, so that buckets stay small, and so does the number of tables: a pair at the threshold
differs in a bit with a probability of about 0.064, and there are as many tables as make all of them miss
it once in a hundred thousand; the tests measure recall against brute force. Vectors of other lengths
than the commonest get the signs of random maps instead of learnt ones and are looked up alike.
Candidates are reranked by the cosine of the original vectors in double precision, in the first table
that the pair shares.

Equal vectors with equal labels are one class and are counted, not compared. A bucket of more classes
than a block holds is compared block against block, each pair in one task; a task writes, per class,
the number of links and a spanning forest, never the pairs.

Defined results: a vector that is null, empty, zero or holds a null or a non-finite component, and one
whose label is null, links with nothing and is its own component; vectors of different lengths do not
link; rows that repeat an id count as vectors of their own; extra columns are not carried.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import COMPONENTS_SQL, Scratch, connected_components, forest, sorted_groups

SAMPLE = 20_000
BITS = 64  # of a rotation, at most
NARROWEST, WIDEST = 8, 28
BUCKET = 16  # classes that a bucket is meant to hold
MISSED = 1e-5
STEPS = 40
BLOCK = 4096
TILE = 512
MAX_BROADCAST_LABELS = 200_000


def tables(width: int, least: float) -> int:
    """How many substrings of that many bits miss a pair at the threshold at most MISSED of the time."""
    same = (1.0 - np.arccos(np.clip(least, -1.0, 1.0)) / np.pi) ** width
    return int(np.ceil(np.log(MISSED) / np.log1p(-min(same, 1.0 - 1e-9))))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 11) -> np.ndarray:
    """A map of unit vectors to at least so many axes, whose signs are the codes."""
    x = unit(sample)
    value, axes = np.linalg.eigh(x.T @ x / len(x))
    axes = axes[:, np.argsort(-value)][:, :BITS]
    projected = x @ axes
    out = []
    for k in range(-(-bits // axes.shape[1])):
        rotation, _ = np.linalg.qr(np.random.default_rng(seed + k).standard_normal((projected.shape[1],) * 2))
        for _ in range(STEPS):
            u, _, vt = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
            rotation = vt.T @ u.T
        out.append(axes @ rotation)
    return np.concatenate(out, axis=1)


@lru_cache(8)
def random_map(length: int, bits: int) -> np.ndarray:
    """The same map of vectors of that length in every task."""
    return np.random.default_rng(length).standard_normal((length, bits))


def substrings(vectors: np.ndarray, axes: np.ndarray, width: int, count: int) -> np.ndarray:
    """That many substrings of the codes, each of ``width`` bits."""
    bits = (unit(vectors) @ axes[:, : width * count] > 0).reshape(len(vectors), count, width)
    return (bits << np.arange(width)).sum(axis=2).astype(np.int32)


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: all components as doubles, the lists' offsets in them, and which lists are
    not null, empty or zero and hold nothing that is null or not finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy().astype(np.int64)

    def number(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[offsets[1:]] - total[offsets[:-1]]

    good = (number(~np.isfinite(values)) == 0) & (number(values != 0) > 0)
    return values, offsets, good & column.is_valid().to_numpy(zero_copy_only=False)


def _prepared(vectors: DataFrame, shared, length: int, double: bool, least: float) -> DataFrame:
    """vec_id, label, sig, raw and codes of vectors(vec_id, label, embedding, width); sig is null for those that link with nothing."""
    schema = T.StructType(
        [
            T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("label", vectors.schema["label"].dataType),
            T.StructField("sig", T.BinaryType()), T.StructField("raw", T.BinaryType()), T.StructField("codes", T.ArrayType(T.IntegerType())),
        ]
    )
    kind = np.float64 if double else np.float32

    def prepare(batches):
        for batch in batches:
            values, offsets, good = usable(batch.column("embedding"))
            good &= batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            labels = batch.column("label").to_pylist()
            sizes, width = np.diff(offsets), batch.column("width").to_numpy()
            sig, raw, codes = ([None] * batch.num_rows for _ in range(3))
            for size, bits in {(a, b) for a, b in zip(sizes[good].tolist(), width[good].tolist())}:
                at = np.flatnonzero(good & (sizes == size) & (width == bits))
                same = values[offsets[at][:, None] + np.arange(size)] + 0.0  # one zero
                count = tables(bits, least)
                axes = shared.value if size == length and shared.value is not None else random_map(size, bits * count)
                for k, row, code in zip(at, same.astype(kind), substrings(same, axes, bits, count)):
                    raw[k] = row.tobytes()
                    sig[k] = xxhash.xxh3_128_digest(raw[k], seed=xxhash.xxh3_64_intdigest(str(labels[k])))
                    codes[k] = code
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(sig, pa.binary()), pa.array(raw, pa.binary()), pa.array(codes, pa.list_(pa.int32()))], names=schema.names
            )

    return vectors.mapInArrow(prepare, schema)


def _near(one: pa.Table, two: pa.Table, length: int, kind, least: float, here: int) -> np.ndarray:
    """Which pairs of the rows of two tables, of vectors of one length, are linked and share no earlier table than ``here``."""

    def read(table):
        raw = np.frombuffer(b"".join(table.column("raw").to_pylist()), kind).reshape(table.num_rows, length)
        codes = np.asarray(table.column("codes").combine_chunks().flatten()).reshape(table.num_rows, -1)
        return unit(raw.astype(np.float64)), codes

    (u, a), (v, b) = read(one), read(two)
    out = np.zeros((len(u), len(v)), bool)
    for k in range(0, len(u), TILE):
        tile = out[k : k + TILE]
        tile[:] = u[k : k + TILE] @ v.T >= least
        for place in range(here if tile.any() else 0):
            tile &= a[k : k + TILE, place, None] != b[None, :, place]
    return out


def _links(members: DataFrame, least: float, double: bool) -> DataFrame:
    """From members of buckets: (a, null, links) for a class's links and (a, b, 0) for a forest."""
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("links", T.LongType())])
    kind = np.float64 if double else np.float32
    keys = ["key", "place", "block", "other"]

    def rerank(batches):
        for table in sorted_groups(batches, keys):
            if table.num_rows < 2:
                continue
            here, block, other = (table.column(c)[0].as_py() for c in keys[1:])
            own, length = table.column("own").to_numpy(), table.column("length").to_numpy()
            for size in np.unique(length).tolist():
                one = table.filter(pa.array((length == size) & (own == block)))
                two = one if block == other else table.filter(pa.array((length == size) & (own == other)))
                if not one.num_rows or not two.num_rows:
                    continue
                near = _near(one, two, size // np.dtype(kind).itemsize, kind, least, here)
                if block == other:
                    near &= near.T
                    np.fill_diagonal(near, False)
                first, second = one.column("sig").to_pylist(), two.column("sig").to_pylist()
                found = [(first, near @ two.column("n").to_numpy())]
                if block != other:
                    found.append((second, one.column("n").to_numpy() @ near))
                    edges = [(first[i], second[j]) for i, j in forest(near)]
                else:
                    edges = [(first[i], first[j]) for i, j in forest(near, symmetric=True)]
                counted = [(sig[k], int(links[k])) for sig, links in found for k in np.flatnonzero(links)]
                if counted:
                    a = [s for s, _ in counted] + [i for i, _ in edges]
                    b = [None] * len(counted) + [j for _, j in edges]
                    links = [n for _, n in counted] + [0] * len(edges)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], names=schema.names)

    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(rerank, schema)


def _with_widths(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vectors with the width of their label's substrings, and the largest width."""
    wide = F.ceil(F.log2(F.col("n") / BUCKET)).cast("int")
    labels = vectors.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET << NARROWEST)
    labels = labels.select(F.col("label").alias("of"), F.least(wide, F.lit(WIDEST)).alias("wide"))
    known = labels.agg(F.count("*").alias("n"), F.max("wide").alias("wide")).first()
    labels = F.broadcast(labels) if known["n"] <= MAX_BROADCAST_LABELS else labels
    joined = vectors.join(labels, F.col("label") == F.col("of"), "left").withColumn("width", F.coalesce("wide", F.lit(NARROWEST)))
    return joined.select("vec_id", "label", "embedding", "width"), known["wide"] or NARROWEST


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row per vector: vectors with equal labels and a
    cosine of at least ``least`` are linked; component_id is the least id reachable."""
    vectors = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    double = vectors.schema["embedding"].dataType.elementType == T.DoubleType()
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    common = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    length = common["d"] if common else 0
    rank = F.xxhash64("vec_id")
    fits = vectors.where(F.size("embedding") == length).select("vec_id", "embedding")
    share = min(1.0, 1.2 * SAMPLE / max(common["n"] if common else 1, 1))
    chosen = fits.where(F.pmod(rank, F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(rank, "vec_id").limit(SAMPLE)
    values, offsets, good = usable(chosen.select("embedding").toArrow().column(0))
    sample = values[offsets[:-1][good][:, None] + np.arange(length)]
    sized, widest = _with_widths(vectors)
    bits = max(w * tables(w, least) for w in range(NARROWEST, widest + 1))
    shared = spark.sparkContext.broadcast(learn_rotations(sample, bits) if len(sample) else None)

    prepared = scratch.save(_prepared(sized, shared, length, double, least), "prepared")
    classes = prepared.where("sig is not null").groupBy("sig").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("raw").alias("raw"), F.first("codes").alias("codes")
    )
    classes = scratch.save(classes, "classes")
    keyed = classes.select("sig", "label", F.posexplode("codes").alias("place", "code"), F.octet_length("raw").alias("length"))
    keyed = keyed.select("sig", "place", F.xxhash64("label", "place", "code", "length").alias("key"))
    shared_keys = keyed.groupBy("key", "place").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = keyed.join(shared_keys, ["key", "place"]).select("key", "place", "sig", blocks.alias("blocks"), F.pmod(F.xxhash64("sig"), blocks).cast("int").alias("own"))
    met = met.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "place", "sig", "own", F.least("own", "t").alias("block"), F.greatest("own", "t").alias("other"))
    payload = classes.select("sig", "n", "raw", "codes", F.octet_length("raw").alias("length"))
    found = scratch.save(_links(met.join(payload, "sig"), least, double), "found")

    edges = found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    component = connected_components(edges, scratch).withColumnRenamed("node", "sig")
    linked = found.where("b is null").groupBy(F.col("a").alias("sig")).agg(F.sum("links").alias("links"))
    of_class = classes.select("sig", "rep", "n").join(component, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    ids = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(ids, "component").join(linked, "sig", "left")
    of_class = of_class.select("sig", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = prepared.select("vec_id", "sig").join(of_class, "sig", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("sig").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The links of op10 by the cosine of all pairs within a label.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v AS x JOIN v AS y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings),
{COMPONENTS_SQL},
n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, least AS component_id, vec_id = least AS kept FROM embeddings JOIN component ON component.id = vec_id LEFT JOIN n ON n.id = vec_id
"""
