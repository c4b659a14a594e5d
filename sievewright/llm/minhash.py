"""Near-duplicate detection by b-bit MinHash, confirmed on full shingle sets.

A document's set holds its distinct shingles of five words. Documents with equal sets are one
class; classes are compared, copies are not. Of each class 256 minima are taken: 125 of them, by
fives, are the keys of 25 bands, and the low bits of all 256 are packed into 64 bytes. Classes
that share a band key are candidates; bit counts of their packed signatures, corrected for chance
agreement, estimate the similarity, and candidates well below the threshold go. The rest is
confirmed on the full sets in two rounds: first a spanning forest of each bucket, best estimates
first, which is enough to join a group however large; then, for classes with a candidate in another
component, the sets themselves are brought to the bucket and every such pair is decided there, in the
first band that the pair shares. Neither round writes out more than a forest, so rows grow with the
classes, not with their pairs. A bucket of more classes than a block holds is compared block by
block in separate tasks.

Defined results: a text that is null or has no words has no shingles, is linked with nothing and
is its own component; fewer than five words are one shingle; rows that repeat an id share its
component id, and the pipeline's filter keeps one of rows that agree in id and text; extra columns
are carried through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import COMPONENTS_SQL, Scratch, connected_components, fresh, mix, raw_texts, sorted_groups, span_hashes, spanning_forest

WORDS = 5
MINIMA = 256
BITS = 2
BANDS, ROWS = 25, 5
#: Five to six standard errors of the estimate at the threshold.
SLACK = 0.16
BLOCK = 1024
MAX_BROADCAST_IDS = 1_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_random = np.random.default_rng(20240607)
_SLOT = _random.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _random.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_IN_BAND = _random.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x5555555555555555)


def shingles(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    data = np.frombuffer((raw or b"").translate(_LOWER), np.uint8)
    inside = np.concatenate(([0], (data != 32).view(np.int8), [0]))
    edge = np.flatnonzero(np.diff(inside))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    word = span_hashes(data, starts, ends)
    width = min(words, len(word))
    count = len(word) - width + 1
    total = np.full(count, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += word[k : k + count] * _SLOT[k]
    return np.unique(mix(total))


def minima(found: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(found), 2048):
            out = np.minimum(out, (_FACTORS[:, None] * found[None, k : k + 2048]).min(axis=1))
    return out


def pack(least: np.ndarray) -> bytes:
    """The low bits of the minima, after mixing, 32 lanes of two bits to a word."""
    low = (mix(least) & np.uint64(3)).reshape(-1, 32)
    return (low << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = least[: BANDS * ROWS].reshape(BANDS, ROWS) * _IN_BAND
        return mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimates from packed signatures: agreement of lanes, less what chance gives."""
    differ = one ^ many
    differ = (differ | (differ >> np.uint64(1))) & _LANES
    agree = 1.0 - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) / MINIMA
    chance = 1.0 / (1 << BITS)
    return (agree - chance) / (1.0 - chance)


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, sig (digest of the set), packed and bands."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()),
            T.StructField("sig", T.BinaryType()), T.StructField("packed", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def sign(batches):
        for batch in batches:
            counts, sigs, packs, bands = [], [], [], []
            for raw in raw_texts(batch.column("text")):
                found = shingles(raw)
                counts.append(len(found))
                if len(found):
                    least = minima(found)
                    sigs.append(xxhash.xxh3_128_digest(found.tobytes()))
                    packs.append(pack(least))
                    bands.append(band_keys(least))
                else:
                    sigs.append(None)
                    packs.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary()), pa.array(packs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=schema.names,
            )

    return source.mapInArrow(sign, schema)


def _estimates(table: pa.Table, threshold: float) -> np.ndarray:
    packed = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint64).reshape(table.num_rows, -1)
    n = table.column("n_shingles").to_numpy().astype(float)
    out = np.full((len(n), len(n)), -1.0, np.float32)
    own = table.column("own").to_numpy()
    here = own == table.column("block")[0].as_py()
    # a table of two blocks is about the pairs between them, which no other task looks at
    one, two = np.flatnonzero(here), np.arange(len(n)) if here.all() else np.flatnonzero(~here)
    for k in range(0, len(one), 64):
        part = one[k : k + 64]
        near = similarity(packed[part, None, :], packed[None, two, :])
        out[np.ix_(part, two)] = near
        out[np.ix_(two, part)] = near.T
    out[np.minimum(n[:, None], n) < threshold * np.maximum(n[:, None], n) - 1e-9] = -1.0
    np.fill_diagonal(out, -1.0)
    return out


def _crossing(table: pa.Table, threshold: float) -> np.ndarray:
    """Candidate pairs (i < j) in different components whose first common band is this one."""
    _, component = np.unique(np.array(table.column("component").to_pylist(), object), return_inverse=True)
    near = np.triu((_estimates(table, threshold) >= threshold - SLACK) & (component[:, None] != component), 1)
    pairs = np.argwhere(near)
    if not len(pairs):
        return pairs
    bands = np.stack(table.column("bands").to_pylist())
    here = int(np.flatnonzero(bands[0] == table.column("key")[0].as_py())[0])
    keep = np.ones(len(pairs), bool)
    for band in range(here):
        keep &= bands[pairs[:, 0], band] != bands[pairs[:, 1], band]
    return pairs[keep]


_KEYS = ["key", "block", "other"]
_PAIR = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def _pair_batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.binary()), pa.array([max(p) for p in found], pa.binary())], names=["a", "b"])


def _forests(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of classes: for each bucket a forest of its best estimates."""

    def pairs(batches):
        for table in sorted_groups(batches, _KEYS):
            if table.num_rows > 1:
                sig = table.column("sig").to_pylist()
                yield _pair_batch([(sig[i], sig[j]) for i, j in spanning_forest(_estimates(table, threshold), threshold - SLACK)])

    return members.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(pairs, _PAIR).distinct()


def _unsettled(members: DataFrame, threshold: float) -> DataFrame:
    """The rows of members that are in a crossing pair, as (key, block, other, sig)."""
    schema = T.StructType([members.schema[k] for k in (*_KEYS, "sig")])

    def rows(batches):
        for table in sorted_groups(batches, _KEYS):
            if table.num_rows > 1 and len(at := np.unique(_crossing(table, threshold))):
                yield from table.select([*_KEYS, "sig"]).take(pa.array(at)).combine_chunks().to_batches()

    return members.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(rows, schema)


def _common(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The number of shingles that each pair of sets has in common."""
    lengths = np.array([len(s) for s in sets])
    if len(pairs) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    distinct, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), lengths), times[place] > 1
    column = (np.cumsum(times > 1) - 1)[place[shared]]
    row = row[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int((times > 1).sum()), 4096):
        inside = (column >= first) & (column < first + 4096)
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[inside], column[inside] - first] = 1.0
        common += part @ part.T
    return common[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _settled(members: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Linked pairs (a, b), a forest of each bucket, of members that carry their shingles."""

    def links(batches):
        for table in sorted_groups(batches, _KEYS):
            if table.num_rows > 1 and len(pairs := _crossing(table, threshold)):
                listed = table.column("shingles").combine_chunks()
                values, at = listed.values.to_numpy(), listed.offsets.to_numpy()
                sets = [values[a:b] for a, b in zip(at[:-1], at[1:])]
                common = _common(sets, pairs)
                lengths = np.array([len(s) for s in sets])
                linked = pairs[100 * common >= percent * (lengths[pairs].sum(axis=1) - common)]
                near = np.full((len(sets), len(sets)), -1.0)
                near[linked[:, 0], linked[:, 1]] = near[linked[:, 1], linked[:, 0]] = 1.0
                sig = table.column("sig").to_pylist()
                yield _pair_batch([(sig[i], sig[j]) for i, j in spanning_forest(near, 0.5)] if len(linked) else [])

    return members.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(links, _PAIR).distinct()


def _sets(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(sig, shingles) of the documents named by ids(rep)."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    wanted = F.broadcast(ids) if few else ids
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    schema = T.StructType([T.StructField("sig", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def build(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                found = [s for s in map(shingles, raw_texts(batch.column("text").slice(k, 256))) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                    names=["sig", "shingles"],
                )

    return chosen.select("text").mapInArrow(build, schema).groupBy("sig").agg(F.first("shingles").alias("shingles"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("sig").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("both"))
    return met.select("a", "b", (100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).alias("linked"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept, a row per document.

    Documents whose sets are similar to at least ``percent`` hundredths are linked; component_id is
    the least id reachable.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.save(signatures(docs, doc_id, text), "signed")
    classes = signed.where("n_shingles > 0").groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("packed").alias("packed"), F.first("bands").alias("bands")
    )
    classes = scratch.save(classes, "classes")
    keyed = classes.select(F.explode("bands").alias("key"), "sig")
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = keyed.join(shared, "key")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = met.select("key", "sig", blocks.alias("blocks"), F.pmod(F.xxhash64("sig"), blocks).cast("int").alias("s"))
    met = met.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("s", "t").alias("block"), F.greatest("s", "t").alias("other"), F.col("s").alias("own"), "sig")
    members = scratch.save(met.join(classes.select("sig", "n_shingles", "packed", "bands"), "sig"), "members")

    threshold = percent / 100
    pairs = scratch.save(_forests(members.drop("bands"), threshold), "pairs")
    involved = members.select("sig").distinct().join(classes.select("sig", "rep"), "sig").select("rep").distinct()
    sets = scratch.save(_sets(docs, involved, doc_id, text), "sets")
    tested = scratch.save(_confirmed(pairs, sets, percent), "tested")
    links = tested.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = scratch.save(connected_components(links, scratch, "first"), "found")

    labelled = members.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    labelled = scratch.save(labelled, "labelled")
    unsettled = scratch.save(_unsettled(labelled, threshold), "unsettled")
    more = scratch.save(_settled(unsettled.join(labelled, [*_KEYS, "sig"]).join(sets, "sig"), threshold, percent), "more")
    links = found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    final = scratch.save(connected_components(links, scratch, "last"), "final")
    scratch.drop("members", "pairs", "sets", "tested", "more", "found", "labelled", "unsettled")

    of_class = classes.select("sig", "rep").join(final.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    ids = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(ids, "component").select("sig", "component_id")
    out = signed.select("doc_id", "text_hash", "n_shingles", "sig").join(of_class, "sig", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """docs with one document of each component; columns as given.

    Null ids stand for no document in particular: such a row stays unless its component has an id.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    found = scratch.save(near_duplicates(docs, doc_id=doc_id, text=text, percent=percent), "found")
    goes = (~F.col("kept")) & F.col("component_id").isNotNull()
    keys = found.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(
        F.bool_and(goes).alias("goes"), F.count("*").alias("n")
    )
    marked = scratch.save(keys.where("goes or n > 1").select("id", "hash", "goes"), "marked")
    few = marked.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    name, goes_name, hashed, hash_name = fresh(docs, "mh_id", "mh_goes", "mh_hash", "mh_of")
    marked = marked.select(F.col("id").alias(name), F.col("hash").alias(hash_name), F.col("goes").alias(goes_name))
    marked = F.broadcast(marked) if few else marked
    joined = docs.withColumn(hashed, F.xxhash64(text)).join(marked, F.col(doc_id).eqNullSafe(F.col(name)) & (F.col(hashed) == F.col(hash_name)), "left")
    alone = joined.where(F.col(goes_name).isNull()).select(*docs.columns)
    repeated = joined.where(~F.col(goes_name)).dropDuplicates([doc_id, hashed]).select(*docs.columns)
    return alone.unionByName(repeated)


#: The links of op7 by counting common shingles of all pairs that have one.
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
nodes AS (SELECT doc_id AS id FROM documents),
{COMPONENTS_SQL}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least AS component_id, doc_id = least AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN component ON id = doc_id
"""
