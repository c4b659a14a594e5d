"""Byte-level deduplication: every byte covered by a 200-byte string that also starts elsewhere.

A suffix array over the corpus is built blockwise, one suffix bucket at a time, after Kärkkäinen's
construction with a difference cover. A suffix's bucket is named by the least hash of the 48-byte
strings that start in its first 153 bytes: suffixes that agree in 200 bytes agree in the bucket and in
their distance from that string, the anchor. So the suffixes of a bucket are aligned at the anchor, and
every eighth byte from there is a cover of their differences: any two suffixes that are to be compared
reach a sampled column after the same number of bytes, less than eight. The samples are ranked first,
from the last column to the first, each by eight bytes and the rank of the next sample; then the
suffixes of each start are sorted by the bytes up to a sample and, where these tie, by that sample's
rank. Neighbours that agree in 200 bytes are repeats. A tie of any length costs one look at a rank, and
memory is bounded by the block.

Buckets whose name occurs once in the corpus hold no repeat and are never built: names are counted by
partial aggregation and met by a join. Equal strings of a bucket are one class, known by a digest; a
bucket of one class that occurs twice needs no sorting. The classes of the other buckets are cut, each
once, out of the text that holds its first occurrence, and dealt by bucket. A bucket of more classes than
a block holds is split by window. What a bucket finds goes back to the places it came from, and each text
is cut once.

Defined results: a null or empty text has no bytes and no spans; matches do not cross texts; rows that
agree in id and text are copies of each other and both lose what repeats; cutting may leave bytes that
are no longer UTF-8, which ``remove_repeats`` drops from the text; extra columns are carried through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, mix, powers, raw_texts, sorted_groups

LENGTH = 200
GRAM = 48
REACH = LENGTH - GRAM + 1  # starts of grams in a window
WIDTH = REACH - 1 + LENGTH  # the anchor's column is REACH - 1
PERIOD = 8  # of the sample columns
CHUNK = 1 << 19
BLOCK = 6000
MAX_BROADCAST_SPANS = 1_000_000


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of a text: place, name, first and last window start of each, and a
    digest of the string that these windows cover, aligned at the anchor."""
    n = len(raw) - LENGTH + 1
    places, firsts, lasts = ([] for _ in range(3))
    names, digests = [], []
    data = np.frombuffer(raw, np.uint8)
    for begin in range(0, n, CHUNK):
        starts = min(CHUNK, n - begin)
        part = data[begin : begin + starts + LENGTH - 1]
        up, down = powers(len(part) + 1)
        grams = len(part) - GRAM + 1
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part + np.uint64(1)) * up[:-1], out=total[1:])
            name = mix((total[GRAM:] - total[:grams]) * down[:grams])
        least = (name & ~np.uint64((1 << 20) - 1)) | np.arange(grams, dtype=np.uint64)
        size = 1
        while size * 2 <= REACH:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < REACH:
            least = np.minimum(least[: len(least) - (REACH - size)], least[REACH - size :])
        at = (least & np.uint64((1 << 20) - 1)).astype(np.int64)[:starts]
        edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        places.append(at[edge] + begin)
        names.append(name[at[edge]])
        last = np.r_[edge[1:] - 1, starts - 1]
        with np.errstate(over="ignore"):
            whole = mix((total[last + LENGTH] - total[edge]) * down[edge])
            digests.append(mix(whole + ((at[edge] - edge) * 512 + last - edge).astype(np.uint64)))
        firsts.append(edge + begin)
        lasts.append(last + begin)
    if not places:
        nothing, none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return nothing, none, nothing, nothing, none
    return tuple(map(np.concatenate, (places, names, firsts, lasts, digests)))


def sorted_repeats(strings: np.ndarray, bucket: np.ndarray, begin: np.ndarray, end: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which windows repeat: a row per string, a column per start.

    strings holds a string per row, aligned at the anchor and filled up with zeros; windows of row u
    start at columns begin[u] to end[u]; often tells which strings occur more than once as they are.
    Rows are sorted by bucket.
    """
    n = len(strings)
    out = np.zeros((n, REACH), bool)
    padded = np.zeros((n, WIDTH + 2 * PERIOD), np.uint8)
    padded[:, :WIDTH] = strings
    word = np.ndarray((n, WIDTH + PERIOD), ">u8", padded, strides=(padded.shape[1], 1))
    columns = range(0, WIDTH + PERIOD, PERIOD)
    rank = {columns[-1] + PERIOD: bucket.astype(np.int64)}

    def ranked(first: np.ndarray, following: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of rows by bucket, first and following, and where the key changes."""
        order = np.lexsort((following, first, bucket[rows]))
        changed = np.ones(len(rows), bool)
        a, b, c = first[order], following[order], bucket[rows][order]
        changed[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        return order, changed

    everything = np.arange(n)
    for column in reversed(columns):
        order, changed = ranked(word[:, column].astype(np.uint64), rank[column + PERIOD], everything)
        rank[column] = np.empty(n, np.int64)
        rank[column][order] = np.cumsum(changed)
    for start in range(REACH):
        rows = np.flatnonzero((begin <= start) & (end >= start))
        if not len(rows):
            continue
        out[rows, start] = often[rows]
        gap = -start % PERIOD
        head = word[rows, start].astype(np.uint64) >> np.uint64(8 * (PERIOD - gap)) if gap else np.zeros(len(rows), np.uint64)
        order, _ = ranked(head, rank[start + gap][rows], rows)
        rows = rows[order]
        windows = padded[rows, start : start + LENGTH]
        same = (windows[1:] == windows[:-1]).all(axis=1) & (bucket[rows[1:]] == bucket[rows[:-1]])
        out[rows[1:][same], start] = True
        out[rows[:-1][same], start] = True
    return out


def _runs(flags: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.view(np.int8), 0]))
    return edge.reshape(-1, 2)


_ANCHORED = "id_hash binary, name long, digest long, off int, size int, start long"


def _anchored(docs: DataFrame) -> DataFrame:
    """A row per anchor of docs(id_hash, text)."""

    def emit(batches):
        for batch in batches:
            owner, columns = [], []
            for row, raw in enumerate(raw_texts(batch.column("text"))):
                if raw and len(raw) >= LENGTH:
                    place, name, first, last, digest = anchors(raw)
                    owner.append(np.full(len(place), row))
                    columns.append((name.view(np.int64), digest.view(np.int64), (place - first).astype(np.int32), (last - first + LENGTH).astype(np.int32), first))
            if owner:
                made = [pa.array(np.concatenate(c)) for c in zip(*columns)]
                yield pa.RecordBatch.from_arrays([batch.column("id_hash").take(pa.array(np.concatenate(owner))), *made], names=["id_hash", "name", "digest", "off", "size", "start"])

    return docs.select("id_hash", "text").mapInArrow(emit, _ANCHORED)


def _strings(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The strings of classes(name, digest, n, m, off, size, rep), each cut from the one text that rep names."""
    fields = F.struct("name", "digest", "n", "m", "off", "size", F.col("rep.start").alias("start"))
    wanted = classes.groupBy(F.col("rep.id_hash").alias("id_hash")).agg(F.collect_list(fields).alias("wanted"))

    def cut(batches):
        for batch in batches:
            for row, raw in enumerate(raw_texts(batch.column("text"))):
                listed = pa.Table.from_struct_array(batch.column("wanted")[row].values)
                start, size = listed.column("start").to_numpy(), listed.column("size").to_numpy()
                string = pa.array([raw[a : a + n] for a, n in zip(start.tolist(), size.tolist())], pa.binary())
                yield from listed.select(["name", "digest", "n", "m", "off"]).append_column("string", string).to_batches()

    return docs.join(wanted, "id_hash").select("text", "wanted").mapInArrow(cut, "name long, digest long, n long, m long, off int, string binary")


_SPANS = "name long, digest long, spans array<long>"


def _settled(strings: DataFrame) -> DataFrame:
    """(name, digest, spans): the covered spans of each string, from its start, as [a, b, a, b, ...]."""

    def sort(batches):
        held: list[pa.Table] = []
        rows = 0

        def settle():
            table = pa.concat_tables(held).combine_chunks()
            values, off = table.column("string").to_pylist(), table.column("off").to_numpy().astype(np.int64)
            name, often = table.column("name").to_numpy(), table.column("n").to_numpy() > 1
            lengths = np.array([len(v) for v in values])
            begin = REACH - 1 - off
            matrix = np.zeros((len(values), WIDTH), np.uint8)
            for k, v in enumerate(values):
                matrix[k, begin[k] : begin[k] + len(v)] = np.frombuffer(v, np.uint8)
            bucket = np.cumsum(np.r_[0, name[1:] != name[:-1]])
            found = sorted_repeats(matrix, bucket, begin, begin + lengths - LENGTH, often)
            spans = []
            for k in range(len(values)):
                runs = _runs(found[k]) - begin[k]
                runs[:, 1] += LENGTH - 1
                spans.append(runs.ravel())
            keep = np.array([len(s) > 0 for s in spans])
            return pa.RecordBatch.from_arrays(
                [table.column("name").combine_chunks().filter(pa.array(keep)), table.column("digest").combine_chunks().filter(pa.array(keep)), pa.array([s for s in spans if len(s)], pa.list_(pa.int64()))],
                names=["name", "digest", "spans"],
            )

        for table in sorted_groups(batches, ["name"]):
            held.append(table)
            rows += table.num_rows
            if rows >= BLOCK:
                yield settle()
                held, rows = [], 0
        if held:
            yield settle()

    return strings.repartition("name").sortWithinPartitions("name").mapInArrow(sort, _SPANS)


def _settled_apart(strings: DataFrame, scratch: Scratch) -> DataFrame:
    """As _settled, for buckets of more strings than a block holds: such a bucket is split by window
    start and by the window itself, so equal windows meet by partial aggregation and none fills a task."""

    def expand(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for name, digest, n, off, value in zip(*(batch.column(c).to_pylist() for c in ("name", "digest", "n", "off", "string"))):
                for k in range(len(value) - LENGTH + 1):
                    for column, x in zip(out, (name, digest, n, k - off, xxhash.xxh3_128_digest(value[k : k + LENGTH]))):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["name", "digest", "n", "at", "window"])

    def join(batches):
        for batch in batches:
            spans = []
            for starts in batch.column("starts"):
                starts = np.sort(starts.values.to_numpy().astype(np.int64))
                spans.append(_merged(np.stack([starts, starts + LENGTH], axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("digest"), pa.array(spans, pa.list_(pa.int64()))], names=["name", "digest", "spans"])

    windows = strings.mapInArrow(expand, "name long, digest long, n long, at int, window binary")
    windows = scratch.save(windows.join(strings.select("name", "digest", "off"), ["name", "digest"]), "windows")
    repeated = windows.groupBy("name", "at", "window").agg(F.sum("n").alias("times")).where("times > 1")
    hits = windows.join(repeated, ["name", "at", "window"]).groupBy("name", "digest").agg(F.collect_list(F.col("at") + F.col("off")).alias("starts"))
    return hits.mapInArrow(join, _SPANS)


def _merged(spans: np.ndarray) -> list[int]:
    """Overlapping and touching spans made one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.stack([spans[first, 0], reach[np.r_[first[1:], True]]], axis=1).ravel().tolist()


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id_hash, spans) for docs(id_hash, text): the spans of bytes that go, as [a, b, a, b, ...]."""
    anchored = scratch.save(_anchored(docs), "anchored")
    # written first: a join of two plain shuffles is one that AQE can split at a hot name
    shared = scratch.save(anchored.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "shared")
    met = scratch.save(anchored.join(shared, "name", "left_semi"), "met")
    scratch.drop("anchored", "shared")
    classes = met.groupBy("name", "digest").agg(F.count("*").alias("n"), F.min(F.struct("id_hash", "start")).alias("rep"), F.first("off").alias("off"), F.first("size").alias("size"))
    classes = scratch.save(classes, "classes")
    classes = classes.join(classes.groupBy("name").agg(F.count("*").alias("m")), "name")
    strings = scratch.save(_strings(docs, classes.where("m > 1")), "strings")
    alone = classes.where("m = 1 and n > 1").select("name", "digest", F.array(F.lit(0).cast("long"), F.col("size").cast("long")).alias("spans"))
    settled = alone.unionByName(_settled(strings.where(F.col("m") <= BLOCK)))
    large = strings.where(F.col("m") > BLOCK)
    settled = settled.unionByName(_settled_apart(large.drop("m"), scratch)) if not large.isEmpty() else settled
    settled = scratch.save(settled, "settled")
    back = met.select("id_hash", "name", "digest", "start").join(settled, ["name", "digest"])
    back = back.groupBy("id_hash").agg(F.collect_set(F.struct("start", "spans")).alias("found"))

    def merge(batches):
        for batch in batches:
            out = []
            for found in batch.column("found").to_pylist():
                out.append(_merged(np.concatenate([np.asarray(f["spans"], np.int64) + f["start"] for f in found]).reshape(-1, 2)))
            yield pa.RecordBatch.from_arrays([batch.column("id_hash"), pa.array(out, pa.list_(pa.int64()))], names=["id_hash", "spans"])

    merged = scratch.save(back.mapInArrow(merge, "id_hash binary, spans array<long>"), "merged")
    scratch.drop("met", "classes", "strings", "settled", "windows")
    return merged


def _with_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs as the struct ``row``, with ``text`` and ``spans``."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    key = F.unhex(F.substring(F.sha2(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("\x00"), F.coalesce(F.col(text), F.lit(""))), 256), 1, 32))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("id_hash"), F.col(text).alias("text"))
    spans = repeated_spans(keyed.select("id_hash", "text"), scratch)
    few = (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= 2 * MAX_BROADCAST_SPANS
    return keyed.join(F.broadcast(spans) if few else spans, "id_hash", "left").select("row", "text", "spans")


def _kept(raw: bytes, spans: list[int] | None) -> bytes:
    if not spans:
        return raw
    cut = [0, *spans, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cut[::2], cut[1::2]))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated bytes cut out of the text; columns as given."""
    joined = _with_spans(docs, doc_id, text)

    def cut(batches):
        for batch in batches:
            out = [None if raw is None else _kept(raw, spans).decode("utf-8", "ignore") for raw, spans in zip(raw_texts(batch.column("text")), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType())])
    return joined.mapInArrow(cut, schema).select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, a row per document."""
    joined = _with_spans(docs.select("doc_id", "text"), "doc_id", "text").select(F.col("row.doc_id").alias("doc_id"), "text", "spans")

    def digest(batches):
        for batch in batches:
            total, gone, spans_out, sha = [], [], [], []
            for raw, spans in zip(raw_texts(batch.column("text")), batch.column("spans").to_pylist()):
                raw, spans = raw or b"", spans or []
                kept = _kept(raw, spans)
                total.append(len(raw))
                gone.append(len(raw) - len(kept))
                spans_out.append(len(spans) // 2)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans_out, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = T.StructType([joined.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(digest, schema)


#: The query's rows, by counting every window of the corpus.
SQL = """WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT k, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200),
windows AS (SELECT k, i, md5_number(b[i + 1 : i + 200]) AS w FROM starts),
often AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hit AS (SELECT k, i FROM windows SEMI JOIN often USING (w)),
run AS (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM hit),
numbered AS (SELECT k, i, sum(opens) OVER (PARTITION BY k ORDER BY i) AS r FROM run),
span AS (SELECT k, r, min(i) AS a, max(i) + 200 AS e FROM numbered GROUP BY k, r),
piece AS (SELECT k, r, coalesce(lag(e) OVER (PARTITION BY k ORDER BY r), 0) AS a, a AS e FROM span UNION ALL SELECT k, max(r) + 1, max(e), NULL FROM span GROUP BY k),
cut AS (SELECT p.k, string_agg(hex(d.b[p.a + 1 : coalesce(p.e, octet_length(d.b))]), '' ORDER BY p.r) AS h FROM piece AS p JOIN d USING (k) GROUP BY p.k),
gone AS (SELECT k, sum(e - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY k)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN gone USING (k) LEFT JOIN cut USING (k)"""
