"""Benchmark decontamination: which training words lie inside passages of a test set.

A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one
window. The windows form a hash set, an array of hashes with the places of their words, that is
broadcast after the benchmark's size has been checked; each document is one pass over its words, and
every hit is verified on the very words. A benchmark beyond the bound gives the same results by a join
on window digests, before which documents drop the windows that a bitmap of fixed size does not know.

Defined results: a null or wordless text has no words and no hits; a null item text or id is no
item; items that share an id count once; repeated document rows each get their own result; extra
columns are carried through, and result columns replace input columns of the same name.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, raw_texts, span_hashes

#: A-Z become a-z; digits, letters and all bytes beyond ASCII are kept; the rest parts words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


class WindowSet:
    """The benchmark's vocabulary, its words end to end and, by length, its distinct windows: their hashes in
    order, a place where each stands, and the numbers of the items that have it, each once."""

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        listed = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(raw)], np.int32) for _, raw in items]
        self.words = np.concatenate([np.zeros(0, np.int32), *listed])
        sizes = np.array([len(x) for x in listed], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        for size in sorted({int(k) for k in np.minimum(sizes, n)} - {0}):
            which = np.flatnonzero(np.minimum(sizes, n) == size)
            at = np.concatenate([self.starts[k] + np.arange(sizes[k] - size + 1) for k in which])
            hashes = span_hashes(self.words, at, at + size)
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = self._classes(hashes[order], at[order], size)

    def _classes(self, hashes: np.ndarray, at: np.ndarray, size: int):
        """(hashes, places, offsets, items): a class for every distinct window, in the order of hashes; those of class k
        are items[offsets[k]:offsets[k + 1]]. Windows of one hash and other words are classes of their own."""
        place = np.zeros(len(at), np.int64)  # of the class of each window
        open_ = np.arange(len(at))
        while len(open_):
            h = hashes[open_]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            head = at[open_[np.flatnonzero(first)[np.cumsum(first) - 1]]]
            same = self._equal(self.words, at[open_], head, size)
            place[open_[same]] = head[same]
            open_ = open_[~same]
        order = np.lexsort((place, hashes))
        hashes, at, place = hashes[order], at[order], place[order]
        new = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
        of_class = np.cumsum(new) - 1
        item = np.searchsorted(self.starts, at, "right") - 1
        pairs = np.unique(of_class * np.int64(len(self.items)) + item)
        offsets = np.searchsorted(pairs, np.arange(int(new.sum()) + 1) * np.int64(len(self.items)))
        return hashes[new], place[new], offsets, pairs % max(len(self.items), 1)

    def _equal(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether the words at ids[a] are those of the benchmark at b."""
        out = np.ones(len(a), bool)
        for k in range(size):
            out &= ids[a + k] == self.words[b + k]
        return out

    def scan(self, raw: bytes | None) -> tuple[int, np.ndarray | None, set]:
        """The number of words, which of them are hit (None: no word), and the items' ids."""
        if not raw:
            return 0, None, set()
        found = words(raw)
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int32, len(found))
        known = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(ids > 0, out=known[1:])
        hit: set[int] = set()
        edge = np.zeros(len(ids) + 1, np.int64)
        for size, (hashes, places, offsets, items) in self.windows.items():
            at = np.flatnonzero(known[size:] - known[:-size] == size) if len(ids) >= size else np.zeros(0, np.int64)
            wanted = span_hashes(ids, at, at + size) if len(at) else np.zeros(0, np.uint64)
            low = np.searchsorted(hashes, wanted)
            while len(at):  # once, unless two windows of the benchmark have one hash
                there = hashes[np.minimum(low, len(hashes) - 1)] == wanted
                there &= low < len(hashes)
                at, wanted, low = at[there], wanted[there], low[there]
                same = self._equal(ids, at, places[low], size)
                np.add.at(edge, at[same], 1)
                np.add.at(edge, at[same] + size, -1)
                for k in np.unique(low[same]).tolist():
                    hit.update(items[offsets[k] : offsets[k + 1]].tolist())
                at, wanted, low = at[~same], wanted[~same], low[~same] + 1
        if not edge.any():
            return len(ids), None, set()
        return len(ids), np.cumsum(edge[:-1]) > 0, {self.items[k] for k in hit}


def contaminated_words(n_hit: int, n_words: int, one_in: int) -> bool:
    return n_hit > 0 and one_in * n_hit >= n_words


def _window_set(benchmark: DataFrame, text: str, item_id: str, n: int, max_words: int) -> WindowSet | None:
    """None if the benchmark may have more than max_words words. Within the bound the set takes 16 bytes a
    window and about a hundred a distinct word: a quarter of a gigabyte at the default, at worst."""
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text)
    size = items.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    if size > 2 * max_words:  # a word and the gap behind it take two bytes at least
        return None
    return WindowSet([(r[0], r[1].encode()) for r in items.toLocalIterator()], n)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 13,
    one_in: int = 20,
    max_broadcast_words: int = 4_000_000,
) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings) and contaminated, a row per document.

    A document is contaminated if at least one word in ``one_in`` is hit. A benchmark of more
    than ``max_broadcast_words`` words is matched by a shuffle join on window digests.
    """
    windows = _window_set(benchmark, item_text, item_id, n, max_broadcast_words)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if windows is None:
        return _find_by_join(docs, benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), n, one_in)
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("item_ids", T.ArrayType(T.StringType())),
            T.StructField("contaminated", T.BooleanType()),
        ]
    )

    def scan(batches):
        index = shared.value
        for batch in batches:
            n_words, n_hit, item_ids = [], [], []
            for raw in raw_texts(batch.column("text")):
                total, hit, items = index.scan(raw)
                n_words.append(total)
                n_hit.append(0 if hit is None else int(hit.sum()))
                item_ids.append(sorted(map(str, items)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(item_ids, pa.list_(pa.string())),
                    pa.array([contaminated_words(h, w, one_in) for h, w in zip(n_hit, n_words)], pa.bool_()),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(scan, schema)


BITMAP = 1 << 27  # bits


def _word_hashes(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Hashes of the words of a text, and the words."""
    lowered = raw.translate(_WORD_BYTES)
    data = np.frombuffer(lowered, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (data != 32).view(np.int8), [0]))))
    return span_hashes(data, edge[::2], edge[1::2]), lowered.split()


def _bitmap(item_windows: DataFrame) -> np.ndarray:
    """The bits of the window hashes, in an array of BITMAP bits whatever the benchmark's size."""
    bits = F.pmod("hash", F.lit(BITMAP))
    masks = item_windows.select(F.shiftright(bits, 6).alias("at"), F.expr("shiftleft(1L, int(pmod(hash, 64)))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP >> 6, np.int64)
    out[masks.column("at").to_numpy()] = masks.column("bits").to_numpy()
    return out


def _window_rows(sizes, bitmap, n: int):
    """Rows (key, at, size, hash, digest) of a text's windows: of all lengths in ``sizes`` that the bitmap
    knows, or without sizes of an item's own length."""

    def emit(batches):
        for batch in batches:
            keys, columns = [], [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int64)]
            digests: list[bytes] = []
            for row, raw in enumerate(raw_texts(batch.column("text"))):
                hashes, found = _word_hashes(raw or b"")
                for size in sizes or [min(n, len(found))]:
                    if not size or len(found) < size:
                        continue
                    at = np.arange(len(found) - size + 1)
                    window = (span_hashes(hashes, at, at + size) + np.uint64(size)).view(np.int64)
                    if bitmap is not None:
                        bit = np.mod(window, BITMAP)
                        keep = (bitmap.value[bit >> 6] >> (bit & 63)) & 1 == 1
                        at, window = at[keep], window[keep]
                    keys += [row] * len(at)
                    digests += [xxhash.xxh3_128_digest(b" ".join(found[k : k + size])) for k in at]
                    for column, values in zip(columns, (at, np.full(len(at), size, np.int32), window)):
                        column.append(values)
            made = [pa.array(np.concatenate(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), *made, pa.array(digests, pa.binary())], names=["key", "at", "size", "hash", "digest"])

    return emit


def _shape(df: DataFrame) -> T.StructType:
    kinds = (("at", T.LongType()), ("size", T.IntegerType()), ("hash", T.LongType()), ("digest", T.BinaryType()))
    return T.StructType([T.StructField("key", df.schema["key"].dataType), *(T.StructField(n, t) for n, t in kinds)])


def _text_key(text: str) -> Column:
    """What is found in a text depends on the text alone, so its digest is its key."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _hits_by_join(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, n: int) -> DataFrame:
    """(key, item_ids, hit) of the texts of docs that have hits; hit holds the numbers, from 0, of hit words."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("key"), F.col(item_text).alias("text"))
    item_windows = scratch.save(items.mapInArrow(_window_rows(None, None, n), _shape(items)).select("size", "hash", "digest", F.col("key").alias("item")).distinct(), "windows")
    sizes = sorted(r[0] for r in item_windows.select("size").distinct().collect())  # n values at most
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(item_windows))
    keyed = docs.where(F.col(text).isNotNull()).select(_text_key(text).alias("key"), F.col(text).alias("text"))
    sized = keyed.mapInArrow(_window_rows(sizes, bitmap, n), _shape(keyed)) if sizes else keyed.limit(0).mapInArrow(_window_rows([n], None, n), _shape(keyed))
    of_window = scratch.save(item_windows.groupBy("size", "digest").agg(F.collect_set("item").alias("items")), "items")
    found = scratch.save(sized.select("key", "at", "size", "digest").join(of_window.select("size", "digest"), ["size", "digest"]), "found")
    hit = found.select("key", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("word")).distinct()
    words_hit = hit.groupBy("key").agg(F.sort_array(F.collect_list("word")).alias("hit"))
    # a window that stands in many places of a text brings its items once
    named = found.select("key", "size", "digest").distinct().join(of_window, ["size", "digest"]).select("key", F.explode("items").alias("item")).distinct()
    return scratch.save(named.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("item_ids")).join(words_hit, "key"), "hits")


def _count_words(text: str) -> Column:
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_count(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def _find_by_join(docs: DataFrame, benchmark: DataFrame, n: int, one_in: int) -> DataFrame:
    """find_contamination for a benchmark too large to broadcast."""
    hits = _hits_by_join(docs, benchmark, "text", "item_id", "text", n)
    counted = docs.select("doc_id", _text_key("text").alias("key"), _count_words("text").alias("n_words"))
    n_hit = F.coalesce(F.size("hit"), F.lit(0)).cast("long")
    out = counted.join(hits, "key", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, one_in: int = 20, max_broadcast_words: int = 4_000_000) -> DataFrame:
    """docs without contaminated documents; columns as given."""
    windows = _window_set(benchmark, item_text, item_id, n, max_broadcast_words)
    if windows is None:
        key, of = fresh(docs, "key", "of")
        hits = _hits_by_join(docs, benchmark, text, item_id, item_text, n).select(F.col("key").alias(of), F.size("hit").alias("n_hit"))
        counted = docs.select(_text_key(text).alias(key), _count_words(text).alias("n_words")).distinct()
        bad = hits.join(counted, F.col(of) == F.col(key)).where(one_in * F.col("n_hit") >= F.col("n_words")).select(of)
        return docs.withColumn(key, _text_key(text)).join(bad, F.col(key) == F.col(of), "left_anti").drop(key)
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def keep(batches):
        index = shared.value
        for batch in batches:
            mask = []
            for raw in raw_texts(batch.column(text)):
                total, hit, _ = index.scan(raw)
                mask.append(hit is None or not contaminated_words(int(hit.sum()), total, one_in))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def _cut(raw: bytes, hit: np.ndarray) -> bytes:
    """The text without hit words and what stands between two of them."""
    data = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], data.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    run = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    parts, at = [], 0
    for a, b in zip(run[::2], run[1::2]):
        parts.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*parts, raw[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, max_broadcast_words: int = 4_000_000) -> DataFrame:
    """docs with every hit word, and what stands between two of them, cut out of the text."""
    windows = _window_set(benchmark, item_text, item_id, n, max_broadcast_words)
    names, place = docs.columns, docs.columns.index(text)
    shared = None if windows is None else docs.sparkSession.sparkContext.broadcast(windows)
    given = docs
    if windows is None:
        key, of, words_hit = fresh(docs, "key", "of", "hit")
        hits = _hits_by_join(docs, benchmark, text, item_id, item_text, n).select(F.col("key").alias(of), F.col("hit").alias(words_hit))
        given = docs.join(hits, _text_key(text) == F.col(of), "left").select(*docs.columns, words_hit)

    def hit_words(raw: bytes, listed) -> np.ndarray | None:
        if shared is not None:
            return shared.value.scan(raw)[1]
        return None if listed is None else np.bincount(listed, minlength=len(words(raw))) > 0

    def rewrite(batches):
        for batch in batches:
            column = batch.column(place)
            listed = batch.column(batch.num_columns - 1).to_pylist() if shared is None else [None] * batch.num_rows
            out = []
            for raw, numbers in zip(raw_texts(column), listed):
                hit = None if raw is None else hit_words(raw, numbers)
                out.append(raw if hit is None else _cut(raw, hit))
            changed = pa.array([None if x is None else x.decode() for x in out], column.type)
            columns = [changed if k == place else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return given.mapInArrow(rewrite, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from those of find_contamination."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bi AS (SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s FROM bi),
di AS (SELECT k, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l),
dw AS (SELECT k, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s FROM di),
h AS (SELECT k, item_id, dw.l, i FROM dw JOIN bw ON dw.l = bw.l AND dw.s = bw.s),
p AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(i, i + l)) AS x FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS j FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(j, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (k) LEFT JOIN t USING (k)
"""
