"""Collocations by hierarchical pair naming.

Texts are lower-cased, split into pieces at punctuation and line ends, and pieces into words. Frequent
words get ids; two ids side by side are a pair, pairs are counted over all texts and the frequent ones get
ids of their own; a phrase of k words is the pair of the two phrases of k - 1 words that it begins and ends
with. So the id table of a length points to both parents in the table of the length before, and the
frequencies of every beginning and ending of a phrase, which the score's cuts need, come down these
pointers, as does the answer to which phrase lies in which longer one.

Occurrences are never shuffled. A task packs its texts into blocks: numbers of the words of a block in
text order beside a dictionary of the block's distinct words with their counts. Only dictionary entries
travel, once, to be summed and named, and come back to the block as ids. From these the block names its
own pairs, pairs of pairs and so on by numbers; for each length it sends its distinct phrases, spelt in
ids of words, to be summed in buckets of bounded size. A word that is a third of all is one entry in each
block; no vocabulary is broadcast or collected. A bitmap of fixed size for each length keeps phrases from
being sent of which a part cannot be frequent. Sequences and the phrases of a bucket travel compressed.

Defined results: a null or empty text has no words; a null lang is ``und``; repeated rows count each; a
corpus without frequent phrases gives no rows; extra columns are not read. A piece, and so a text without
any punctuation, is never parted between blocks, and thus bounds a block from below.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mix, raw_texts, sorted_groups

BLOCK_WORDS = 800_000
SLICE = 1 << 20  # bytes of a text that are split at a time
PART = 1 << 16  # rows that a task hands over at a time
BUCKET = 1 << 20  # words, of which the distinct phrases meet in a bucket
MADE, POS = 16, 30  # bits of a block's number in its task, and of a word's in its block
BITMAP = 1 << 27  # bits
GAP = b"\xff"  # no byte of UTF-8

_MARKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(0xFF if b in _MARKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _slices(raw: bytes):
    """A text in parts of about SLICE bytes that end beside a space or a mark."""
    folded = raw.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE) if len(folded) - at > SLICE else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].replace(GAP, b" \xff ").split()
        at = end


class _Block:
    """Texts as numbers of words; a gap is -1."""

    def __init__(self):
        self.number = count().__next__
        self.known: dict[str, defaultdict] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, raw: bytes) -> None:
        known = self.known.get(lang)
        if known is None:
            known = self.known[lang] = defaultdict(self.number, {GAP: -1})
        for found in _slices(raw):
            self.parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
            self.size += len(found)
        self.parts.append(np.full(1, -1, np.int32))

    def rows(self, block: int):
        """Dictionary rows (block, pos, lang, word, n, null), for each language one without a word, and one with the sequence, whose word is its own."""
        seq = np.concatenate(self.parts)
        n = np.bincount(seq[seq >= 0], minlength=sum(len(k) - 1 for k in self.known.values()))
        for lang, known in self.known.items():
            del known[GAP]
            pos = np.fromiter(known.values(), np.int64, len(known))
            words = pa.array(known, pa.binary()).cast(pa.string())
            yield _rows(block, len(pos), pos=pos, lang=pa.repeat(pa.scalar(lang, pa.string()), len(pos)), word=words, n=n[pos])
            yield _rows(block, 1, lang=[lang], n=[int(n[pos].sum())])
        yield _rows(block, 1, word=[str(block)], seq=[_squeezed(seq)])


_PACKED = pa.schema([("block", pa.int64()), ("pos", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("seq", pa.binary())])


def _rows(block: int, size: int, **columns) -> pa.RecordBatch:
    columns["block"] = np.full(size, block, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _PACKED], schema=_PACKED)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers in few bytes: first their lowest bytes, then the next ones, compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)
    return len(numbers).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if len(numbers) else b"")


def _spread(raw: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], size * width, "zstd"), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack(size: int):
    def pack(batches):
        task, made, block = TaskContext.get().partitionId() << MADE, 0, _Block()
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), raw_texts(batch.column("text"))):
                if raw:
                    block.add(lang, raw)
                if block.size >= size:
                    yield from block.rows(task + made)
                    made, block = made + 1, _Block()
                    if made >> MADE:
                        raise ValueError("too many blocks in a task: repartition the texts or take larger blocks")
        if block.size:
            yield from block.rows(task + made)

    return pack


def _renumbered(batches):
    """From the named entries (pos, id) of a block and its sequence one row: the ids, ascending, and the sequence in numbers of these."""
    for table in sorted_groups(batches, ["block"]):
        seq = _spread(table.column("seq").drop_null()[0].as_py(), np.int32)
        named = table.filter(table.column("pos").is_valid())
        pos, ids = named.column("pos").to_numpy(), named.column("id").to_numpy()
        order = np.argsort(ids)
        place = np.full(int(seq.max(initial=-1)) + 2, -1, np.int32)  # the last is that of a gap
        place[pos[order]] = np.arange(len(order), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([table.column("block")[0].as_py()]), pa.array([_squeezed(np.diff(ids[order], prepend=0))], pa.binary()), pa.array([_squeezed(place[seq])], pa.binary())], names=["block", "ids", "seq"])


def _bit(words):
    """Of a phrase its bit in a bitmap; for numbers and for Columns alike."""
    bit = words[0] % 67_108_859
    for word in words[1:]:
        bit = (bit * 1_000_003 + word % 67_108_859) % BITMAP
    return bit


def _phrases(ids: np.ndarray, seq: np.ndarray, k: int, bitmaps: dict) -> tuple[np.ndarray, np.ndarray]:
    """The distinct phrases of k words of a block, a column of ids each, in their order, and how often they stand there;
    not those of which a bitmap says that a part cannot be frequent."""
    words = ids[None, :]
    for level in range(2, k + 1):
        size = max(words.shape[1], 1)
        both = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
        pairs = seq[both] * np.int64(size) + seq[both + 1]
        if level == k:
            pairs, n = np.unique(pairs, return_counts=True)
        else:
            pairs, which = np.unique(pairs, return_inverse=True)
        words = np.vstack([words[:, pairs // size], words[-1:, pairs % size]])
        if level < k:
            bit = _bit(words)
            known = (bitmaps[level].value[bit >> 6] >> (bit & 63)) & 1 == 1
            seq = np.full(len(seq), -1, np.int32)
            seq[both] = np.where(known, np.cumsum(known) - 1, -1)[which]
            words = words[:, known]
    return words, n


def _counts(k: int, bitmaps: dict, buckets: int):
    """The phrases of k words of each block and their counts, a row for each bucket."""

    def emit(batches):
        for batch in batches:
            for ids, seq in zip(batch.column("ids"), batch.column("seq")):
                words, n = _phrases(np.cumsum(_spread(ids.as_py(), np.int64)), _spread(seq.as_py(), np.int32), k, bitmaps)
                key = np.zeros(len(n), np.uint64)
                for word in words:
                    key = mix(key ^ word.view(np.uint64))
                bucket = (key % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                rows, bucket = np.vstack([words, n[None, :]])[:, order], bucket[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                sent = []
                for part in np.split(rows, starts[1:], axis=1) if len(starts) else ():
                    part[0, 1:] -= part[0, :-1].copy()
                    sent.append(_squeezed(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(sent, pa.binary())], names=["bucket", "rows"])

    return emit


def _summed(k: int, least: int):
    """The phrases of a bucket that occur ``least`` times over all blocks."""

    def emit(batches):
        for table in sorted_groups(batches, ["bucket"]):
            parts = [_spread(x.as_py(), np.int64).reshape(k + 1, -1) for x in table.column("rows")]
            for part in parts:
                np.cumsum(part[0], out=part[0])
            rows = np.concatenate(parts, axis=1)
            rows = rows[:, np.lexsort(rows[:k][::-1])]
            starts = np.flatnonzero(np.concatenate([[True], (rows[:k, 1:] != rows[:k, :-1]).any(axis=0)]))
            f = np.add.reduceat(rows[k], starts)
            starts, f = starts[f >= least], f[f >= least]
            for at in range(0, len(f), PART):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows[:k, starts[at : at + PART]], f[at : at + PART])], names=[*_spelt(k), "f"])

    return emit


def _spelt(k: int) -> list[str]:
    """The columns that hold the ids of a phrase's words."""
    return [f"w{j}" for j in range(1, k + 1)]


def _bitmap(names: DataFrame, k: int) -> np.ndarray:
    """The bits of phrases, in an array of BITMAP bits whatever their number."""
    masks = names.select(_bit([F.col(c) for c in _spelt(k)]).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("bits")).toArrow()
    out = np.zeros(BITMAP >> 6, np.int64)
    out[masks.column("at").to_numpy()] = masks.column("bits").to_numpy()
    return out


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly; for frequencies up to 10**16."""
    a, left, right = (c.cast("decimal(16,0)") for c in (a, left, right))
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", million * (a * a), (left * right).cast("decimal(38,0)")).cast("long")


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, k, id, left, right, phrase, f, starts, ends, n: every phrase of up to ``longest`` words that occurs
    ``least`` times in its language. ``left`` and ``right`` are the ids of its first and last k - 1 words; starts
    and ends hold the frequencies of its first and last 1 to k words, n the words of the language."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    packed = given.mapInArrow(_pack(block_words), "block long, pos long, lang string, word string, n long, seq binary")
    # a word's entries, at most one of each block, are a group; its id is the place of the first
    same = Window.partitionBy("lang", "word")
    place = F.shiftleft("block", POS) + F.col("pos")
    met = packed.withColumns({"f": F.sum("n").over(same), "id": F.min(place).over(same)}).where(F.col("pos").isNull() | (F.col("f") >= least))
    first = F.col("pos").isNull() | (F.col("id") == place)
    entries = scratch.save(met.select("block", "pos", "id", *[F.when(first, F.col(c)).alias(c) for c in ("lang", "word", "f")], "seq"), "entries")
    totals = scratch.save(entries.where("seq is null and pos is null").groupBy("lang").agg(F.first("f").alias("n")), "totals")
    words = entries.where("pos is not null and word is not null")
    names = scratch.save(words.select(F.col("id").alias("w1"), "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("starts"), F.array("f").alias("ends")), "names-1")
    levels = [names.select("lang", F.lit(1).alias("k"), "id", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), "phrase", "f", "starts", "ends")]
    back = entries.where("pos is not null or seq is not null").select("block", "pos", "id", "seq")
    numbered = scratch.save(back.repartition("block").sortWithinPartitions("block").mapInArrow(_renumbered, "block long, ids binary, seq binary"), "numbered")
    scratch.drop("entries")
    buckets = max(spark.sparkContext.defaultParallelism, (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET)
    bitmaps = {}
    for k in range(2, longest + 1):
        sent = numbered.mapInArrow(_counts(k, bitmaps, buckets), "bucket int, rows binary").repartition("bucket").sortWithinPartitions("bucket")
        counted = sent.mapInArrow(_summed(k, least), ", ".join(f"{c} long" for c in (*_spelt(k), "f")))
        one = names.select(*_spelt(k - 1), F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), "starts")
        two = names.select(*[F.col(c).alias(f"w{j}") for j, c in enumerate(_spelt(k - 1), 2)], F.col("id").alias("right"), "last", "ends")
        phrases = counted.join(one, _spelt(k - 1)).join(two, _spelt(k)[1:]).select(
            *_spelt(k), "left", "right", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f",
            F.concat("starts", F.array("f")).alias("starts"), F.concat("ends", F.array("f")).alias("ends"),
        )
        names = scratch.save(phrases.withColumn("id", F.monotonically_increasing_id()), f"names-{k}")
        levels.append(names.select("lang", F.lit(k).alias("k"), "id", "left", "right", "phrase", "f", "starts", "ends"))
        if k < longest:
            bitmaps[k] = spark.sparkContext.broadcast(_bitmap(names, k))
    scratch.drop("numbered")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.join(totals, "lang")


def collocations(phrases: DataFrame, *, longest: int = 3, inside: int = 50, best: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two words and more, from the rows of
    frequent_phrases: scored by the weakest cut, without those that a longer one holds ``inside`` % of the time."""
    cut = [
        F.struct(score(F.col("f"), F.col("starts")[k - 1], F.element_at("ends", F.col("k") - k)).alias("score"), F.lit(k).alias("cut"), F.col("starts")[k - 1].alias("l"), F.element_at("ends", F.col("k") - k).alias("r"))
        for k in range(1, longest)
    ]
    cuts = F.slice(F.array(*(F.when(F.col("k") > k, c) for k, c in enumerate(cut, 1))), 1, F.col("k") - 1)
    scored = phrases.where("k > 1").withColumn("weakest", F.array_min(cuts))
    parents = phrases.where("k > 2").select((F.col("k") - 1).alias("k"), F.explode(F.array("left", "right")).alias("id"), "f")
    longer = parents.groupBy("k", "id").agg(F.max("f").alias("longer"))
    shorter = scored.where(F.col("k") < longest).join(longer, ["k", "id"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("f")))
    kept = shorter.drop("longer").unionByName(scored.where(F.col("k") == longest))  # the longest lie in nothing
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", F.col("f").alias("a"), F.col("weakest.l").alias("l"), F.col("weakest.r").alias("r"), "n", F.col("weakest.score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The query with every phrase of one to three words counted.
SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT row_number() OVER () AS p, lang, w FROM (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d)),
o AS (SELECT p, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM p),
x AS (SELECT lang, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM o WINDOW s AS (PARTITION BY p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM x GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM x WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM x WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
two AS (SELECT f2.lang, w1 || ' ' || w2 AS phrase, f2.f AS a, l.f AS l, r.f AS r, greatest((SELECT max(f3.f) FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2), (SELECT max(f3.f) FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2)) AS longer
        FROM f2 JOIN f1 AS l USING (lang, w1) JOIN f1 AS r ON r.lang = f2.lang AND r.w1 = f2.w2),
cuts AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, k, CASE k WHEN 1 THEN one.f ELSE begins.f END AS l, CASE k WHEN 1 THEN ends.f ELSE last.f END AS r
         FROM f3 JOIN f1 AS one USING (lang, w1) JOIN f2 AS begins USING (lang, w1, w2) JOIN f2 AS ends ON ends.lang = f3.lang AND ends.w1 = f3.w2 AND ends.w2 = f3.w3 JOIN f1 AS last ON last.lang = f3.lang AND last.w1 = f3.w3, (VALUES (1), (2)) AS k(k)),
s AS (SELECT lang, phrase, a, l, r, 1 AS k, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM two WHERE longer IS NULL OR 100 * longer < 50 * a
      UNION ALL SELECT lang, phrase, a, l, r, k, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) FROM cuts),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) JOIN n USING (lang) WHERE rank <= 2000
"""
