"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, anything but letters becomes one space, and the n-grams of one to four
characters, whatever the script, are hashed into 2**16 buckets. A text's counts are sparse: bucket and
number. Term frequencies are shares of a text's n-grams; document frequencies come from every training
text, in one pass whose tasks emit one sparse count vector each. A hash-chosen sample, bounded for
each language so that every language can be predicted at any size of the corpus, fits the weights by
follow-the-regularised-leader with elastic-net penalties: fixed shards of the sample learn in parallel
and their weights are averaged after every round. Counts of all rows give the languages' prior odds. A
temperature fitted on a further bounded sample calibrates the probabilities. Scoring is one pass over
the texts with the weights broadcast.

Defined results: a text that is null or has no letter is ``und`` with score 0; rows without a
language are scored but teach nothing; with no row to learn from every text is ``und``; repeated
rows are scored alike; result columns replace input columns of their name, others are carried.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, mix

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"
STEP = 1 << 20  # n-grams of a text that are hashed together
DENSE = 1 << 12  # from so many n-grams on they are counted in an array of all buckets


@dataclass(frozen=True)
class Settings:
    """Bounds and penalties. The samples are bounded by rows of each language; everything else sees all rows."""

    sample_rows: int = 900
    calibration_rows: int = 300
    rows_per_shard: int = 900
    rounds: int = 2
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3


@cache
def _lower() -> np.ndarray:
    """The lower-case letter of each code point of the first plane, 0 if it is no letter."""
    return np.fromiter((ord(c.lower()[0]) if c.isalpha() else 0 for c in map(chr, range(1 << 16))), np.uint32, 1 << 16)


def letters(text: str | None) -> np.ndarray:
    """The letters with a 0 around and between words; empty if there is no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _lower()[np.minimum(points, 0xFFFF)]
    for k in np.flatnonzero(points > 0xFFFF):
        c = chr(points[k])
        code[k] = ord(c.lower()[0]) if c.isalpha() else 0
    if not code.any():
        return code[:0]
    code = np.concatenate(([np.uint32(0)], code, [np.uint32(0)]))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    return code[keep]


def gram_buckets(code: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The bucket of every n-gram of the letters that starts from begin up to end."""
    rolled, out = code[begin:end], []
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            following = code[begin + n - 1 : end + n - 1]
            rolled = rolled[: len(following)] * np.uint32(0x01000193) + following
        if n in GRAMS and len(rolled):
            hashed = (rolled + np.uint32(n)) * np.uint32(2654435769)
            out.append((hashed ^ (hashed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(16))
    return np.concatenate(out)


def gram_counts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur, and how often."""
    if len(code) * len(GRAMS) < DENSE:
        return np.unique(gram_buckets(code, 0, len(code)), return_counts=True)
    total = sum(np.bincount(gram_buckets(code, k, min(k + STEP, len(code))), minlength=BUCKETS) for k in range(0, len(code), STEP))
    at = np.flatnonzero(total)
    return at, total[at]


def tf_idf(code: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values, of unit length."""
    at, counts = gram_counts(code)
    values = counts * idf[at]
    return at, values / max(np.sqrt((values**2).sum()), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """By bucket, in how many of texts(text) it occurs; and the number of texts."""

    def count(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if len(code := letters(text)):
                    total[gram_counts(code)[0]] += 1
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BUCKETS), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    frequencies = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        frequencies[r["bucket"]] = r["n"]
    return frequencies[:BUCKETS], int(frequencies[BUCKETS])


def bounded_sample(labelled: DataFrame, rows: int, salt: int) -> DataFrame:
    """At most ``rows`` of labelled(id, ...), those whose hashes come first. Rows that share an id count once."""
    total = labelled.count()
    share = min(1.0, 2.0 * rows / max(total, 1))
    rank = F.xxhash64(F.lit(salt), "id")
    chosen = labelled.where(F.pmod(rank, F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    ids = chosen.select("id", rank.alias("rank")).distinct().orderBy("rank", "id").limit(rows)
    others = [c for c in labelled.columns if c != "id"]
    found = chosen.join(F.broadcast(ids.select("id")), "id", "left_semi").groupBy("id").agg(F.min(F.struct(*others)).alias("row"))
    return found.select("id", "row.*")


def sample_by_language(labelled: DataFrame, counts: dict[str, int], rows: int, salt: int) -> DataFrame:
    """Of labelled(id, text, lang) at most ``rows`` of each language, those whose hashes come first; only
    ids are ranked, and of each language no more than twice the rows in the mean. Texts without a letter teach nothing."""
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(c, int(min(1.0, 2.0 * rows / n + 1e-6) * 1_000_000)) for c, n in counts.items()], "lang string, share int")
    rank = F.xxhash64(F.lit(salt), "id")
    chosen = labelled.where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(shares), "lang").where(F.pmod(rank, F.lit(1_000_000)) < F.col("share"))
    placed = chosen.select("id", "lang").distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(rank, "id")))
    ids = placed.where(F.col("place") <= rows).select("id", "lang")
    return chosen.join(F.broadcast(ids), ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))


def _shuffled(n: int, seed: int) -> np.ndarray:
    return np.argsort(mix(np.arange(n, dtype=np.uint64) + np.uint64(seed * 1_000_003)), kind="stable")


def learn_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], weights: np.ndarray, s: Settings, seed: int) -> np.ndarray:
    """FTRL-proximal over rows of (buckets, values, class), from the given weights (buckets x classes)."""
    g2 = np.full(weights.shape, 1e-8)
    z = -weights * (s.beta / s.alpha + s.l2) - np.sign(weights) * s.l1

    def at(k):
        shrunk = np.sign(z[k]) * np.maximum(np.abs(z[k]) - s.l1, 0.0)
        return -shrunk / ((s.beta + np.sqrt(g2[k])) / s.alpha + s.l2)

    for epoch in range(s.epochs):
        for i in _shuffled(len(rows), seed + epoch):
            where, x, label = rows[i]
            w = at(where)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1.0
            gradient = x[:, None] * p[None, :]
            grown = g2[where] + gradient**2
            z[where] += gradient - (np.sqrt(grown) - np.sqrt(g2[where])) / s.alpha * w
            g2[where] = grown
    return at(slice(None))


def fit_temperature(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray, prior: np.ndarray | float = 0.0) -> float:
    """The divisor of the logits, to which prior odds are added, with the least negative log-likelihood."""

    def loss(t):
        scaled = logits / t + prior
        top = scaled.max(axis=1, keepdims=True)
        return float(np.average(np.log(np.exp(scaled - top).sum(axis=1)) + top[:, 0] - scaled[np.arange(len(labels)), labels], weights=weight))

    low, high = np.log(0.02), np.log(20.0)
    for _ in range(60):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x classes
    prior: np.ndarray  # what the classes' share of all rows adds
    temperature: float

    def logits(self, code: np.ndarray) -> np.ndarray:
        where, x = tf_idf(code, self.idf)
        return x @ self.weights[where]

    def predict(self, text: str | None) -> tuple[str, float]:
        code = letters(text)
        if not len(code) or not self.classes:
            return UNKNOWN, 0.0
        scaled = self.logits(code) / self.temperature + self.prior
        p = np.exp(scaled - scaled.max())
        k = int(p.argmax())
        return self.classes[k], float(p[k] / p.sum())


def _learner(start, numbers: dict[str, int], s: Settings, turn: int):
    """What one shard of the sample makes of the weights, as sparse rows."""

    def learn(key, frame):
        frame = frame.sort_values("id", kind="stable")
        rows = [(np.asarray(a, np.int64), np.asarray(x), numbers[c]) for c, a, x in zip(frame["lang"], frame["at"], frame["x"])]
        learned = learn_ftrl(rows, start.value, s, 97 * turn + int(key[0]))
        at, k = np.nonzero(learned)
        return pd.DataFrame({"bucket": at.astype(np.int32), "class": k.astype(np.int32), "w": learned[at, k]})

    return learn


def _logits(texts: DataFrame, model: Model) -> DataFrame:
    """(lang, logits) of texts(text, lang)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            found = [shared.value.logits(letters(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(found, pa.list_(pa.float64()))], names=["lang", "logits"])

    return texts.mapInArrow(score, "lang string, logits array<double>")


def train(labelled: DataFrame, settings: Settings | None = None) -> Model:
    """A model from labelled(id, text, lang); rows with a null text or lang teach nothing."""
    s = settings or Settings()
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("id", "text", "lang")
    with_letters = labelled.where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in with_letters.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    classes = sorted(counts)
    if not classes:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    frequency, n = document_frequencies(labelled.select("text"))
    idf = (np.log((1.0 + n) / (1.0 + frequency)) + 1.0).astype(np.float64)
    spark = labelled.sparkSession
    scratch = Scratch(spark, "langid")
    shared = spark.sparkContext.broadcast(idf)

    def features(batches):
        for batch in batches:
            out = [tf_idf(code, shared.value) if len(code := letters(t)) else (np.zeros(0, np.int64), np.zeros(0)) for t in batch.column("text").to_pylist()]
            vectors = [pa.array([a.astype(np.int32) for a, _ in out], pa.list_(pa.int32())), pa.array([b for _, b in out], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("lang"), *vectors], names=["id", "lang", "at", "x"])

    aside = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(4)) == 0  # rows for the temperature, of languages with enough of them
    few = [c for c in classes if counts[c] < 8]
    sample = sample_by_language(labelled.where(~aside | F.col("lang").isin(few) | F.col("id").isNull()), counts, s.sample_rows, 1)
    sample = scratch.save(sample.mapInArrow(features, "id string, lang string, at array<int>, x array<double>").where("size(x) > 0"), "sample")
    taken = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    classes = sorted(taken)
    numbers = {c: k for k, c in enumerate(classes)}
    shards = max(4, -(-sum(taken.values()) // s.rows_per_shard))
    dealt = sample.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(shards)).cast("int"))
    weights = np.zeros((BUCKETS, len(classes)))
    for turn in range(s.rounds):
        parts = dealt.groupBy("shard").applyInPandas(_learner(spark.sparkContext.broadcast(weights), numbers, s, turn), "bucket int, class int, w double")
        mean = parts.groupBy("bucket", "class").agg((F.sum("w") / shards).alias("w")).toPandas()  # buckets x classes at most
        weights = np.zeros((BUCKETS, len(classes)))
        weights[mean["bucket"].to_numpy(), mean["class"].to_numpy()] = mean["w"].to_numpy()
    prior = np.log([counts[c] / taken[c] for c in classes])
    model = Model(classes, idf, weights, prior - prior.max(), 1.0)
    held = sample_by_language(labelled.where(aside & F.col("lang").isin(classes)), counts, s.calibration_rows, 2)
    rows = _logits(held.select("lang", "text"), model).toPandas()  # a few numbers for each row of the sample
    scratch.clean()
    if not len(rows):
        return model
    drawn = rows["lang"].value_counts()
    weight = rows["lang"].map(lambda c: counts[c] / drawn[c]).to_numpy(float)
    return Model(classes, idf, weights, model.prior, fit_temperature(np.stack(rows["logits"]), rows["lang"].map(numbers).to_numpy(), weight, model.prior))


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    carried = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    (said,) = fresh(docs, "lang_text")

    def score(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(said).to_pylist()]
            columns = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return docs.select(*carried, F.col(text).alias(said)).mapInArrow(score, schema)


def fold(doc_id: str, modulus: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; rows of fold 1 of 3 teach nothing."""
    fold_of = fold("doc_id", 3)
    known = docs.where(fold_of != 1).select(F.col("doc_id").alias("id"), "text", "lang")
    held_out = F.coalesce(fold_of == 1, F.lit(False))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), train(known)).select("doc_id", "held_out", "lang_pred", "score")
