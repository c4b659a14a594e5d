"""The kernel, the filters before it, the learning steps and the long runs against plain restatements."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import embeddings, langid, lines, toxicity

from . import brute

UNITS = ["^moron", "^mxoron", "^idiot", "^pathetic", "^river", "^\u043a\u043d\u0438\u0433\u0430", "^ab"]


def kernel(s: str, t: str) -> float:
    """All common subsequences of three characters, one by one."""
    out = 0.0
    for i in itertools.combinations(range(len(s)), toxicity.LENGTH):
        for j in itertools.combinations(range(len(t)), toxicity.LENGTH):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                out += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return out


def test_subsequence_kernel_by_enumeration():
    pairs = list(itertools.product(UNITS, UNITS))
    s, t = (toxicity.coded([p[k] for p in pairs]) for k in (0, 1))
    assert np.allclose(toxicity.subsequence_kernel(s, t), [kernel(*p) for p in pairs], rtol=1e-5)
    landmarks = toxicity.Landmarks(["^moron", "^idiot"], toxicity.Settings())
    rows = landmarks.rows_of([u[1:] for u in UNITS])
    for row, u in zip(rows, UNITS):
        for value, mark in zip(row, landmarks.units):
            wanted = kernel(u, mark) / math.sqrt(kernel(u, u) * kernel(mark, mark)) if kernel(u, u) else 0.0
            assert value == pytest.approx(wanted if wanted >= 0.35 else 0.0, abs=1e-5)


def test_letters_that_the_filter_asks_for_lose_little(spark):
    """The letter rule drops kernel values between a corpus's units and landmarks, but none near 1."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect() if r[0]]
    units = toxicity.units_of(texts)
    strings = sorted(set(units.strings(np.arange(len(units.starts)))))[:6000]
    marks = [f"^{w}" for w in ("moron", "idiot", "stupid", "pathetic", "loser", "trash", "worthless", "scum", "disgusting")]
    landmarks = toxicity.Landmarks(marks, toxicity.Settings())
    codes = toxicity.coded([f"^{u}"[: toxicity.WINDOW] for u in strings])
    at, mark = (x.ravel() for x in np.meshgrid(np.arange(len(codes)), np.arange(len(marks)), indexing="ij"))
    values = landmarks.values(codes, at, mark)
    near = set(zip(*landmarks.near(toxicity.letter_masks(codes))))
    kept = np.array([p in near for p in zip(at.tolist(), mark.tolist())])
    counts = values >= 0.35
    print("kernel values that count", counts.sum(), "dropped by the letter rule", (counts & ~kept).sum(), "largest of these", values[~kept].max())
    assert counts.any() and values[~kept].max() < 0.6


def test_units_of_texts():
    units = toxicity.units_of(["You IDIOT! i.d-i0t, m o r o n here", "", "caf\u00e9 \u041a\u043d\u0438\u0433\u0430 a b"])
    found = [(t, s) for t, s in zip(units.text.tolist(), units.strings(np.arange(len(units.starts))))]
    assert found == [(0, "you"), (0, "idiot"), (0, "idiot"), (0, "here"), (2, "cafe"), (2, "\u043a\u043d\u0438\u0433\u0430"), (0, "moron")]
    assert units.tokens.tolist() == [9, 0, 4]


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"word{k} is mild. you moron!" if k % 5 == 0 else f"river{k} mild" for k in range(200))
    model = toxicity.Model(toxicity.Landmarks(["^moron"], toxicity.Settings()), np.array([1.0]), -0.4, np.array([1.0, 0.5, 0.2, -1.0]))
    whole = model.probabilities([text, None], toxicity.SuspiciousUnits(model.landmarks))
    monkeypatch.setattr(toxicity, "PIECE", 300)
    assert len(list(toxicity.pieces([text]))) > 5
    assert np.allclose(model.probabilities([text, None], toxicity.SuspiciousUnits(model.landmarks)), whole)


def test_ftrl_by_single_steps():
    s = langid.Settings(epochs=1)
    rows = [(np.array([0, 2]), np.array([0.6, 0.8]), 0), (np.array([1, 2]), np.array([1.0, 0.5]), 1), (np.array([0]), np.array([1.0]), 0)]
    learnt = langid.learn_ftrl(rows, np.zeros((3, 2)), s, 5)
    z, g2 = np.zeros((3, 2)), np.full((3, 2), 1e-8)

    def weight(b, c):
        if abs(z[b, c]) <= s.l1:
            return 0.0
        return -(z[b, c] - math.copysign(s.l1, z[b, c])) / ((s.beta + math.sqrt(g2[b, c])) / s.alpha + s.l2)

    for i in langid._shuffled(3, 5):
        where, x, label = rows[i]
        w = {(b, c): weight(b, c) for b in where for c in (0, 1)}
        logits = [sum(w[b, c] * v for b, v in zip(where, x)) for c in (0, 1)]
        p = [math.exp(v) / sum(map(math.exp, logits)) for v in logits]
        for b, v in zip(where, x):
            for c in (0, 1):
                g = (p[c] - (c == label)) * v
                sigma = (math.sqrt(g2[b, c] + g * g) - math.sqrt(g2[b, c])) / s.alpha
                z[b, c] += g - sigma * w[b, c]
                g2[b, c] += g * g
    assert np.allclose(learnt, [[weight(b, c) for c in (0, 1)] for b in range(3)], atol=1e-12)


def test_temperature_is_that_of_the_least_loss():
    random = np.random.default_rng(3)
    labels = random.integers(0, 3, 400)
    logits = random.standard_normal((400, 3)) + 1.2 * np.eye(3)[labels]

    def loss(t):
        scaled = 4 * logits / t
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(400), labels]).mean())

    found = langid.fit_temperature(4 * logits, labels, np.ones(400))
    assert loss(found) <= min(loss(t) for t in np.linspace(0.5, 12, 400)) + 1e-6


def test_grams_are_those_of_characters():
    code = langid.letters("\u00c9t\u00e9, 12 \u043a\u043d\u0438\u0433\u0430!")
    assert "".join(chr(c) if c else "_" for c in code) == "_\u00e9t\u00e9_\u043a\u043d\u0438\u0433\u0430_"
    assert len(langid.gram_buckets(code, 0, len(code))) == sum(len(code) - n + 1 for n in langid.GRAMS)
    long = langid.letters("the quick brown fox " * 700)
    whole, parts = langid.gram_counts(long), np.zeros(langid.BUCKETS, int)
    for k in range(0, len(long), 97):
        np.add.at(parts, langid.gram_buckets(long, k, min(k + 97, len(long))), 1)
    assert dict(zip(*map(np.ndarray.tolist, whole))) == {b: parts[b] for b in np.flatnonzero(parts)}


def test_rare_languages_stay_predictable(spark):
    rows = [(k, f"the house near the river was old and the mill stood still {k}", "en") for k in range(300)] + [(1000 + k, f"nyumba ilikuwa karibu na mto na kinu kilikuwa cha zamani {k}", "sw") for k in range(6)]
    model = langid.train(spark.createDataFrame(rows, "id long, text string, lang string"), langid.Settings(sample_rows=40, calibration_rows=20))
    assert model.classes == ["en", "sw"] and model.predict("nyumba karibu na mto")[0] == "sw" and model.predict("the old house")[0] == "en"


def test_long_repeated_runs_of_lines(spark):
    shared = [f"shared line {k * k % 101}" for k in range(150)]
    rows = [(1, "\n".join(["a"] + shared + ["b"])), (2, "\n".join(["c"] + shared[:90] + ["d"])), (3, "\n".join(shared[40:] + ["e", "e", "e", "e"]))]
    found = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute.later_runs(dict(rows), lines.MIN_LINES, lines.MIN_WORDS)
    assert found[2] == "c\nd"


def test_vectors_of_other_lengths_and_wide_codes(spark, monkeypatch):
    random = np.random.default_rng(1)
    rows = [(k, random.standard_normal(8).tolist(), 1) for k in range(300)]
    rows += [(1000 + k, (np.array(rows[k][1]) * 2 + 0.01).tolist(), 1) for k in range(100)]
    rows += [(2000 + k, random.standard_normal(5).tolist(), 1) for k in range(60)] + [(3000 + k, (np.arange(1.0, 6.0) + 0.001 * k).tolist(), 1) for k in range(9)]
    monkeypatch.setattr(embeddings, "NARROWEST", 2)
    monkeypatch.setattr(embeddings, "BUCKET", 2)
    monkeypatch.setattr(embeddings, "BLOCK", 5)
    found = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    wanted = dict.fromkeys(found, 0)
    for (i, v, _), (j, w, _) in itertools.combinations(rows, 2):
        if len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
            wanted[i] += 1
            wanted[j] += 1
    assert found == wanted and sum(wanted.values()) > 200


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the old house", 5, 6, 7), (2, None, 5, 6, 7)], "doc_id long, text string, _text int, tox_text int, lang_text int")
    model = toxicity.Model(None, np.zeros(0), 0.0, np.array([0.0, 0.0, 0.0, -1.0]))
    assert toxicity.predict(docs, model).columns == [*docs.columns, "score", "predicted"]
    assert {r._text for r in langid.predict(docs, langid.Model([], np.zeros(1), np.zeros((1, 0)), np.zeros(0), 1.0)).collect()} == {5}
    assert toxicity.drop_toxic(docs, model).where(F.col("_text") == 5).count() == 2
