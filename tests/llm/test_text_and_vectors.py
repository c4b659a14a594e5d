"""Phrases, hard negatives and byte-pair encoding against plain restatements."""

import hashlib
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from sievewright.llm import bpe, negatives, phrases

from . import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def listed(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_the_oracles_agree(spark):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        path = f"{SF}/{table}.parquet"
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    for name in ("op11_phrases", "op12_negatives"):
        wanted = db.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in wanted.description]
        order = sorted(range(len(columns)), key=lambda k: columns[k])
        assert listed(entry.queries()[name](spark, SF)) == sorted((tuple(r[k] for k in order) for r in wanted.fetchall()), key=repr), name


def plain_phrases(rows, longest, least, inside, best):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, brute.lower(text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            f.update((lang, *w[k : k + m]) for m in range(1, longest + 1) for k in range(len(w) - m + 1))
    taken = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = []
    for lang in n:
        kept = []
        for g, a in taken.items():
            w = g[1:]
            holders = (b for h, b in taken.items() if h[0] == lang and len(h) > len(g) and any(h[k : k + len(w)] == w for k in range(1, len(h))))
            if g[0] == lang and not any(100 * b >= inside * a for b in holders):
                s, k = min((1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
                kept.append((-s, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
        out += [(-a, l, lang, n[lang], p.decode(), r, rank, -s) for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:best], 1)]
    return sorted(out, key=repr)


def test_phrases(spark):
    said = ["one two three four. one two three four", "one\ttwo THREE; three three three three", None, "", " .,. ", "one two\x00 \x1fthree", "x y" * 3, "né à né à né à"]
    rows = [(k % 3 if k % 3 else None, t, 1) for k in range(6) for t in said] + [(1, "one two three four five", 2)] * 5 + [(7, "solo", 1)]
    table = spark.createDataFrame([(None if g is None else f"l{g}", t, x, "z") for g, t, x in rows], "lang string, text string, n int, word string")
    plain = [(None if g is None else f"l{g}", t) for g, t, _ in rows]
    for longest, least, size in ((3, 3, 1), (4, 2, 500_000), (2, 1, 10), (3, 10**6, 10)):
        found = phrases.collocations(phrases.frequent_phrases(table, longest=longest, least=least, block_words=size), longest=longest, best=5)
        assert listed(found) == plain_phrases(plain, longest, least, 50, 5)
    assert phrases.collocations(phrases.frequent_phrases(table.limit(0))).count() == 0


def test_phrase_scores_are_exact(spark):
    cases = [(10**12, 10**12 + 1, 10**12 + 3), (3 * 10**15, 9 * 10**15, 7 * 10**15), (10, 10, 10), (11, 10**9, 17)]
    found = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert all(s == 1_000_000 * a * a // (l * r) for a, l, r, s in found)


def test_phrases_travel_in_few_bytes():
    """A row for each distinct pair took some 40 bytes of an executor's memory and 12 of its disk."""
    rng = np.random.default_rng(7)
    ids = np.unique((rng.integers(0, 4, 5000) << phrases.MADE + phrases.POS) + rng.integers(0, 200_000, 5000))  # places of words in blocks
    blocks, want, distinct = [], Counter(), 0
    for _ in range(3):
        seq = (rng.zipf(1.3, 40_000) % (len(ids) + 1) - 1).astype(np.int32)
        pairs = Counter((int(ids[a]), int(ids[b])) for a, b in zip(seq[:-1], seq[1:]) if a >= 0 and b >= 0)
        want, distinct = want + pairs, distinct + len(pairs)
        blocks.append((phrases._squeezed(np.diff(ids, prepend=0)), phrases._squeezed(seq)))
    blocks.append((phrases._squeezed(np.zeros(0, np.int64)), phrases._squeezed(np.zeros(0, np.int32))))
    given = pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*blocks)], names=["ids", "seq"])
    sent = pa.Table.from_batches(phrases._counts(2, {}, 4)(iter([given]))).sort_by("bucket")
    assert sent.num_rows == 12 and sum(map(len, sent.column("rows").to_pylist())) < 8 * distinct
    found = pa.Table.from_batches(phrases._summed(2, 3)(sent.to_batches()))
    assert {(a, b): n for a, b, n in zip(*found.to_pydict().values())} == {pair: n for pair, n in want.items() if n >= 3}


def test_long_pieces_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 50)
    text = "alpha beta gamma " * 400 + "b" * 5000 + " alpha" * 100
    found = phrases.collocations(phrases.frequent_phrases(spark.createDataFrame([("en", text)], "lang string, text string"), block_words=7))
    assert listed(found) == plain_phrases([("en", text)], 3, 10, 50, 2000)


def plain_negatives(rows, is_anchor, positives, negatives_, low, high):
    def whole(v):
        return [math.floor(256 * float(np.float32(x))) for x in v]

    good = [(i, g, whole(v)) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, g, v) in enumerate(good):
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, h) for k, (j, h, w) in enumerate(good) if k != at]
        for p, j, _ in sorted(x for x in scored if x[2] == g)[:positives]:
            hard = sorted(x for x in scored if x[2] != g and low * -p <= 100 * -x[0] <= high * -p)[:negatives_]
            out += [(i, n, -s, j, -p, rank) for rank, (s, n, _) in enumerate(hard, 1)]
    return sorted(out, key=repr)


def test_negatives(spark):
    draw = np.random.default_rng(3)
    rows = [(int(k), (draw.integers(-4, 9, 5) / 4).tolist(), int(k % 4)) for k in range(300)]
    rows += [(300, [1.0, None], 1), (301, None, 1), (302, [float("nan")], 1), (303, [float("inf")] * 5, 1), (None, [1.0] * 5, 1), (304, [1.0] * 5, None), (305, [], 2), (306, [2.0] * 7, 2), (307, [0.0] * 5, 3), (400, [1.0] * 5, 9), (20, rows[20][1], 0), (21, rows[21][1], 1), (-20, [-1.0, 2.0, 0.5, 0.25, 1.0], 0)]
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, row int, block string")
    wanted = plain_negatives(rows, lambda i: i % 20 == 0, 5, 10, 30, 90)
    for sizes, most in (((256, 2048, 32), 1 << 38), ((4, 50, 2), 1 << 38), ((3, 64, 1), 8 * 3 * 313 * 2)):
        found = negatives.hard_negatives(table, F.col("vec_id") % 20 == 0, sizes=sizes, max_scratch=most)
        # equal scores of equal ids stand in any order, with the same columns
        assert listed(found) == wanted
    assert negatives.hard_negatives(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert negatives.hard_negatives(table, F.col("vec_id") > 10**6).count() == 0


def test_no_score_of_a_pair_is_kept(spark, monkeypatch):
    sizes = []

    def save(self, df, name, before=negatives.Scratch.save):
        saved = before(self, df, name)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        sizes.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength())
        return saved

    monkeypatch.setattr(negatives.Scratch, "save", save)
    draw = np.random.default_rng(4)
    rows = [(k, draw.standard_normal(16).tolist(), k % 9) for k in range(6000)]
    found = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 8 == 0)
    assert found.select("anchor_id", "positive_id").distinct().count() == 750 * 5
    assert sum(sizes) < 750 * 6000


def test_negatives_of_copies_many_labels_and_large_components(spark, monkeypatch):
    draw = np.random.default_rng(6)
    few = [(draw.integers(-3, 7, 6) / 4).tolist() for _ in range(9)]
    copies = [(k, few[int(draw.integers(9))], int(draw.integers(3))) for k in range(700)]
    labels = [(k, (draw.integers(-4, 9, 5) / 4).tolist(), int(draw.integers(200))) for k in range(600)]
    large = [(k, (draw.integers(-9, 20, 4) * 2.0 ** int(draw.choice([0, 9, 17]))).tolist(), int(k % 3)) for k in range(300)]
    hidden = [(k, [1.0 + k % 5, float(k % 7)], 1 if k % 50 else 2) for k in range(500)]
    monkeypatch.setattr(negatives, "STRIPE", 200)
    monkeypatch.setattr(negatives, "PANEL", 20_000)
    monkeypatch.setattr(negatives, "BUCKETS", 7)
    monkeypatch.setattr(negatives, "NARROW", 3)
    for rows in (copies, labels, large, hidden):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
        found = negatives.hard_negatives(table, F.col("vec_id") % 20 == 0, sizes=(16, 64, 2))
        assert listed(found) == plain_negatives(rows, lambda i: i % 20 == 0, 5, 10, 30, 90)


def test_lists_are_ordered_alike_however_large_their_scores():
    draw = np.random.default_rng(1)
    for most in (4, 1 << 40, 1 << 62):
        where, score, ids, row = draw.integers(0, 50, 5000), draw.integers(-most, most, 5000), draw.integers(0, 30, 5000), draw.permutation(5000)
        assert negatives._order(where, score, ids, row).tolist() == np.lexsort((row, ids, -score, where)).tolist()


def test_components_are_rounded_down_into_64_bits():
    assert negatives._rounded(np.array([-0.5, 1.5, 1e300, -np.inf, 2.0**63, -(2.0**63)])).tolist() == [-1, 1, negatives.MOST, negatives.LEAST, negatives.MOST, negatives.LEAST]


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[1 << 40, 3]]), np.array([[(1 << 20) + 1, 7]])
    assert negatives.product(a, b).tolist() == [[(1 << 40) * ((1 << 20) + 1) + 21]]


ODD = [
    "", None, " ", "   \n\n  ", "it's we'll I'd they've 'll 've' '", "a" * 3000, "日本語の文章" * 300, "word  two   spaces \t\n x", "<|endoftext|>", "ends <|endoftext|> in <|endoftext|><|endoftext|> <|endof",
    "é" * 700 + " " + "ß ü" * 300, " 　 wide space " * 90, "12345 678 9" * 200, "!!! ... ??? " * 200, "emoji 👩‍👩‍👧‍👦 🏳️‍🌈 " * 80, "a\x00b\x7f ‍" * 150, " " * 2500, "x\n" * 900,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def test_encoding_is_the_tokenizers(spark, tokenizer):
    draw = np.random.default_rng(8)
    passages = [" ".join("".join(draw.choice(list("etaoinshrdlu"), draw.integers(1, 9))) for _ in range(300)) for _ in range(6)]
    mixed = ["".join(draw.choice([*passages, *(o or "" for o in ODD)], 5)) for _ in range(30)]
    texts = [*ODD, *mixed, *mixed[:3], passages[0][3:] + passages[1], "longest " * 100_000]
    table = spark.createDataFrame([(k, t, 1, "k") for k, t in enumerate(texts)], "doc_id long, text string, ids int, key string")
    found = {r.doc_id: r.ids for r in bpe.encode_texts(table, VOCABULARY).collect()}
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        assert found[k] == tokenizer.encode(t or "", add_special_tokens=False).ids, (k, (t or "")[:50])
    read = {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_texts(table, VOCABULARY), VOCABULARY).collect()}
    assert read == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.encode_texts(table.limit(0), VOCABULARY).count() == 0


def test_chunks_are_those_of_the_content():
    draw = np.random.default_rng(2)
    passage = bytes(draw.integers(97, 123, 20_000, dtype=np.uint8))
    one, two = bpe.cuts(b"some head " + passage), bpe.cuts(passage)
    assert len(two) > 20 and {x - 10 for x in one} >= {x for x in two if x > 32}
    text = "äöü" * 5000
    assert all(text.encode()[e - 2 : e].decode() for e in bpe.cuts(text.encode()))


def test_decoding_is_the_tokenizers(tokenizer):
    draw = np.random.default_rng(4)
    words = bpe.Vocabulary(VOCABULARY)
    for _ in range(200):
        ids = draw.integers(0, 50257, 30).tolist()
        assert words.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_op13_over_the_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    wanted = []
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        said = tokenizer.decode(ids, skip_special_tokens=False)
        wanted.append((hashlib.sha256(said.encode()).hexdigest(), i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), len(ids)))
    assert listed(entry.queries()["op13_bpe"](spark, SF)) == sorted(wanted, key=repr)
