"""The numbered queries over whole tables against SQL, brute force or held-out rows."""

import hashlib
import math
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

from . import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for table in TABLES:
        path = f"{SF}/{table}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return db


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def run(spark, name):
    return entry.queries()[name](spark, SF)


def test_the_oracles_agree(spark, duck):
    for name in ("op1_decontaminate", "op2_chat_format", "op6_mix", "op7_minhash", "op8_suffixes", "op9_lines", "op10_embeddings"):
        found = run(spark, name)
        wanted = duck.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in wanted.description]
        assert sorted(found.columns) == sorted(columns)
        assert rows(found, *columns) == sorted(map(tuple, wanted.fetchall()), key=repr), name


def test_op1_by_brute_force(spark, duck, texts):
    def words(text):
        out, word = [], ""
        for c in brute.lower(text or "") + " ":
            if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) >= 128:
                word += c
            elif word:
                out.append(word)
                word = ""
        return out

    windows = defaultdict(set)
    for item, text in duck.execute("SELECT item_id, text FROM benchmark").fetchall():
        w = words(text)
        for k in range(len(w) - min(13, len(w)) + 1) if w else ():
            windows[tuple(w[k : k + 13])].add(str(item))
    sizes = sorted({len(w) for w in windows})
    wanted = []
    for doc, text in texts.items():
        w = words(text)
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit |= set(range(k, k + n))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        wanted.append((doc, len(w), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    found = run(spark, "op1_decontaminate")
    assert rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(wanted, key=repr)
    assert any(w[-1] for w in wanted)


def test_op3_is_the_minimax_partition(spark, texts):
    found = run(spark, "op3_shard").collect()
    assert {r.doc_id for r in found} == set(texts) and len(found) == len(texts)
    size = {i: len((t or "").encode()) + 1 for i, t in texts.items()}
    groups, shard_of_text = defaultdict(int), defaultdict(set)
    slots, load = defaultdict(list), defaultdict(int)
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size[r.doc_id], zlib.crc32(raw), "bytes", None)
        groups[texts[r.doc_id] or ""] += r.size
        shard_of_text[texts[r.doc_id] or ""].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in shard_of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    key = {r["text"]: r["key"] for r in spark.read.parquet(f"{SF}/documents.parquet").selectExpr("coalesce(text, '') as text", "shiftleft(crc32(coalesce(text, '')), 31) | (xxhash64(coalesce(text, '')) & 2147483647) as key").distinct().collect()}
    ordered = [groups[t] for t in sorted(groups, key=key.get)]

    def fits(capacity):
        used, at = 1, 0
        for g in ordered:
            if g > capacity:
                return False
            if at + g > capacity:
                used, at = used + 1, 0
            at += g
        return used <= 16

    low, high = 0, sum(ordered)
    while low < high:
        low, high = (low, (low + high) // 2) if fits((low + high) // 2) else ((low + high) // 2 + 1, high)
    assert max(load.values()) == low


def test_op4_on_held_out_documents(spark, duck, texts):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    found = run(spark, "op4_language").collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0.0 <= r.score <= 1.0
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    judged = [r for r in found if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in judged]) >= 0.9


def test_op5_on_held_out_documents(spark, duck, texts):
    toxic = dict(duck.execute("SELECT doc_id, toxic FROM labels").fetchall())
    found = run(spark, "op5_toxicity").collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5)
    for held_out in (True, False):
        pairs = [(r.score, toxic[r.doc_id]) for r in found if r.held_out == held_out and toxic.get(r.doc_id) is not None]
        bad, good = [s for s, t in pairs if t == 1], [s for s, t in pairs if t == 0]
        if bad and good:
            auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
            print("toxicity", "held out" if held_out else "learnt", "rows", len(pairs), "auc", round(float(auc), 4), "accuracy", np.mean([(s >= 0.5) == t for s, t in pairs]))
            assert auc >= 0.85


def test_op6_rules(spark):
    found = run(spark, "op6_mix").collect()
    by_source = defaultdict(list)
    for r in found:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by_source[r.source_size, r.target].append(r)
    total = sum(r.size for r in found)
    assert math.isclose(sum(t for _, t in by_source), total, rel_tol=1e-9)
    for (size, target), members in by_source.items():
        assert size == sum(r.size for r in members) and target <= 3 * size * (1 + 1e-12)
        spread = math.sqrt(sum(r.size**2 for r in members))
        assert abs(sum(r.taken for r in members) - target) <= 3 * spread
    assert rows(run(spark, "op6_mix"), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in found), key=repr)


def test_op7_by_brute_force(spark, texts):
    wanted = [(i, *v) for i, v in brute.near_duplicates(texts).items()]
    assert rows(run(spark, "op7_minhash"), "doc_id", "n_shingles", "component_id", "kept") == sorted(wanted, key=repr)


def test_op8_by_brute_force(spark, texts):
    wanted = [(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, (n, gone, spans, kept) in brute.repeated_bytes(texts).items()]
    assert rows(run(spark, "op8_suffixes"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(wanted, key=repr)


def test_op10_by_brute_force(spark, duck):
    vectors = duck.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    good = [(i, np.asarray(v, float), label) for i, v, label in vectors if label is not None and v and not any(x is None for x in v) and np.isfinite(v).all() and np.any(v)]
    links, count = [], defaultdict(int)
    for k, (i, v, label) in enumerate(good):
        for j, w, other in good[:k]:
            if label == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    component = brute.components([i for i, _, _ in vectors], links)
    wanted = [(i, count[i], component[i], component[i] == i) for i, _, _ in vectors]
    assert rows(run(spark, "op10_embeddings"), "vec_id", "n_links", "component_id", "kept") == sorted(wanted, key=repr)


def test_pipeline_keeps_what_it_should(spark, duck, texts):
    found = [r.asDict() for r in run(spark, "pipeline").collect()]
    assert found and set(found[0]) == {"doc_id", "text", "lang", "source", "n_chars", "shard"}
    kept = {r["doc_id"] for r in found}
    assert all(texts[r["doc_id"]] == r["text"] for r in found)
    contaminated = {r.doc_id for r in run(spark, "op1_decontaminate").where("contaminated").collect()}
    assert not kept & contaminated
    similar = brute.near_duplicates({i: texts[i] for i in kept})
    assert all(v[2] for v in similar.values())
    shards = defaultdict(set)
    for r in found:
        shards[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())
