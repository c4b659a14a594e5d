"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievewright.llm import chat, decontaminate, embeddings, langid, lines, minhash, mix, shard, suffixes, toxicity

from . import brute

LONG = " ".join(f"word{k % 997} and{k % 31}" for k in range(40_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly count every single star above"
TEXTS = [
    (1, "a plain text about nothing in particular that nobody would ever copy on purpose today", "en", "s1"),
    (1, "a plain text about nothing in particular that nobody would ever copy on purpose today", "en", "s1"),
    (2, None, None, None),
    (3, "", "en", "s1"),
    (4, LONG, "de", "s2"),
    (5, LONG, "de", None),
    (6, f"before {PASSAGE} after", "en", "s2"),
    (7, "   \n\t ", None, "s2"),
    (None, "no id at all but some words", "en", "s3"),
    (8, "... 123 !!!", "fr", "s3"),
    (9, "one\ntwo\nthree\nfour\none\ntwo\nthree", "fr", "s3"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, mix_rate int, sig string, row string, spans int, shard_key string, label int, `Bands` int"


def messy(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "k", 1, None, "r", 2, "x", None, 3) for i, t, l, s in rows], SCHEMA)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_decontamination(spark):
    bench = spark.createDataFrame([("a", PASSAGE, 1), ("a", PASSAGE, 1), ("b", None, 1), (None, "x", 1), ("c", "fox jumps", 1), ("d", "  ", 1)], "item_id string, text string, key int")
    found = {r.doc_id: r for r in decontaminate.find_contamination(messy(spark), bench).collect()}
    assert (found[6].n_hit, found[6].item_ids, found[6].contaminated) == (18, ["a", "c"], True)
    assert (found[2].n_words, found[3].n_words, found[7].n_words, found[8].n_words) == (0, 0, 0, 1)
    assert not any(r.contaminated for i, r in found.items() if i != 6)
    joined = decontaminate.find_contamination(messy(spark), bench, max_broadcast_words=1)
    names = ("doc_id", "n_words", "n_hit", "item_ids", "contaminated")
    assert listed(joined, *names) == listed(decontaminate.find_contamination(messy(spark), bench), *names)
    for most in (1, 4_000_000):
        kept = decontaminate.drop_contaminated(messy(spark), bench, max_broadcast_words=most)
        assert kept.columns == messy(spark).columns and kept.count() == len(TEXTS) - 1
    for most in (1, 4_000_000):
        cut = {r.doc_id: r.text for r in decontaminate.remove_spans(messy(spark), bench, max_broadcast_words=most).collect()}
        assert cut == {i: "before  after" if i == 6 else t for i, t, _, _ in TEXTS}
        assert decontaminate.remove_spans(messy(spark), bench.limit(0), max_broadcast_words=most).count() == len(TEXTS)
    assert decontaminate.find_contamination(messy(spark, []), bench).count() == 0
    assert decontaminate.drop_contaminated(messy(spark), bench.limit(0)).count() == len(TEXTS)


def test_decontamination_is_linear_in_repeated_words():
    index = decontaminate.WindowSet([("a", b"go " * 100_000), ("b", b"go " * 13), ("c", b"go " * 12 + b"on")], 13)
    begin = time.perf_counter()
    n, hit, items = index.scan(b"go " * 100_000 + b"on and on")
    assert (n, int(hit.sum()), items) == (100_003, 100_001, {"a", "b", "c"})
    assert time.perf_counter() - begin < 1.0


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "span_hashes", lambda data, a, b: np.zeros(len(a), np.uint64) + np.uint64(7))
    index = decontaminate.WindowSet([("a", b"x y z"), ("b", b"z y x"), ("c", b"x y z"), ("d", b"y y")], 3)
    for text, hit, items in ((b"q z y x", 3, {"b"}), (b"x y z y x", 5, {"a", "b", "c"}), (b"y y y", 3, {"d"}), (b"x z", 0, set())):
        _, found, named = index.scan(text)
        assert (0 if found is None else int(found.sum()), named) == (hit, items)


def test_chat(spark):
    turns = [(1, 1, "user", "hi <|im_end|> \\l"), (1, 2, "assistant", "</s>\\\n"), (1, 3, "user", None), (1, 4, "assistant", "é" * 50_000), (2, None, None, None), (None, 1, "assistant", "x"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    table = spark.createDataFrame([(*t, "p") for t in turns], "conv_id long, turn long, role string, text string, piece string")
    formatted = chat.format_turns(table)
    found = {r.conv_id: r for r in chat.digest(formatted).collect()}
    assert (found[1].n_turns, found[1].loss_chars, found[2].loss_chars, found[3].n_turns) == (4, 50_005 + 1, 0, 2)
    assert found[1].loss_sha256 == hashlib.sha256(("</s>\\\n" + "é" * 50_000).encode()).hexdigest()
    examples = [r for r in chat.render_examples(formatted).collect() if r.conv_id == 1]
    assert len(examples) == 2
    for e in examples:
        assert e.text[e.loss_end :] == chat.END and e.text.count(chat.START) == e.target
    assert chat.digest(chat.format_turns(table.limit(0))).count() == 0


def test_chat_loss_is_read_from_the_examples(spark, monkeypatch):
    table = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", "abc"), (1, 3, "user", "so"), (1, 4, "assistant", "<|defg")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(table)
    examples = chat.prefix_target_examples(formatted)
    right = chat.digest(formatted).first()
    assert (right.n_examples, right.context_sha256) == (2, hashlib.sha256("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user\nso<|im_end|>\n<|im_start|>assistant\n".encode()).hexdigest())
    moved = chat.digest(formatted.withColumn("piece_start", formatted.piece_start + 1)).first()
    assert moved.loss_sha256 != right.loss_sha256 and moved.context_sha256 != right.context_sha256 and moved.context_chars == right.context_chars + 2
    for altered, loss in ((examples, "abc<|defg"), (examples.where("target = 4"), "<|defg"), (examples.withColumn("loss_end", examples.loss_end - 1), "ab<|def")):
        monkeypatch.setattr(chat, "prefix_target_examples", lambda turns, altered=altered: altered)
        found = chat.digest(formatted).first()
        assert (found.n_turns, found.loss_chars, found.loss_sha256) == (4, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_digest_reads_the_texts_of_the_examples(spark, monkeypatch):
    table = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", "abc"), (1, 3, "user", "so"), (1, 4, "assistant", "defg"), (2, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(table)
    right = {r.conv_id: r for r in chat.digest(formatted).collect()}
    assert (right[2].n_examples, right[2].loss_sha256, right[2].context_sha256) == (0, *[hashlib.sha256(b"").hexdigest()] * 2)
    render = chat.render_examples
    # an example whose context lacks its first turn's text, and one whose reply is another's
    for old, new in (("hi", "HI"), ("defg", "DEFG")):
        monkeypatch.setattr(chat, "render_examples", lambda *a, old=old, new=new, **k: render(*a, **k).withColumn("text", F.replace("text", F.lit(old), F.lit(new))))
        found = {r.conv_id: r for r in chat.digest(formatted).collect()}
        assert found[1].turns_sha256 == right[1].turns_sha256 and (found[1].context_sha256 != right[1].context_sha256) == (old == "hi") and (found[1].loss_sha256 != right[1].loss_sha256) == (old == "defg")


def test_shards(spark):
    found = shard.shard_slots(messy(spark)).collect()
    assert len(found) == len(TEXTS)
    by_text = {}
    for r in found:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert shard.assign_shards(messy(spark)).columns == [*messy(spark).columns, "shard"]
    assert shard.shard_slots(messy(spark, [])).count() == 0
    assert shard.assign_shards(messy(spark, [])).count() == 0
    assert {r.shard for r in shard.assign_shards(messy(spark), 1).collect()} == {0}


@pytest.mark.parametrize("place", [0, 100, 200])
def test_shards_beside_a_hot_group(spark, place):
    groups = [(k << 47, 10_000 if k == place else 100) for k in range(201)]
    capacity, cuts = shard.minimax_cuts(spark.createDataFrame(groups, "key long, bytes long"), 16)
    loads = [sum(size for key, size in groups if low <= key < high) for low, high in zip([0, *cuts], [*cuts, 1 << 63])]
    assert capacity == max(loads) == 10_000
    assert min(loads) >= 1_200 and sorted(loads)[-2] <= 2_000


def test_shards_of_few_groups_in_one_bin(spark):
    groups = [(k << 20, 10 + k) for k in range(16)]
    _, cuts = shard.minimax_cuts(spark.createDataFrame(groups, "key long, bytes long"), 16)
    assert cuts == [k << 20 for k in range(1, 16)]


def test_language(spark):
    english = [(k, f"the house and the river were near the old mill {k}", "en", None) for k in range(10, 70)]
    french = [(k + 100, f"la maison et la rivière étaient près du vieux moulin {k}", "fr", None) for k in range(60)]
    docs = messy(spark, [*TEXTS, *english, *french])
    found = {r.doc_id: r for r in langid.query(docs).collect()}
    assert {found[i].lang_pred for i in (2, 3, 7, 8)} == {"und"} and all(0 <= r.score <= 1 for r in found.values())
    held = [r for i, r in found.items() if i and 10 <= i and r.held_out]
    assert held and all(r.lang_pred == ("en" if r.doc_id < 100 else "fr") for r in held)
    assert {r.lang_pred for r in langid.query(messy(spark, [(1, "text", None, None)])).collect()} == {"und"}
    assert langid.query(messy(spark, [])).count() == 0


def test_toxicity(spark):
    rude = [(k, f"the weather was mild. you are a total zorgblat and everybody knows {k}", None, None) for k in range(10, 70)]
    mild = [(k + 100, f"the weather was mild. you are a total friend and everybody knows {k}", None, None) for k in range(60)]
    altered = [(500, "honestly, what a z.o-r_g.b-l.a.t you are", None, None), (501, "such a zorxgblat he is", None, None)]
    docs = messy(spark, [*TEXTS, *rude, *mild, *altered])
    labels = spark.createDataFrame([*((k, 1, 1) for k in range(10, 70)), *((k + 100, 0, 1) for k in range(60)), (None, 1, 1), (2, 0, 1), (9999, 1, 1), (5, None, 1)], "doc_id long, toxic int, text int")
    found = {r.doc_id: r for r in toxicity.query(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    assert all(found[k].predicted == 1 for k in range(10, 70)) and all(found[k + 100].predicted == 0 for k in range(60))
    assert found[501].predicted == 1 and not any(found[i].predicted for i in (2, 3, 7, 8))
    assert toxicity.query(docs, labels.limit(0)).where("score > 0.001").count() == 0
    assert toxicity.query(messy(spark, []), labels).count() == 0
    model = toxicity.train_on_folds(docs, labels)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id between 10 and 69").count() == 0


def test_mix(spark):
    sized = messy(spark).select("doc_id", "source", mix.word_count("text").alias("size"))
    found = mix.mix_counts(sized).collect()
    assert len(found) == len(TEXTS) and all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in found)
    assert mix.mix_documents(messy(spark)).columns == messy(spark).columns
    assert mix.mix_documents(messy(spark, [])).count() == 0
    wordless = [(1, None, None, "a"), (2, "", None, None)]
    assert {r.target for r in mix.mix_counts(messy(spark, wordless).select("doc_id", "source", mix.word_count("text").alias("size"))).collect()} == {0.0}


def test_minhash(spark):
    found = {}
    for r in minhash.near_duplicates(messy(spark)).collect():
        found.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    wanted = {i: {v} for i, v in brute.near_duplicates({i: t for i, t, _, _ in TEXTS if i is not None}).items()}
    assert {i: v for i, v in found.items() if i is not None} == wanted
    kept = minhash.drop_near_duplicates(messy(spark))
    assert kept.columns == messy(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert minhash.near_duplicates(messy(spark, [])).count() == 0 and minhash.drop_near_duplicates(messy(spark, [])).count() == 0


def test_pipeline_takes_four_fifths_as_similar(spark):
    words = [[f"w{g}n{k}" for k in range(n)] for g, n in enumerate((44, 60, 80))]
    near = [(10 * g + k, " ".join(["x", *w[:20], "y", *w[21:]] if k else w), None, None) for g, w in enumerate(words) for k in (0, 1)]
    for percent, groups in ((80, 4), (85, 5)):
        found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(messy(spark, near), percent=percent).collect()}
        assert found == brute.near_duplicates({i: t for i, t, _, _ in near}, percent)
        assert sum(v[2] for v in found.values()) == groups
    kept = corpus_pipeline.drop_near_duplicates(spark, messy(spark, near), "")
    assert {r.doc_id for r in kept.collect()} == {i for i, v in brute.near_duplicates({i: t for i, t, _, _ in near}, 80).items() if v[2]}


def test_minhash_estimate_loses_few_pairs_at_the_threshold():
    chance = 1 / (1 << minhash.BITS)
    for threshold in (0.80, 0.85):
        least = math.ceil(minhash.MINIMA * ((threshold - minhash.SLACK) * (1 - chance) + chance))
        agree = threshold + (1 - threshold) * chance
        assert sum(math.comb(minhash.MINIMA, k) * agree**k * (1 - agree) ** (minhash.MINIMA - k) for k in range(least)) < 1e-6


def test_minhash_blocks(spark, monkeypatch):
    words = [f"w{k}" for k in range(120)]
    near = [(k, " ".join(words[:k] + [f"x{k}"] + words[k + 1 :]), None, None) for k in range(100)]
    monkeypatch.setattr(minhash, "BLOCK", 7)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(messy(spark, near)).collect()}
    assert found == brute.near_duplicates({i: t for i, t, _, _ in near})


@pytest.mark.parametrize("block", [4, 6000])
def test_suffixes(spark, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    shared = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(330))
    rows = [(20 + k, f"{'é' * k}{k} {shared[k:]} {k * 77}", None, None) for k in range(12)]
    rows += [(40, "z" * 3000, None, None), (41, None, None, None), (42, "", None, None), (43, shared[:199], None, None)]
    wanted = brute.repeated_bytes({i: t for i, t, _, _ in rows})
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.query(messy(spark, rows)).collect()}
    assert found == {i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, (n, gone, spans, kept) in wanted.items()}
    cut = suffixes.remove_repeats(messy(spark, rows))
    assert cut.columns == messy(spark).columns and {r.doc_id: r.text for r in cut.collect()}[41] is None
    assert suffixes.query(messy(spark, [])).count() == 0
    twice = suffixes.query(messy(spark, [(1, "a" + shared, None, None)] * 2)).collect()
    assert [r.n_removed for r in twice] == [331, 331]


def test_lines(spark):
    found = {r.doc_id: r for r in lines.query(messy(spark)).collect()}
    assert (found[9].n_lines, found[9].n_removed, found[9].n_runs) == (7, 3, 1) and found[2].n_lines == 0 and found[3].n_lines == 1
    kept = lines.dedup_lines(messy(spark))
    assert kept.columns == messy(spark).columns and {r.doc_id: r.text for r in kept.collect()}[9] == "one\ntwo\nthree\nfour"
    assert lines.query(messy(spark, [])).count() == 0


def test_lines_by_words(spark):
    licence = "permission is granted free of charge"
    rows = [(1, f"{licence}\nshort\n\nshort", None, None), (2, f"other\n{licence}\nshort\nown", None, None), (3, "a b c\nd e f\nshort\n\n", None, None), (4, "own\na b c\nd e f", None, None)]
    kept = {r.doc_id: r.text for r in lines.dedup_lines(messy(spark, rows)).collect()}
    assert kept == {1: rows[0][1], 2: "other\nown", 3: rows[2][1], 4: "own"}


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_lines_are_those_of_all_later_maximal_runs(spark, least):
    said = ["", "a", "b c", "d e f", "g h i j k l"]
    rows = [(k, "\n".join(said[(k * k * 7 + i * i * (k % 5 + 1) + i // 3) % 5] for i in range(1 + k % 13)), None, None) for k in range(40)]
    wanted = brute.later_runs({i: t for i, t, _, _ in rows}, least, 5)
    found = {r.doc_id: r.text for r in lines.dedup_lines(messy(spark, rows), min_lines=least, min_words=5).collect()}
    assert found == wanted


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 3)
    base = [1.0, 2.0, 3.0, -1.0]
    rows = [(k, [x + 0.001 * k for x in base], 1) for k in range(8)]
    rows += [(10, [1.0, 2.0, 3.0, -1.0], 2), (11, None, 1), (12, [], 1), (13, [0.0] * 4, 1), (14, [1.0, None, 3.0, -1.0], 1), (15, [float("nan")] * 4, 1), (16, base, None), (17, [2.0, 4.0], 1), (18, [1.0, 2.0], 1), (19, base, 2)]
    table = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<float>, label int, key string")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(table).collect()}
    wanted = {k: (7, 0, k == 0) for k in range(8)} | {k: (0, k, True) for k in range(11, 17)} | {10: (1, 10, True), 19: (1, 10, False), 17: (1, 17, True), 18: (1, 17, False)}
    assert found == wanted
    assert embeddings.near_vectors(table.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    messy(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (messy(spark), messy(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert set(messy(spark).columns) <= set(docs.columns), name
            docs.collect()
    assert 6 not in {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
