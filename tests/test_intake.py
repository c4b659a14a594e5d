"""Intake and layout on small rows: limits, replays, stages, reading order, rows without text."""

import io
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as tx
from sievewright.functions import layout
from sievewright.functions.layout import reading_order
from sievewright.plans import batches, ingest
from sievewright.sources import documents as sources


def test_within_total_passes_over_what_does_not_fit(spark):
    sizes = {"a": [6, 7, 3, None, 2, 1], "b": [11, 10, 1], "c": []}
    rows = [(b, f"{k:02d}", n) for b, of in sizes.items() for k, n in enumerate(of)]
    files = spark.createDataFrame(rows, "batch_id string, path string, length long").repartition(3)
    found = {(r.batch_id, r.path): r.taken for r in sources.within_total(files, 10).collect()}
    wanted = {}
    for b, of in sizes.items():
        used = 0
        for k, n in enumerate(of):
            fits = n is not None and used + n <= 10
            used += n if fits else 0
            wanted[b, f"{k:02d}"] = fits
    assert found == wanted and sum(found.values()) == 4
    assert sources.within_total(files.limit(0), 10).count() == 0


def archive(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, size in members:
            z.writestr(name, "x" * size)
    return out.getvalue()


def test_archives_of_a_batch_share_their_limit(spark):
    rows = [
        ("u", "a.zip", archive(("d/one.txt", 4), ("two.bin", 50), ("__MACOSX/t.txt", 50), ("three.md", 3))),
        ("u", "b.ZIP", archive(("four.txt", 2), ("five.txt", 9), ("six.txt", 1))), ("u", "c.zip", archive(("seven.txt", 1))),
        ("v", "d.zip", archive(("eight.txt", 10))), ("v", "e.zip", b"none"), ("v", "f.zip", None), ("v", "plain.txt", b"hello"), (None, "g.zip", archive(("nine.txt", 11))),
    ]
    files = spark.createDataFrame(rows, "batch_id string, path string, content binary")
    found = {(r.path, r.filename): None if r.content is None else len(r.content) for r in sources.expand_archives(files, 10).collect()}
    assert found == {
        ("a.zip", "one.txt"): 4, ("a.zip", "three.md"): 3, ("b.ZIP", "four.txt"): 2, ("b.ZIP", "five.txt"): None, ("b.ZIP", "six.txt"): None, ("c.zip", "seven.txt"): 1,
        ("d.zip", "eight.txt"): 10, ("e.zip", "e.zip"): None, ("f.zip", "f.zip"): None, ("plain.txt", "plain.txt"): 5, ("g.zip", "nine.txt"): None,
    }


def test_replays_and_conflicts(spark):
    rows = [(1, "u", "k", "m"), (2, "u", "k", "m"), (3, "u", "k", "n"), (4, "v", "k", "m"), (5, "u", None, "m"), (6, "u", None, "m")]
    jobs = spark.createDataFrame(rows, "job_id long, user string, key string, manifest_hash string")
    found = {r.job_id: (r.replay_of, r.conflict) for r in sources.replays(jobs, ["user", "key"]).collect()}
    assert found == {1: (None, False), 2: (1, False), 3: (1, True), 4: (None, False), 5: (None, False), 6: (None, False)}


def test_a_stage_writes_its_columns_alone(spark):
    people = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, state string")
    stage = spark.createDataFrame([(2, None)], "id long, state string")
    assert sorted(map(tuple, batches.staged(people, stage, "id", ("state",)).collect())) == [(1, "a", "x"), (2, "b", None)]
    with pytest.raises(ValueError, match="name"):
        batches.staged(people, stage.withColumnRenamed("state", "name"), "id", ("state",))
    assert [r.id for r in batches.orphans(people, stage, "id").collect()] == [1]


def by_cuts(lines):
    """Reading order of (index, box) by its definition: cut at the widest gutter, else sort."""
    for low, least in ((0, 20), (1, 12)):
        placed = sorted(lines, key=lambda line: line[1][low])
        gutters = [(placed[k][1][low] - max(p[1][low + 2] for p in placed[:k]), k) for k in range(1, len(placed))]
        wide = [g for g in gutters if g[0] > least]
        if wide:
            k = max(wide)[1]
            return by_cuts(placed[:k]) + by_cuts(placed[k:])
    return [i for i, box in sorted(lines, key=lambda line: (line[1][1], line[1][0]))]


def test_reading_order_by_its_definition(spark):
    pick = random.Random(3)
    pages = [[], [[5.0, 5.0, 9.0, 9.0]], [[0.0, 0.0, 1.0, 1.0]] * 3]
    for _ in range(60):
        corners = [(pick.randrange(0, 400, 20), pick.randrange(0, 300, 10)) for _ in range(pick.randrange(1, 14))]
        pages.append([[float(x), float(y), float(x + pick.randrange(10, 90, 10)), float(y + pick.randrange(4, 20))] for x, y in corners])
    table = spark.createDataFrame([(k, p) for k, p in enumerate([*pages, None])], "page long, boxes array<array<double>>")
    found = {r.page: r.found for r in table.select("page", reading_order(F.col("boxes")).alias("found")).collect()}
    assert found.pop(len(pages)) is None
    assert found == {k: by_cuts(list(enumerate(p))) for k, p in enumerate(pages)}


def test_pages_are_cut_together():
    pick = random.Random(4)
    pages = [[[float(x), float(y), float(x + 30), float(y + 8)] for x, y in ((pick.randrange(0, 300, 20), pick.randrange(0, 200, 10)) for _ in range(pick.randrange(1, 9)))] for _ in range(3000)]
    page, boxes = np.repeat(np.arange(len(pages)), [len(p) for p in pages]), np.array([b for p in pages for b in p])
    first = np.searchsorted(page, np.arange(len(pages)))
    began = time.perf_counter()
    found = layout._order(page, boxes)
    assert time.perf_counter() - began < 2
    assert [list(f - a) for f, a in zip(np.split(found, first[1:]), first)] == [by_cuts(list(enumerate(p))) for p in pages]


def test_rows_without_text_stay(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Ann Lee\nann@x.org")], "doc_id long, text string")
    left = {r.doc_id: r for r in ingest.anonymised(ingest.structured(docs)).collect()}
    assert set(left) == {1, 2, 3} and not any(r.leaked for r in left.values()) and left[1].text is None
    assert {r.doc_id: (r.email, r.stated_years) for r in ingest.structured(docs).collect()}[1] == (None, None)
    assert not docs.where("doc_id = 1").select(tx.evidence_found(F.lit("the"), F.col("text"))).first()[0]
