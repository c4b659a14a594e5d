"""Every query of the catalogue against its SQL, and without SQL for rows."""

import glob
import math
import os

import duckdb
import pytest

from sievewright.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    assert got
    if name in ORACLES:
        wanted = duck.execute(ORACLES[name])
        names = [c[0] for c in wanted.description]
        assert sorted(names) == sorted(found.columns)
        want = rows(names, wanted.fetchall())
        different = [(a, b) for a, b in zip(got, want) if a != b]
        assert len(got) == len(want) and not different, different[:3]


def test_documents_are_searched_for_leaks_in_many_tasks(spark):
    assert QUERIES["q_leak_check"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_answers_are_read_in_many_tasks(spark):
    assert QUERIES["q_normalised_answers"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
