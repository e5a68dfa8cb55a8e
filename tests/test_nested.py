import datetime as dt

import pytest
from pyspark.sql import functions as F

from twintable.plans import nested
from twintable.plans.fabricate.table import Options, fabricate

SCHEMA = ("k long, tags array<string>, m map<string,double>, s struct<a:int,b:array<struct<x:double,y:boolean>>>, "
          "grid array<array<int>>, seen array<timestamp>, note string, never array<int>")


@pytest.fixture(scope="module")
def table(spark):
    day = dt.datetime(2024, 1, 1, 12)
    rows = [(i, [f"t{j}" for j in range(i % 4)] if i % 5 else None, {"p": float(i), "q": None} if i % 2 else {},
             (i, [(i / 7, i % 2 == 0)] * (i % 3)) if i % 7 else None, [[1, 2], [], [i]] if i % 3 else [None],
             [day + dt.timedelta(hours=i)], "note", None) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


def test_paths_and_counts(table):
    found = {r["path"]: r for r in nested.profile_nested(table).collect()}
    assert list(found) and set(found) == {
        "k", "tags", "tags[]", "m", "m{key}", "m{value}", "s", "s.a", "s.b", "s.b[]", "s.b[].x", "s.b[].y", "grid", "grid[]", "grid[][]",
        "seen", "seen[]", "note", "never", "never[]"}
    assert (found["tags"].n_total, found["tags"].n_missing, found["tags"].max) == (60, 12, 3)
    assert found["tags[]"].n_total == sum(i % 4 for i in range(60) if i % 5) and found["tags[]"].n_distinct == 3
    assert (found["m{key}"].n_total, found["m{value}"].n_missing) == (60, 30)
    assert found["s.a"].n_total == 60 - found["s"].n_missing and found["s"].n_distinct is None
    assert found["s.b[].y"].n_distinct == 2 and found["grid[]"].n_missing == 20
    assert (found["never"].n_missing, found["never[]"].n_total, found["never[]"].n_distinct) == (60, 0, 0)


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_no_column_vanishes(table, method):
    twin = fabricate(table, 200, Options(seed=3, method=method, partitions=3))
    assert twin.schema.simpleString() == table.schema.simpleString()
    rows = twin.collect()
    assert len(rows) == 200 and all(r.never is None for r in rows)
    assert {len(r.tags) for r in rows} == {0, 1, 2, 3} and {x for r in rows for x in r.tags} == {"t0", "t1", "t2"}
    assert {k for r in rows for k in r.m} == {"p", "q"} and all(0 <= v <= 59 for r in rows for v in r.m.values())
    assert all(0 <= e.x <= 59 / 7 and e.y in (True, False) for r in rows for e in r.s.b)
    assert len({tuple(e.x for e in r.s.b) for r in rows if len(r.s.b) == 2}) > 50  # elements are drawn apart
    assert all(dt.datetime(2024, 1, 1, 12) <= x <= dt.datetime(2024, 1, 4) for r in rows for x in r.seen)
    again = fabricate(table.repartition(5), 200, Options(seed=3, method=method, partitions=7))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows))


def test_missing_values_and_own_generators(table):
    twin = fabricate(table, 400, Options(seed=3, keep_nulls=True, generators={"tags": lambda c, meta, draws: F.array(F.lit("own"))}))
    rows = twin.collect()
    assert {tuple(r.tags) for r in rows} == {("own",)}
    assert 20 < sum(r.s is None for r in rows) < 110 and any(v is None for r in rows for v in r.m.values())


def test_nested_columns_alone_and_empty_tables(table):
    twin = fabricate(table.select("tags", "grid"), 10)
    assert twin.columns == ["tags", "grid"] and twin.count() == 10
    none = fabricate(table.limit(0).select("k", "tags"), 5).collect()
    assert len(none) == 5 and all(r.tags is None for r in none)
    assert {r.n_total for r in nested.profile_nested(table.limit(0)).collect()} == {0}
