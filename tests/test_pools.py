"""Draws from the user's own lists."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from twintable.functions.draw import Draws
from twintable.plans.fabricate import pools
from twintable.plans.fabricate.table import Options, fabricate


@pytest.fixture
def lists(spark):
    rows = [("de", f"d{i}") for i in range(300)] + [("fr", "f0"), ("fr", "f1"), ("fr", "f1"), ("it", None), (None, "x")]
    return spark.createDataFrame(rows, "region string, name string")


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_short_and_long_pools_with_null_and_unknown_keys(spark, lists, monkeypatch, broadcast):
    monkeypatch.setattr(pools, "BROADCAST_ROWS", broadcast)
    table = pools.index_pools(lists, "name", "region")
    keys = ["de", "fr", "it", None, "??"]
    rows = spark.createDataFrame([(i, keys[i % 5], "value") for i in range(6000)], "row_id long, place string, number string")
    u = Draws(1, "n", F.col("row_id"))(0)
    got = pools.draw_from_pools(rows, "n", table, u, F.col("place"), default="fr")
    assert got.columns == ["row_id", "place", "number", "n"]
    found = got.collect()
    assert len(found) == 6000
    german = Counter(r.n for r in found if r.place == "de")
    assert set(german) <= {f"d{i}" for i in range(300)} and len(german) > 280 and max(german.values()) < 20
    rest = Counter(r.n for r in found if r.place != "de")
    assert set(rest) == {"f0", "f1"} and 0.45 < rest["f0"] / 4800 < 0.55
    none = pools.draw_from_pools(rows, "n", table, u, F.col("place")).filter("n IS NULL")
    assert none.count() == 3600
    again = pools.draw_from_pools(rows.repartition(5), "n", pools.index_pools(lists.repartition(3), "name", "region"), u,
                                  F.col("place"), default="fr")
    assert sorted(r[0::3] for r in again.collect()) == sorted(r[0::3] for r in found)


def test_one_pool_empty_pools_and_whole_tables(spark, lists):
    one = pools.index_pools(lists, "name")
    df = spark.createDataFrame([(i, f"s{i % 3}", "de" if i % 2 else "fr") for i in range(60)], "k long, shop string, region string")
    twin = fabricate(df, 200, Options(seed=4, repair=False, pools={
        "shop": (pools.index_pools(lists, "name", "region"), "region")})).collect()
    assert len(twin) == 200 and all(r.shop[0] == r.region[0] for r in twin)
    rows = spark.range(50).select(F.col("id").alias("row_id"))
    assert {r.n[0] for r in pools.draw_from_pools(rows, "n", one, Draws(1, "n", F.col("row_id"))(0)).collect()} <= set("dfx")
    empty = pools.index_pools(lists.filter("name = '-'"), "name")
    assert pools.draw_from_pools(rows, "n", empty, F.lit(0.5)).filter("n IS NULL").count() == 50
