"""Alias tables give every value exactly its weight, whatever the weights are."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from twintable.functions.draw import Draws
from twintable.operators import prefix
from twintable.operators.alias import alias_table, pick_by_alias
from twintable.plans.fabricate import categorical

CASES = {
    "one": [7],
    "equal": [4, 4, 4],
    "light then heavy": [1, 1, 1, 1, 96],
    "exactly average among others": [3, 1, 5, 3, 3, 2, 4],
    "two heavy, a zero": [50, 0, 1, 1, 48, 1, 1],
    "rising": list(range(1, 60)),
    "a light value that needs several heavy ones": [1, 101, 101, 101, 101, 101, 101, 101, 101, 101],
    "beyond 64 bits": [2**61, 2**61, 1, 3, 2**60],
}


def shares(cells, total):
    """What each value gets over all cells, in units of 1 / n."""
    got = Counter()
    for r in cells:
        assert 0 <= r["keep"] <= total
        got[r["value"]] += int(r["keep"])
        if r["keep"] < total:
            assert r["other"] is not None
            got[r["other"]] += total - int(r["keep"])
    return got


@pytest.mark.parametrize("name", CASES)
def test_each_value_gets_exactly_its_weight(spark, name):
    weights = CASES[name]
    frame = spark.createDataFrame([(f"v{i}", w) for i, w in enumerate(weights)], "v string, w long")
    for per_bucket in (1_000_000, 3)[:2 if name == "two heavy, a zero" else 1]:
        table, n, total = alias_table(frame, "v", "w", per_bucket)
        cells = table.collect()
        assert (n, total) == (len(weights), sum(weights))
        assert sorted(r["number"] for r in cells) == list(range(n))
        got = shares(cells, total)
        assert {v: x for v, x in got.items() if x} == {f"v{i}": n * w for i, w in enumerate(weights) if w}


def test_nothing_to_draw_from(spark):
    for rows in ([], [("a", 0)]):
        with pytest.raises(ValueError):
            alias_table(spark.createDataFrame(rows, "v string, w long"), "v", "w")


def test_one_value_of_nine_tenths_among_a_million(spark):
    n = 1_000_000
    values = spark.range(n).select(F.concat(F.lit("v"), "id").alias("v"), F.when(F.col("id") == 0, 9 * (n - 1)).otherwise(1).alias("w"))
    table, found, total = alias_table(values, "v", "w")
    assert (found, total) == (n, 10 * (n - 1))
    own = F.col("keep").cast("decimal(38,0)")
    row = table.agg(
        F.count_distinct("number").alias("cells"), F.min("number").alias("low"), F.max("number").alias("high"),
        F.sum(F.when(F.col("value") == "v0", own).otherwise(0)).alias("kept"),
        F.sum(F.when((F.col("other") == "v0") & (F.col("value") != "v0"), total - own).otherwise(0)).alias("lent"),
        F.sum(F.when(F.col("value") != "v0", F.when(own == n, 0).otherwise(1)).otherwise(0)).alias("wrong"),
    ).first()
    # each light value keeps n of W, all gaps go to the heavy one, and that is one cell in a million
    assert (row["cells"], row["low"], row["high"], row["wrong"]) == (n, 0, n - 1, 0)
    assert int(row["kept"]) + int(row["lent"]) == n * 9 * (n - 1)


def test_draws_follow_the_weights_and_keep_columns(spark):
    seen = spark.range(2000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('v', id % 40) END AS c")
    rows = spark.range(20_000).selectExpr("id AS row_id", "id AS `a.b`")
    drawn = categorical.add_long_category(rows, seen, "c", 3, long_lists="alias")
    assert drawn.columns == ["row_id", "a.b", "c"]
    got = Counter(r["c"] for r in drawn.collect())
    assert sum(got.values()) == 20_000 and got["hot"] == pytest.approx(10_000, rel=0.05)
    assert all(got[f"v{i}"] == pytest.approx(500, rel=0.25) for i in range(1, 40, 2))
    again = categorical.add_long_category(rows.repartition(5), seen.repartition(3), "c", 3, long_lists="alias")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))
    with pytest.raises(ValueError):
        categorical.add_long_category(rows, seen, "c", 3, long_lists="tree")
    none = pick_by_alias(rows.limit(0), F.lit(0.5), F.lit(0.5), spark.createDataFrame([("a", 1)], "v string, w long"), "v", "w", "x")
    assert none.count() == 0 and none.columns == ["row_id", "a.b", "x"]


def test_spans_list_cells_in_short_rows(spark, monkeypatch):
    values = spark.range(300).select(F.concat(F.lit("v"), "id").alias("v"), F.when(F.col("id") == 0, 900).otherwise(1).alias("w"))
    rows = spark.range(500).withColumnRenamed("id", "row_id")
    u = Draws(3, "c", F.col("row_id"))(0)
    whole = {r.row_id: r.c for r in prefix.pick_by_span(rows, u, values, "v", "w", "c").collect()}
    monkeypatch.setattr(prefix, "CELLS_A_ROW", 7)
    assert {r.row_id: r.c for r in prefix.pick_by_span(rows, u, values, "v", "w", "c").collect()} == whole
    assert len(whole) == 500
