"""Answers that must not change with size, layout or how a value is written."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from twintable.functions import dates, numbers
from twintable.operators import ecdf
from twintable.plans import knowledge, profile, risk
from twintable.plans.fabricate import temporal, text
from twintable.plans.fabricate.table import blend
from twintable.sources import files


@pytest.mark.parametrize("shape", [1e3, 9e3, 2e4, 1e6, 1e8, 1e10])
def test_gamma_of_large_shapes(spark, shape):
    # the median of a gamma distribution lies a third below its mean
    df = spark.createDataFrame([(shape - 1 / 3, shape), (shape + math.sqrt(shape), shape), (0.0, shape)], "v double, a double")
    got = [r[0] for r in df.select(numbers.gamma_cdf(F.col("v"), F.col("a"), F.lit(1.0))).collect()]
    assert got[0] == pytest.approx(0.5, abs=1e-4) and got[1] == pytest.approx(0.8413447, abs=2e-4) and got[2] == 0.0


def test_gamma_ways_agree_at_the_switch():
    a = np.full(5, 1e4)
    z = a + np.array([-250.0, -100.0, 1.0, 100.0, 250.0])
    logs = np.array([math.lgamma(x) for x in a])
    exact = np.where(z < a + 1, numbers._gamma_series(z, a, logs), 1 - numbers._gamma_fraction(z, a, logs))
    assert np.abs(numbers._gamma_uniform(z, a) - exact).max() < 1e-10


def test_rows_that_differ_by_a_microsecond_are_not_leaked(spark):
    def at(micros):
        return datetime(2024, 1, 1, 0, 0, 0, micros)

    a = spark.createDataFrame([(1, at(1), "x|y")], "k long, t timestamp, s string")
    b = spark.createDataFrame([(1, at(2), "x|y"), (1, at(1), "x|y")], "k long, t timestamp, s string")
    assert risk.leaked_rows(a, b).first().asDict() == {"shared_rows": 1, "n_syn": 2}
    wide = spark.createDataFrame([("ab", "c", 0.0)], "p string, q string, r double")
    other = spark.createDataFrame([("a", "bc", 0.0), ("ab", "c", -0.0)], "p string, q string, r double")
    assert risk.leaked_rows(wide, other).first()["shared_rows"] == 1


def test_a_column_is_read_in_one_layout(spark):
    df = spark.createDataFrame([("03/04/2024", "03/04/2024"), ("03/14/2024", "14/03/2024"), ("12/25/2024", "25/12/2024")], "us string, eu string")
    assert dates.column_layouts(df, ["us", "eu"]) == {"us": "M/d/yyyy", "eu": "d/M/yyyy"}
    found = {r["column"]: (str(r["min_date"])[:10], r["date_format"]) for r in profile.profile_temporal(df).collect()}
    assert found == {"us": ("2024-03-04", "%m/%d/%Y"), "eu": ("2024-03-14", "%d/%m/%Y")}


@pytest.mark.parametrize("written, moment", [
    ("2023-01-05T10:20:30Z", "2023-01-05 10:20:30"), ("2023-01-05T10:20:30+02:00", "2023-01-05 08:20:30"),
    ("5 January 2023", "2023-01-05 00:00:00"), ("Jan 5 2023", "2023-01-05 00:00:00"), ("1/5/2023 3:04 pm", "2023-01-05 15:04:00"),
    ("about 5 January 2023", None), ("2023-13-45", None),
])
def test_dates_as_people_write_them(spark, written, moment):
    got = spark.createDataFrame([(written,)], "t string").select(dates.parse_date(F.col("t"))).first()[0]
    assert (str(got) if got else None) == moment


def test_month_steps_keep_the_day(spark):
    rows = [str(r.ts)[:10] for r in temporal.regular_series(spark, "2023-01-01", "2023-05-15", "1 month").orderBy("step").collect()]
    assert rows == ["2023-01-01", "2023-02-01", "2023-03-01", "2023-04-01", "2023-05-01"]
    rows = [str(r.ts)[:10] for r in temporal.regular_series(spark, "2023-01-31", "2024-01-31", "3 months").orderBy("step").collect()]
    assert rows == ["2023-01-31", "2023-04-30", "2023-07-31", "2023-10-31", "2024-01-31"]
    assert temporal.regular_series(spark, "2020-02-29", "2024-02-29", "1 year").count() == 5


def test_csv_fields_with_line_breaks(spark, tmp_path):
    rows = [(1, 'a\nb "q", c'), (2, "plain"), (3, "\r\nx\n")]
    df = spark.createDataFrame(rows, "k long, t string")
    files.write_table(df.coalesce(1), str(tmp_path / "x.csv"))
    back = files.read_table(spark, str(tmp_path / "x.csv"), "k long, t string").orderBy("k").collect()
    assert len(back) == 3 and back[0].t == rows[0][1] and back[1].t == "plain"
    assert files.format_of("s3://b/x.csv.gz") == "csv"


def test_infinite_values_have_a_distance(spark):
    a = spark.createDataFrame([(float(x),) for x in [1, 2, 3, math.inf, -math.inf]], "v double")
    b = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5]], "v double")
    assert ecdf.two_sample_ks(a, b, ["v"]).first() is not None


def test_a_missing_key_is_a_group_of_its_own(spark):
    df = spark.createDataFrame([(None, "a")] * 6 + [("x", "a")] * 6 + [("y", "a")], "k string, v string")
    assert risk.suppress_small_groups(df, ["k"], 5).count() == 12


def test_places_that_are_not_listed(spark):
    df = spark.createDataFrame([(1, "Rome"), (2, "Oslo")], "k long, city string")
    places = {"city": spark.createDataFrame([("Rome", "South"), ("Rome", "South")], "place string, region string")}
    assert sorted(tuple(r) for r in knowledge.anonymize(df, places=places, unlisted="keep").collect()) == [(1, "South"), (2, "Oslo")]
    assert sorted(tuple(r) for r in knowledge.anonymize(df, places=places).collect()) == [(1, "South"), (2, None)]


def test_patterns_hold_from_the_start(spark):
    rule = knowledge.Constraint("v", "pattern", {"pattern": "^a|b", "null_out": True})
    df = spark.createDataFrame([("xb",), ("ax",), ("b",)], "v string")
    assert [r[0] for r in df.select(knowledge.constrain(F.col("v"), rule, F.lit(1))).collect()] == [None, "ax", "b"]
    with pytest.raises(ValueError):
        knowledge.constrain(F.col("v"), knowledge.Constraint("v", "no such kind", {}), F.lit(1))


def test_layout_changes_no_row(spark):
    real = spark.createDataFrame([(0, "a")], "row_id long, label string")
    many = spark.range(600).selectExpr("id AS row_id", "if(id % 2 = 0, 'a', 'b') AS label")
    rows = [sorted(r.row_id for r in blend(real, many.repartition(n), "label", {"a": 0.5, "b": 0.1}).filter("origin = 'fabricated'").collect()) for n in (1, 5)]
    assert rows[0] == rows[1] and 100 < len(rows[0]) < 260

    def source(first, count):
        return [f"{i + 1}. text {first + i}" for i in range(count - 3)]

    texts = [{r.row_id: r.t for r in text.with_text_source(many.repartition(n), "t", source, 7).collect()} for n in (1, 3)]
    assert texts[0] == texts[1] and texts[0][25] == "text 25" and len(texts[0][28]) > 0


def test_each_round_draws_its_own_filler(spark):
    df = spark.createDataFrame([(i, "One. Two.") for i in range(5)], "row_id long, c string")
    long = [r[0] for r in df.select(text.lengthen(F.col("c"), F.lit(900), F.col("row_id"), 1, "n")).collect()]
    assert {len(x) for x in long} == {900}
    parts = long[0].split(" One.")
    assert parts[1:9] != parts[9:17]


def test_short_and_long_lists_draw_alike(spark, monkeypatch):
    from twintable.functions.draw import Draws
    from twintable.plans.fabricate import categorical

    seen = spark.range(900).selectExpr("concat('v', id % 40) AS c")
    rows = spark.range(300).withColumnRenamed("id", "row_id")
    short = rows.select("row_id", categorical.by_frequency(categorical.category_counts(seen, ["c"])["c"], Draws(3, "c", F.col("row_id"))(0)).alias("c"))
    long = categorical.add_long_category(rows, seen, "c", 3)
    assert {r.row_id: r.c for r in short.collect()} == {r.row_id: r.c for r in long.select("row_id", "c").collect()}
    pairs = spark.createDataFrame([("IN", f"city{i}") for i in range(30)], "country string, city string")
    home = rows.withColumn("country", F.lit("IN"))
    few = categorical.add_city(home, "country", pairs, Draws(3, "x", F.col("row_id"))(0), "city", F.lit("?"))
    expected = {r.row_id: r.city for r in few.collect()}
    monkeypatch.setattr(categorical, "SMALL_LOOKUP", 5)
    many = categorical.add_city(home, "country", pairs, Draws(3, "x", F.col("row_id"))(0), "city", F.lit("?"))
    assert {r.row_id: r.city for r in many.collect()} == expected


def test_correlations_match_pandas(spark):
    import pandas as pd

    from twintable.operators.aggregates import correlation_pairs

    rng = np.random.default_rng(8)
    a = rng.normal(1e7, 3, 500)
    frame = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(0, 2, 500), "c": 0.1, "d.e": rng.normal(0, 1e-3, 500), "f": np.nan})
    frame.loc[::3, "b"] = np.nan
    frame.loc[1::4, "d.e"] = np.nan
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double, `d.e` double, f double").repartition(3)
    got = {(r.column_a, r.column_b): r["corr"] for r in correlation_pairs(df, list(frame)).collect()}
    expected = frame.astype(float).corr()
    assert len(got) == 25
    for (x, y), r in got.items():
        e = expected.loc[x, y]
        assert r is None if np.isnan(e) else r == pytest.approx(e, abs=1e-9)
    assert correlation_pairs(df.limit(0), ["a"]).collect() == []


def test_a_text_order_is_cut_into_buckets(spark):
    from twintable.operators import fill

    rows = [(f"k{i:05d}", i if i % 7 == 0 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(4)
    cut = fill._cut(df, ["k"], 500)
    assert cut.select("_bucket").distinct().count() > 2
    got = {r.k: r.v for r in fill._fill(df, ["v"], ["k"], None, False, 500).collect()}
    assert got == {k: int(k[1:]) // 7 * 7 for k, _ in rows}


def test_any_order_is_cut_into_even_ranges(spark):
    """Texts with a long common start, rows without a position, equal positions, and several columns as order."""
    from twintable.operators import fill

    n = 6000
    url = lambda i: None if i % 3 == 0 else f"https://example.org/a/very/long/common/start/{i:06d}"
    rows = [(url(i), i, "same", i if i % 5 == 0 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "u string, i int, w string, v long").repartition(5)
    for order in (["u", "i"], ["u"], ["w"], ["w", "u", "i"]):
        sizes = [r["count"] for r in fill._cut(df, order, 500).groupBy("_bucket").count().collect()]
        assert sum(sizes) == n and len(sizes) >= 10 and max(sizes) < 3 * 500
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    want, last = {}, None
    for _, i, _, v in ordered:
        last = v if v is not None else last
        want[i] = last
    assert {r.i: r.v for r in fill.fill_forward(df, ["v"], ["u", "i"], None, 500).collect()} == want
    assert fill.fill_forward(df.limit(0), ["v"], ["u"]).collect() == []


def test_names_with_dots(spark):
    from twintable.operators import sets
    from twintable.operators.aggregates import deterministic_mode

    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", "x")], "`k.1` string, `v.2` string")
    pairs = df.filter("`k.1` IN ('a', 'b')").withColumn("v.2", F.lit("x"))
    assert [tuple(r) for r in sets.invalid_pairs(df, pairs, "k.1", "v.2").collect()] == [("b", "y")]
    assert [r[0] for r in sets.unexpected_values(df, "k.1", pairs).collect()] == ["c"]
    assert {r[0] for r in sets.vocabulary(df, "v.2").select("token").collect()} == {"x", "y"}
    assert deterministic_mode(df, "v.2").first()["mode"] == "x"
    assert {tuple(r)[:2] for r in deterministic_mode(df, "v.2", ["k.1"]).collect()} == {("a", "x"), ("b", "y"), ("c", "x")}
