"""Operators against brute force, with missing values and hot values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twintable.functions import dates
from twintable.functions import numbers as num
from twintable.functions.draw import Draws, gamma, uniform
from twintable.operators import aggregates, columns, ecdf, fill, frequency, prefix, quantiles

RNG = np.random.default_rng(5)


def skewed(n=3000):
    """A third of all values are equal; some are missing."""
    x = RNG.normal(50, 20, n).round(2)
    x[: n // 3] = 42.0
    x[-20:] = np.nan
    return x


@pytest.mark.parametrize("limit", [1_000_000, 300, 5])
def test_quantiles_match_numpy_whatever_the_path(spark, limit):
    x, y = skewed(), RNG.exponential(3, 3000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.quantile_values(df, ["x", "y"], probs, limit)
    assert np.allclose(got["x"], np.quantile(x[~np.isnan(x)], probs))
    assert np.allclose(got["y"], np.quantile(y, probs))


def test_many_quantiles_take_one_sort(spark, monkeypatch):
    """Hundreds of quantiles of many distinct values are hundreds of ranks, not hundreds of aggregates."""
    x = np.append(RNG.normal(0, 1, 20_000), np.full(5_000, 0.5))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "k": np.arange(len(x)) % 7.0})).repartition(4)
    probs = [i / 256 for i in range(257)]
    asked, percentile = [], F.percentile
    monkeypatch.setattr(F, "percentile", lambda *a: asked.append(a) or percentile(*a))
    got = quantiles.quantile_values(df, ["x", "k"], probs, 10_000)
    assert len(asked) == 1  # of the few values
    assert np.allclose(got["x"], np.quantile(x, probs), atol=1e-12)
    assert np.allclose(got["k"], np.quantile(np.arange(len(x)) % 7.0, probs))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles.quantile_values(df, ["x"], [0.5]) == {"x": [None]}


def brute_ks(a, b):
    a, b = a[~np.isnan(a)], b[~np.isnan(b)]
    grid = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid, "right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, "right") / len(b)
    return np.abs(fa - fb).max()


def test_two_sample_ks_is_exact(spark, monkeypatch):
    a, b = skewed(), np.append(skewed(2500), RNG.normal(60, 5, 500))
    ref = spark.createDataFrame(pd.DataFrame({"x": a, "c": np.full(len(a), 1.0)}))
    syn = spark.createDataFrame(pd.DataFrame({"x": b, "c": np.full(len(b), 2.0)}))
    for rows_per_bucket in (200_000, 30):
        monkeypatch.setattr(ecdf, "ROWS_PER_BUCKET", rows_per_bucket)
        got = {r["column"]: r for r in ecdf.two_sample_ks(ref, syn, ["x", "c"]).collect()}
        assert got["x"]["ks"] == pytest.approx(brute_ks(a, b), abs=1e-12)
        assert got["c"]["ks"] == 1.0
        assert got["x"]["n_ref"] == np.isfinite(a).sum()


def test_one_sample_ks_with_and_without_pruning(spark, monkeypatch):
    x = np.sort(RNG.exponential(2.0, 2000))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    params = spark.createDataFrame([("x", 2.0, 3.0, 0.7)], "column string, m double, shape double, scale double")
    cdfs = {
        "expo": 1 - F.exp(-F.col("value") / F.col("m")),
        "gamma": num.gamma_cdf(F.col("value"), F.col("shape"), F.col("scale")),
    }
    z = x / 0.7
    models = {"expo": 1 - np.exp(-x / 2.0), "gamma": 1 - np.exp(-z) * (1 + z + z * z / 2)}
    n = len(x)
    for rows_per_bucket in (200_000, 20):
        monkeypatch.setattr(ecdf, "ROWS_PER_BUCKET", rows_per_bucket)
        got = {r["family"]: r["ks"] for r in ecdf.one_sample_ks(df, ["x"], params, cdfs).collect()}
        for k, f in models.items():
            want = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
            assert got[k] == pytest.approx(want, abs=1e-9), k


def test_normal_cdf_matches_erf(spark):
    xs = np.linspace(-9, 9, 181)
    df = spark.createDataFrame(pd.DataFrame({"x": xs})).select(num.normal_cdf(F.col("x")).alias("p"))
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs]
    assert np.allclose([r["p"] for r in df.collect()], want, atol=1e-14)


@pytest.mark.parametrize("keys", [None, ["k"]])
@pytest.mark.parametrize("rows_per_bucket", [10_000, 40])
def test_fills_match_pandas(spark, keys, rows_per_bucket):
    n = 600
    frame = pd.DataFrame({
        "t": RNG.permutation(n), "k": np.where(np.arange(n) % 3 == 0, "hot", (np.arange(n) % 7).astype(str)),
        "v": np.where(RNG.random(n) < 0.6, np.nan, RNG.random(n)),
        "s": [None if RNG.random() < 0.5 else f"s{i}" for i in range(n)],
    })
    df = spark.createDataFrame(frame)
    ordered = frame.sort_values("t").set_index("t")
    for function, how in ((fill.fill_forward, "ffill"), (fill.fill_backward, "bfill")):
        got = function(df, ["v", "s"], ["t"], keys, rows_per_bucket).toPandas().sort_values("t").set_index("t")
        source = ordered.groupby("k")[["v", "s"]] if keys else ordered[["v", "s"]]
        want = getattr(source, how)()
        assert np.array_equal(got["v"].to_numpy(), want["v"].to_numpy(), equal_nan=True)
        assert [x if isinstance(x, str) else None for x in got["s"]] == [
            x if isinstance(x, str) else None for x in want["s"]]


def test_fill_splits_a_hot_moment_along_the_second_order_column(spark):
    n = 900
    frame = pd.DataFrame({
        "t": np.where(np.arange(n) % 3 == 0, 50, np.arange(n) % 100), "i": RNG.permutation(n),
        "v": np.where(RNG.random(n) < 0.7, np.nan, RNG.random(n)),
    })
    df = spark.createDataFrame(frame)
    cut = fill._cut(df, ["t", "i"], 40)
    assert cut.filter("t = 50").select("_bucket").distinct().count() > 5
    ordered = frame.sort_values(["t", "i"]).set_index("i")["v"]
    for function, want in ((fill.fill_forward, ordered.ffill()), (fill.fill_backward, ordered.bfill())):
        got = function(df, ["v"], ["t", "i"], None, 40).toPandas().set_index("i")["v"]
        assert np.array_equal(got.loc[want.index].to_numpy(), want.to_numpy(), equal_nan=True)


def test_wide_tables_take_several_scans(spark, monkeypatch):
    monkeypatch.setattr(columns, "COLUMNS_PER_SCAN", 3)
    df = spark.range(50).select(*[(F.col("id") * k).alias(f"c{k}") for k in range(8)])
    got = {r["column"]: r["mean"] for r in aggregates.moments(df, df.columns).collect()}
    assert got == {f"c{k}": 24.5 * k for k in range(8)}
    pairs = aggregates.correlation_pairs(df, ["c1", "c2", "c3"]).collect()
    assert len(pairs) == 9 and all(r["corr"] == pytest.approx(1.0) for r in pairs)


def test_draws_do_not_depend_on_partitions(spark):
    for method in ("md5", "xxhash64"):
        one = spark.range(0, 500, 1, 1).select("id", uniform(3, "c", F.col("id"), 0, method).alias("u"))
        many = spark.range(0, 500, 1, 8).select("id", uniform(3, "c", F.col("id"), 0, method).alias("u"))
        a, b = ({r["id"]: r["u"] for r in d.collect()} for d in (one, many))
        assert a == b
        values = np.array(list(a.values()))
        assert 0 <= values.min() and values.max() < 1 and abs(values.mean() - 0.5) < 0.05


def test_gamma_draws_have_the_right_moments(spark):
    for shape in (0.5, 4.0):
        df = spark.range(4000).select(gamma(Draws(1, "g", F.col("id"), "xxhash64"), shape, 2.0).alias("g"))
        mean, var = df.agg(F.avg("g"), F.var_pop("g")).first()
        assert mean == pytest.approx(shape * 2, rel=0.08)
        assert var == pytest.approx(shape * 4, rel=0.2)


def test_running_span_covers_everything_once(spark):
    frame = pd.DataFrame({"v": [f"v{i}" for i in range(200)], "n": RNG.integers(1, 50, 200)})
    frame.loc[0, "n"] = 5000
    spans = prefix.running_span(spark.createDataFrame(frame), "n", "v").toPandas().sort_values("span_lo")
    assert spans["span_lo"].iloc[0] == 0
    assert (spans["span_hi"].to_numpy()[:-1] == spans["span_lo"].to_numpy()[1:]).all()
    assert spans["span_hi"].iloc[-1] == frame["n"].sum()
    drawn = prefix.pick_by_span(
        spark.range(3000).withColumnRenamed("id", "row_id"), uniform(1, "p", F.col("row_id")),
        spark.createDataFrame(frame), "v", "n", "picked",
    )
    assert drawn.count() == 3000
    hot = drawn.filter("picked = 'v0'").count() / 3000
    assert hot == pytest.approx(5000 / frame["n"].sum(), abs=0.05)


def test_long_values_are_counted_exactly(spark):
    rows = [("x" * 100,), ("x" * 100,), ("x" * 101,), ("short",), (None,)]
    freq = frequency.value_frequencies(spark.createDataFrame(rows, "t string"), ["t"], keys=True)
    assert sorted(r["n"] for r in freq.collect()) == [1, 1, 2]


def test_numbers_as_text(spark):
    rows = [(0.0,), (-0.0,), (12345678.25,), (1e9,), (0.5,), (None,)]
    freq = frequency.value_frequencies(spark.createDataFrame(rows, "x double"), ["x"])
    assert {r["value"]: r["n"] for r in freq.collect()} == {
        "0.0": 2, "12345678.25": 1, "1000000000.0": 1, "0.5": 1}


def test_name_tokens_keep_word_boundaries():
    assert columns.has_token("record_id", "id") and columns.has_token("Respondent_ID", "id")
    assert columns.has_token("userID", "id") and columns.has_token("Sl No", "sl no")
    assert columns.has_token("slno", "sl no") and columns.has_token("Age", "age")
    assert not columns.has_token("paid", "id") and not columns.has_token("average", "age")


def test_moments_of_small_columns(spark):
    df = spark.createDataFrame([(1.0, 5), (float("nan"), 5), (None, 5)], "a double, b int")
    got = {r["column"]: r for r in aggregates.moments(df, ["a", "b"]).collect()}
    assert got["a"]["n"] == 1 and got["a"]["std"] is None and got["a"]["skewness"] is None
    assert got["b"]["skewness"] == 0.0 and got["b"]["std"] == 0.0
    nulls = {r["column"]: r["null_count"] for r in aggregates.null_counts(df).collect()}
    assert nulls == {"a": 2, "b": 0}


DATE_TEXTS = [
    "123-45-6789", "45-12-2020", "2023-1-5", "2023-01-05", "2023-1-0005", "2023-13-5", "31-12-2020", "12-31-2020", "0001-2-3", "31/12/2020",
    "12/31/2020", "2020/02/30", "2020/2/29", "20200229", "20201301", "12345678", "31.1.2020", "Jan 5, 2020", "January 5, 2020", "5 Sep 2020",
    "5 september 2020", "Foo 5, 2020", "1/2/2020 3:04:05 pm", "1/2/2020 3:04 PM", "1/2/2020 13:04 PM", "2020-1-2 3:4:5 am", "2020-1-2 3:04 AM",
    "2020-1-2 3:4:5", "2020-01-02T03:04:05Z", "00-1-2020", "0-0-0000", "1-1-0000", "2023-1-5\n", "99.99.9999", "5-05-2020",
]


def test_layouts_are_tried_on_texts_of_their_shape_only(spark):
    df = spark.createDataFrame([(t,) for t in DATE_TEXTS], "t string")
    layouts = dates.DATE_FORMATS + dates.OTHER_FORMATS
    tried = df.select("t", *[F.when(F.col("t").rlike(dates._OUTLINE), F.try_to_timestamp(
        F.upper("t") if f.endswith(" a") else F.col("t"), F.lit(f))).alias(f"p{i}") for i, f in enumerate(layouts)])
    # the parser for every layout gives the same
    plain = tried.select("t", F.coalesce(*[f"p{i}" for i in range(len(layouts))], F.when(
        F.col("t").rlike(dates._OUTLINE), F.try_to_timestamp("t"))).cast("string").alias("at"))
    assert df.select("t", dates.parse_date(F.col("t")).cast("string").alias("at")).collect() == plain.collect()
    assert sum(r["at"] is not None for r in plain.collect()) > 15
    shaped = df.filter("t = '123-45-6789'").select(*[F.col("t").rlike(dates.shape(f)) for f in layouts]).first()
    assert not any(shaped)


def test_numbers_are_those_that_the_cast_knows(spark):
    texts = ["1", " 1 ", "-1.5", "+.5", "1e5", "1E-5", "1e+5", "1d", "1f", "NaN", "inf", "-Infinity", "+inf", "0x1.8p1", "0x1p-2", "1 2", "555-012-0123",
             "\t7\n", "1_000", "user1@example.com", "", " ", "-", ".", "1.", "1-", "12-5", "\x007", "١", "nan", "INFINITY", "1\x7f", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select("t", num.text_to_number(F.col("t")).cast("string"), F.col("t").try_cast("double").cast("string")).collect()
    assert [r[1] for r in both] == [r[2] for r in both]
    assert sum(r[1] is not None for r in both) > 12
