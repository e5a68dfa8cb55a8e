"""Kolmogorov-Smirnov distances when open buckets have to be cut again, round by round."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twintable.operators import ecdf

from tests.test_operators import brute_ks


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(ecdf, "ROWS_PER_BUCKET", 25)
    monkeypatch.setattr(ecdf, "MIN_BUCKETS", 2)
    monkeypatch.setattr(ecdf, "MAX_BUCKETS", 2)
    monkeypatch.setattr(ecdf, "CUTS", 4)


def watched(monkeypatch):
    """Keeps what ``_narrowed_down`` hands on."""
    seen, plain = [], ecdf._narrowed_down

    def keep(*args):
        out = plain(*args)
        seen.append(out[1])
        return out

    monkeypatch.setattr(ecdf, "_narrowed_down", keep)
    return seen


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_two_samples_are_exact_in_several_rounds(spark, tiny, monkeypatch, broadcast):
    monkeypatch.setattr(ecdf, "BROADCAST_BUCKETS", broadcast)
    seen = watched(monkeypatch)
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(0, 1, 900), np.full(600, 0.25), [math.inf, -math.inf, math.nan]])
    b = np.concatenate([rng.normal(0.02, 1, 900), np.full(580, 0.25), [math.inf, 9.0]])
    ref, syn = (spark.createDataFrame([(float(x), 1.0) for x in v], "x double, c double") for v in (a, b))
    got = {r["column"]: r["ks"] for r in ecdf.two_sample_ks(ref, syn, ["x", "c"]).collect()}
    assert got["x"] == pytest.approx(brute_ks(a, b), abs=1e-12) and got["c"] == 0.0
    (found,) = seen
    assert len(found) > 2  # more than one further round
    for rows, todo in found:
        largest = rows.join(todo.select("column", "bucket"), ["column", "bucket"]).groupBy("column", "bucket").count()
        assert (largest.agg(F.max("count")).first()[0] or 0) <= 25


def test_one_sample_is_exact_in_several_rounds(spark, tiny):
    rng = np.random.default_rng(6)
    x = np.sort(np.concatenate([rng.exponential(2.0, 700), np.full(200, 1.5)]))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    params = spark.createDataFrame([("x", 2.0, 9.0)], "column string, m double, top double")
    cdfs = {"expo": 1 - F.exp(-F.col("value") / F.col("m")), "flat": F.least(F.col("value") / F.col("top"), F.lit(1.0))}
    models = {"expo": 1 - np.exp(-x / 2.0), "flat": np.minimum(x / 9.0, 1.0)}
    got = {r["family"]: r["ks"] for r in ecdf.one_sample_ks(df, ["x"], params, cdfs).collect()}
    n = len(x)
    for k, f in models.items():
        want = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
        assert got[k] == pytest.approx(want, abs=1e-12), k


def test_empty_sides_give_no_row(spark, tiny):
    some = spark.createDataFrame([(1.0,)], "v double")
    assert ecdf.two_sample_ks(some, some.filter("v > 1"), ["v"]).collect() == []
