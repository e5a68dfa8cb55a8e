"""Times of day of fabricated moments."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from twintable.plans.fabricate import temporal
from twintable.plans.fabricate.table import Options, fabricate

MONDAY = datetime(2024, 1, 1)


def shop(days=56):
    """Weekdays at nine (most) or at 17:30:15, weekends at noon."""
    out = []
    for i in range(days):
        day = MONDAY + timedelta(days=i)
        if day.weekday() >= 5:
            out += [day + timedelta(hours=12)] * 4
        else:
            out += [day + timedelta(hours=9)] * 9 + [day + timedelta(hours=17, minutes=30, seconds=15)]
    return out


@pytest.fixture
def source(spark):
    return spark.createDataFrame([(t, i) for i, t in enumerate(shop())], "ts timestamp, k long")


def test_times_follow_their_weekday(spark, source):
    low, high = source.agg(F.min("ts"), F.max("ts")).first()
    rows = spark.range(4000).select(F.col("id").alias("row_id"), F.lit("own").alias("weekday"))
    got = temporal.add_timed_dates(rows, "at", source, "ts", low, high, 3)
    assert got.columns == ["row_id", "weekday", "at"]
    found = got.collect()
    assert len(found) == 4000 and {r.weekday for r in found} == {"own"}
    assert {r.at.hour for r in found if r.at.weekday() >= 5} == {12}
    work = Counter(str(r.at.time()) for r in found if r.at.weekday() < 5)
    assert set(work) == {"09:00:00", "17:30:15"}
    assert work["17:30:15"] / sum(work.values()) == pytest.approx(0.1, abs=0.02)
    assert {r.at.date() for r in found} >= {low.date(), high.date()}
    again = temporal.add_timed_dates(rows.repartition(7), "at", source, "ts", low, high, 3)
    assert sorted(again.collect()) == sorted(found)


def test_unknown_weekdays_missing_days_and_no_counts(spark, source):
    mondays = temporal.clock_counts(source.filter(F.weekday("ts") == 0), "ts")
    rows = spark.createDataFrame([(1, MONDAY + timedelta(days=2)), (2, None)], "row_id long, at timestamp")
    got = {r.row_id: r.at for r in temporal.add_clock(rows, "at", mondays, F.lit(0.95)).collect()}
    assert got == {1: MONDAY + timedelta(days=2, hours=17, minutes=30, seconds=15), 2: None}
    none = temporal.clock_counts(source.filter("k < 0"), "ts")
    assert temporal.add_clock(rows, "at", none, F.lit(0.5)).collect() == rows.collect()


def test_moments_stay_in_the_range(spark):
    df = spark.createDataFrame([(MONDAY + timedelta(hours=h),) for h in (20, 27, 40)], "ts timestamp")
    low, high = df.agg(F.min("ts"), F.max("ts")).first()
    rows = spark.range(300).select(F.col("id").alias("row_id"))
    for calendar in (True, False):
        got = temporal.add_timed_dates(rows, "at", df, "ts", low, high, 1, keep_calendar=calendar)
        assert got.filter((F.col("at") < F.lit(low)) | (F.col("at") > F.lit(high)) | F.col("at").isNull()).isEmpty()


def test_whole_tables_keep_the_clock_unless_told(source):
    times = lambda o: {str(r.ts.time()) for r in fabricate(source, 400, o).collect()}
    assert times(Options(seed=2)) == {"09:00:00", "17:30:15", "12:00:00"}
    assert times(Options(seed=2, keep_clock=False)) == {"09:00:00"}
