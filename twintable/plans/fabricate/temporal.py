"""Date columns: uniform in a range, or with the weekday and month shares of a reference, and its times of day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twintable.functions import dates
from twintable.functions.draw import Draws, pick_from, pick_weighted
from twintable.session import durable

DEFAULT_DAYS = 730
#: Stands for all weekdays together in the counts of times of day.
ANY_WEEKDAY = -1


def span_days(low: datetime, high: datetime) -> int:
    return (high - low).days


def uniform_dates(low: datetime, days: int, u: Column) -> Column:
    """low + whole days below ``days``; the low end itself when the range is empty."""
    start = dates.moment(low)
    return dates.add_days(start, F.floor(u * F.lit(float(max(days, 1)))))


def default_range(now: datetime | None = None) -> tuple[datetime, datetime]:
    high = now or datetime.now()
    return high - timedelta(days=DEFAULT_DAYS), high


def calendar_counts(df: DataFrame, column: str) -> tuple[list, list]:
    """Weekday (0 = Monday) and month counts, at most 7 and 12 pairs."""
    c = F.col(f"`{column}`")
    rows = (
        df.filter(c.isNotNull())
        .select(F.inline(F.array(
            F.struct(F.lit("w").alias("part"), F.weekday(c).alias("slot")),
            F.struct(F.lit("m").alias("part"), F.month(c).alias("slot")),
        )))
        .groupBy("part", "slot").agg(F.count("*").alias("n")).collect()
    )
    pick = lambda p: sorted((r["slot"], r["n"]) for r in rows if r["part"] == p)
    return pick("w"), pick("m")


def calendar_cells(spark: SparkSession, low: datetime, days: int) -> DataFrame:
    """(weekday, month, offsets): day offsets inside the range for each of the 84 cells.

    A cell without any day in the range offers all days of its weekday, and a weekday without
    any day offers the whole range. Its size is bounded by the days of the calendar range.
    """
    day = dates.add_days(dates.moment(low), F.col("offset"))
    all_days = spark.range(max(days, 1)).select(F.col("id").cast("int").alias("offset")).select(
        "offset", F.weekday(day).alias("weekday"), F.month(day).alias("month")
    )
    exact = all_days.groupBy("weekday", "month").agg(
        F.array_sort(F.collect_list("offset")).alias("exact")
    )
    by_weekday = all_days.groupBy("weekday").agg(
        F.array_sort(F.collect_list("offset")).alias("any_month")
    )
    grid = spark.range(84).select(
        (F.col("id") % 7).cast("int").alias("weekday"), (F.floor(F.col("id") / 7) + 1).cast("int").alias("month")
    )
    return (
        grid.join(F.broadcast(exact), ["weekday", "month"], "left")
        .join(F.broadcast(by_weekday), "weekday", "left")
        .select(
            "weekday", "month",
            F.coalesce("exact", "any_month", F.sequence(F.lit(0), F.lit(max(days, 1) - 1)))
            .alias("offsets"),
        )
    )


def add_patterned_dates(
    rows: DataFrame, name: str, low: datetime, days: int, weekdays: Sequence, months: Sequence,
    seed: int, method: str = "md5",
) -> DataFrame:
    """Adds a date column with the given weekday and month counts: no rejection, no shuffle.

    Weekday and month are drawn first, then a day of that cell by index.
    """
    draws = Draws(seed, name, F.col("row_id"), method)
    drawn = rows.withColumns({
        "_w": pick_weighted([w for w, _ in weekdays], [n for _, n in weekdays], draws(0)),
        "_m": pick_weighted([m for m, _ in months], [n for _, n in months], draws(1)),
    })
    cells = calendar_cells(rows.sparkSession, low, days).select(
        F.col("weekday").alias("_w"), F.col("month").alias("_m"), "offsets"
    )
    # 84 rows that list each day of the range a few times
    joined = drawn.join(F.broadcast(cells), ["_w", "_m"], "left")
    start = dates.moment(low)
    return joined.withColumn(
        name, dates.add_days(start, pick_from(F.col("offsets"), draws(2)))
    ).drop("_w", "_m", "offsets")


def second_of_day(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c).cast("int")


def has_clock(df: DataFrame, column: str) -> bool:
    """True if the values differ in their time of day, whole seconds taken."""
    at = second_of_day(F.col(f"`{column}`").cast("timestamp"))
    found = df.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    return found["low"] != found["high"]


def clock_counts(df: DataFrame, column: str) -> DataFrame:
    """(weekday, second, n): values by weekday (0 = Monday) and second of the day; ``ANY_WEEKDAY`` sums them up.

    One scan, and at most 8 x 86,400 rows whatever the table's size.
    """
    c = F.col(f"`{column}`")
    by_day = durable(df.filter(c.isNotNull()).groupBy(
        F.weekday(c).alias("weekday"), second_of_day(c).alias("second")
    ).agg(F.count("*").alias("n")))
    every = by_day.groupBy("second").agg(F.sum("n").alias("n"))
    return by_day.union(every.select(F.lit(ANY_WEEKDAY).alias("weekday"), "second", "n"))


def add_clock(rows: DataFrame, name: str, counts: DataFrame, u: Column) -> DataFrame:
    """Gives the days of a column a time of day, drawn by the counts of their weekday.

    A weekday without counts draws from all of them; without any the days stay as they are. The running
    count of a weekday is cut into about as many cells of equal weight as it has seconds, so the join
    has no hot key.
    """
    sizes = {r["weekday"]: r for r in counts.groupBy("weekday").agg(
        F.sum("n").alias("total"), F.count("*").alias("seconds")).collect()}
    if not sizes:
        return rows

    def by_weekday(key: Column, values: dict[int, int]) -> Column:
        out = F.lit(None).cast("long")
        for d, v in values.items():
            out = F.when(key == d, F.lit(v).cast("long")).otherwise(out)
        return out

    totals = {d: r["total"] for d, r in sizes.items()}
    widths = {d: -(-r["total"] // r["seconds"]) for d, r in sizes.items()}
    width = by_weekday(F.col("weekday"), widths)
    # at most 86,400 rows a window
    upto = F.sum("n").over(Window.partitionBy("weekday").orderBy("second").rowsBetween(Window.unboundedPreceding, 0))
    spans = counts.withColumn("span_hi", upto).withColumn("span_lo", F.col("span_hi") - F.col("n")).select(
        "weekday", "second", "span_lo", "span_hi",
        F.explode(F.sequence(F.floor(F.col("span_lo") / width), F.floor((F.col("span_hi") - 1) / width))).alias("cell"),
    ).select(*[F.col(c).alias(f"_{c}") for c in ("weekday", "second", "span_lo", "span_hi", "cell")])
    day = F.col(f"`{name}`")
    known = [d for d in sizes if d != ANY_WEEKDAY]
    marked = rows.withColumn("_day", F.when(F.weekday(day).isin(known), F.weekday(day)).otherwise(F.lit(ANY_WEEKDAY)))
    marked = marked.withColumn("_target", F.floor(u * by_weekday(F.col("_day"), totals).cast("double")).cast("long"))
    marked = marked.withColumn("_at", F.floor(F.col("_target") / by_weekday(F.col("_day"), widths)))
    # each weekday has as many cells as seconds, and a second lists one more at most than it fills: 16 x 86,400 rows
    joined = marked.join(
        F.broadcast(spans),
        (F.col("_day") == F.col("_weekday")) & (F.col("_at") == F.col("_cell"))
        & (F.col("_target") >= F.col("_span_lo")) & (F.col("_target") < F.col("_span_hi")), "left",
    )
    timed = day.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_second"))
    return joined.withColumn("_timed", timed).select(
        *[F.col("_timed").alias(c) if c == name else F.col(f"`{c}`") for c in rows.columns]
    )


def add_timed_dates(
    rows: DataFrame, name: str, reference: DataFrame, column: str, low: datetime, high: datetime,
    seed: int, method: str = "md5", keep_calendar: bool = True,
) -> DataFrame:
    """Adds moments from low to high: a day as in the other date columns, then a time of day of its weekday.

    All calendar days that the range touches can be drawn; a time beyond an end of the range becomes that end.
    """
    draws = Draws(seed, name, F.col("row_id"), method)
    first = low.replace(hour=0, minute=0, second=0, microsecond=0)
    days = (high.date() - low.date()).days + 1
    if keep_calendar:
        weekdays, months = calendar_counts(reference, column)
        rows = add_patterned_dates(rows, name, first, days, weekdays, months, seed, method)
    else:
        rows = rows.withColumn(name, uniform_dates(first, days, draws(0)))
    rows = add_clock(rows, name, clock_counts(reference, column), draws(3))
    timed = F.greatest(F.least(F.col(f"`{name}`"), dates.moment(high)), dates.moment(low))
    return rows.withColumn(name, F.when(F.col(f"`{name}`").isNotNull(), timed))


def finish(c: Column, business_days: bool = False, layout: str | None = None) -> Column:
    """Business-day shift and output layout."""
    out = dates.to_business_day(c) if business_days else c
    return F.date_format(out, dates.OUTPUT_PATTERNS[layout]) if layout else out


def regular_series(
    spark: SparkSession, start: str, end: str, interval: str = "1 day", partitions: int | None = None
) -> DataFrame:
    """(step, ts): every point from start to end in equal intervals, spread over partitions."""
    lo, hi = dates.moment(start), dates.moment(end)
    count, unit = int(interval.split()[0]), interval.split()[1].lower().rstrip("s")
    months = count * {"month": 1, "quarter": 3, "year": 12}.get(unit, 0)
    if months:  # calendar steps from the start, so that the 31st does not wander
        last = spark.range(1).select(F.floor(F.months_between(hi, lo) / months).alias("n")).first()["n"]
        step = F.make_ym_interval(F.lit(0), (F.col("id") * months).cast("int"))
        return spark.range(0, last + 2, 1, partitions).select(
            F.col("id").alias("step"), (lo + step).alias("ts")
        ).filter(F.col("ts") <= hi)
    one = spark.range(1).select(
        F.unix_micros(lo).alias("a"), F.unix_micros(hi).alias("b"),
        F.unix_micros(lo + F.expr(f"INTERVAL '{interval.split()[0]}' {interval.split()[1]}")).alias("c"),
    ).first()
    width = one["c"] - one["a"]
    n = (one["b"] - one["a"]) // width + 1
    return spark.range(0, n, 1, partitions).select(
        F.col("id").alias("step"),
        F.timestamp_micros(F.lit(one["a"]) + F.col("id") * F.lit(width)).alias("ts"),
    )


def seasonal_dates(
    name: str, year_start: datetime, month_weights: Sequence[int], row_id: Column, seed: int,
    method: str = "md5",
) -> Column:
    """Dates in one year whose months follow twelve weights; days within a month are uniform."""
    draws = Draws(seed, name, row_id, method)
    month = pick_weighted(list(range(12)), list(month_weights), draws(0))
    first = F.add_months(dates.moment(year_start).cast("date"), month)
    days = F.dayofmonth(F.last_day(first))
    return F.date_add(first, F.floor(draws(1) * days).cast("int"))
