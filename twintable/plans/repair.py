"""Cross-column repair of a table, and checks of fabricated columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twintable.functions import text
from twintable.functions.dates import moment
from twintable.functions.draw import Draws, pick_from
from twintable.functions.numbers import round_half_even, to_number
from twintable.operators.columns import find_column, has_token, is_numeric, rows_from_wide
from twintable.operators.sets import list_lookup, map_lookup
from twintable.operators.quantiles import quantile_values
from twintable.plans.fabricate import lookups

INTEGER_WORDS = ("age", "sl no", "serial", "record_id", "id")
COUNTER_WORDS = ("id", "serial", "sl no")


def repair_integers(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Id- and age-like columns become whole numbers; missing ones take the median.

    Counters with a value below 1 are renumbered from the row id.
    """
    wanted = [
        c for c in df.columns
        if c != row_id and has_token(c, *INTEGER_WORDS)
        and (is_numeric(df.schema[c].dataType) or isinstance(df.schema[c].dataType, T.StringType))
    ]
    if not wanted:
        return df
    numbers = df.select(*[to_number(F.col(f"`{c}`")).alias(c) for c in wanted])
    seen = numbers.agg(
        *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(wanted)],
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"z{i}") for i, c in enumerate(wanted)],
        *[F.min(F.rint(F.col(f"`{c}`"))).alias(f"lo{i}") for i, c in enumerate(wanted)],
    ).first()
    gaps = [c for i, c in enumerate(wanted) if seen[f"n{i}"] and seen[f"z{i}"]]
    medians = quantile_values(numbers, gaps, [0.5]) if gaps else {}
    changed = {}
    for i, c in enumerate(wanted):
        if not seen[f"n{i}"]:
            continue
        value = to_number(F.col(f"`{c}`"))
        low = seen[f"lo{i}"]
        if c in medians:
            median = medians[c][0]
            value = F.coalesce(value, F.lit(float(median)))
            low = min(low, round(median))
        if has_token(c, *COUNTER_WORDS) and low <= 0:
            changed[c] = F.col(row_id) + F.lit(1)
        else:
            changed[c] = round_half_even(value)
    return df.withColumns(changed) if changed else df


def repair_emails(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rebuild e-mails as first.last{n}@domain, keeping the domain."""
    first, last = find_column(df.columns, "first_name"), find_column(df.columns, "last_name")
    mail = find_column(df.columns, "email")
    if not (first and last and mail):
        return df
    local = F.concat(
        text.letters_only(F.col(f"`{first}`"), "user"), F.lit("."),
        text.letters_only(F.col(f"`{last}`"), "name"), (F.col(row_id) + 1).cast("string"),
    )
    domain = F.coalesce(text.email_domain(F.col(f"`{mail}`")), F.lit("test.com"))
    return df.withColumn(mail, F.concat(local, F.lit("@"), domain))


def repair_cities(
    df: DataFrame, seed: int = 42, row_id: str = "row_id",
    cities: Mapping[str, Sequence[str]] | None = None, method: str = "md5",
) -> DataFrame:
    """A city that is not listed for its (known) country is replaced by one that is."""
    country, city = find_column(df.columns, "country"), find_column(df.columns, "city")
    if not (country and city):
        return df
    table = dict(cities or lookups.normalized_country_cities())
    listed = list_lookup(table, lookups.normalize_country(F.col(f"`{country}`")))
    u = Draws(seed, f"{city}|repair", F.col(row_id), method)(0)
    wrong = listed.isNotNull() & ~F.coalesce(
        F.array_contains(listed, F.col(f"`{city}`")), F.lit(False)
    )
    return df.withColumn(city, F.when(wrong, pick_from(listed, u)).otherwise(F.col(f"`{city}`")))


def _full_name_column(columns: Sequence[str]) -> str | None:
    exact = [c for c in columns if c.lower() == "name"]
    return exact[0] if exact else find_column(columns, "full_name")


def repair_genders(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Gender follows the first name where that is listed under one gender only."""
    gender = find_column(df.columns, "gender")
    first, full = find_column(df.columns, "first_name"), _full_name_column(df.columns)
    if not gender or not (first or full):
        return df
    source = F.col(f"`{first}`") if first else F.get(text.words(F.col(f"`{full}`")), F.lit(0))
    known = map_lookup(names or lookups.gender_of_names(), F.lower(F.trim(source)))
    return df.withColumn(gender, F.coalesce(known, F.col(f"`{gender}`")))


def repair_surnames(
    df: DataFrame, seed: int = 42, row_id: str = "row_id",
    surnames: Mapping[str, Sequence[str]] | None = None, method: str = "md5",
) -> DataFrame:
    """Surnames usual in the row's city, in the last-name and the full-name column."""
    city = find_column(df.columns, "city")
    last, full = find_column(df.columns, "last_name"), _full_name_column(df.columns)
    if not city or not (last or full):
        return df
    pool = list_lookup(surnames or lookups.CITY_SURNAMES, F.lower(F.trim(F.col(f"`{city}`"))))
    chosen = pick_from(pool, Draws(seed, f"{city}|surname", F.col(row_id), method)(0))
    changed = {}
    if last:
        changed[last] = F.coalesce(chosen, F.col(f"`{last}`"))
    if full:
        name = F.col(f"`{full}`")
        w = text.words(name)
        first = find_column(df.columns, "first_name")
        renamed = F.array_join(
            F.concat(F.slice(w, F.lit(1), F.size(w) - 1), F.array(chosen)), " "
        )
        single = F.concat_ws(" ", F.trim(F.col(f"`{first}`")), chosen) if first else name
        changed[full] = (
            F.when(chosen.isNull(), name).when(F.size(w) >= 2, renamed).otherwise(single)
        )
    return df.withColumns(changed)


def repair(
    df: DataFrame, seed: int = 42, row_id: str = "row_id", method: str = "md5",
    integers: bool = True,
) -> DataFrame:
    """All repairs as expressions on one pass; e-mails last, when the names are settled.

    Only the integer repair looks at the data first; leave it out where columns are whole
    numbers by construction.
    """
    out = repair_integers(df, row_id) if integers else df
    out = repair_cities(out, seed, row_id, method=method)
    out = repair_surnames(out, seed, row_id, method=method)
    out = repair_genders(out)
    return repair_emails(out, row_id)


# ------------------------------------------------------------------- checks


def temporal_checks(
    df: DataFrame, ranges: Mapping[str, tuple], business_days: bool = False
) -> DataFrame:
    """(column, missing, before_range, after_range, weekend, valid) with a 10 per cent buffer."""
    aggs, structs = [], []
    for i, (name, (low, high)) in enumerate(ranges.items()):
        c = F.col(f"`{name}`").cast("timestamp")
        at, lo, hi = (F.unix_micros(x) for x in (c, moment(low), moment(high)))
        slack = (hi - lo) * 0.1
        aggs += [
            F.count_if(c.isNull()).alias(f"m{i}"), F.count_if(at < lo - slack).alias(f"b{i}"),
            F.count_if(at > hi + slack).alias(f"a{i}"), F.count_if(F.weekday(c) >= 5).alias(f"w{i}"),
        ]
        valid = F.col(f"m{i}") == 0
        if business_days:
            valid = valid & (F.col(f"w{i}") == 0)
        structs.append(F.struct(
            F.lit(name).alias("column"), F.col(f"m{i}").alias("missing"),
            F.col(f"b{i}").alias("before_range"), F.col(f"a{i}").alias("after_range"),
            F.col(f"w{i}").alias("weekend"), valid.alias("valid"),
        ))
    return rows_from_wide(df.agg(*aggs), structs)


def pipeline_rollup(checks: DataFrame) -> DataFrame:
    """(pipeline, checks, failed, valid) from rows of (pipeline, column, valid)."""
    return checks.groupBy("pipeline").agg(
        F.count("*").alias("checks"), F.count_if(~F.col("valid")).alias("failed"),
        F.bool_and("valid").alias("valid"),
    )


# ---------------------------------------------------------- derived columns


@dataclass(frozen=True)
class DerivedColumn:
    """``target`` computed from ``sources`` by a function of their columns."""

    target: str
    sources: Sequence[str]
    build: Callable[..., Column]


def apply_derived(df: DataFrame, rules: Sequence[DerivedColumn]) -> DataFrame:
    """Rules in dependency order; a rule with a missing source is skipped."""
    out, waiting = df, list(rules)
    produced = {r.target for r in rules}
    while waiting:
        pending = {r.target for r in waiting}
        ready = [r for r in waiting if not (set(r.sources) & (pending - {r.target}) & produced)]
        if not ready:
            raise ValueError(f"derived columns depend on each other: {sorted(pending)}")
        for rule in ready:
            if all(s in out.columns for s in rule.sources):
                out = out.withColumn(rule.target, rule.build(*[F.col(f"`{s}`") for s in rule.sources]))
            waiting.remove(rule)
    return out
