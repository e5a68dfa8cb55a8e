"""A whole look-alike table from a reference: profile, route, draw, repair, reorder.

The reference is reduced to a short description (a few numbers per column) by aggregates. The
fabricated rows are then one projection over ``spark.range``; only columns with very many
categories add a join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twintable.functions.dates import column_layouts, parse_date
from twintable.functions.draw import Draws, uniform
from twintable.functions.numbers import clip
from twintable.operators.columns import (
    atomic_columns, find_column, has_token, restore_order, small_copy,
)
from twintable.plans import infer, nested
from twintable.plans.fabricate import categorical, lookups, numeric, people, pools, temporal, text
from twintable.plans.repair import COUNTER_WORDS, repair
from twintable.sources.files import row_source


@dataclass(frozen=True)
class Options:
    """What a caller may change about a fabrication."""

    seed: int = 42
    hints: Mapping[str, str] = field(default_factory=dict)
    # column -> distribution, min, max, decimals, domains, style, categories
    overrides: Mapping[str, Mapping] = field(default_factory=dict)
    keep_nulls: bool = False
    keep_correlations: bool = False
    keep_calendar: bool = True
    # moments get a time of day as the source has it on that weekday
    keep_clock: bool = True
    business_days: bool = False
    match_lengths: bool = True
    enforce_range: bool = True
    # outliers of the reference: preserve, remove or clip
    outliers: str = "preserve"
    repair: bool = True
    locale: str = lookups.DEFAULT_LOCALE
    genders: Mapping[str, float] | None = None
    unique_columns: tuple[str, ...] = ()
    # column or data type -> own generator (column name, its metadata row, its draws) -> Column
    generators: Mapping[str, Callable[[str, Mapping, Draws], Column]] = field(default_factory=dict)
    # columns drawn from the user's own lists: the lists, and the column that names a row's list (None: one list)
    pools: Mapping[str, tuple[pools.Pools, str | None]] = field(default_factory=dict)
    partitions: int | None = None
    # "md5" can be replayed by other engines, "xxhash64" costs less per draw
    method: str = "md5"
    # draws from more than 256 categories: "spans" as from a short list, "alias" without hot cells
    long_lists: str = "spans"


def fabricate(reference: DataFrame, n: int, options: Options | None = None) -> DataFrame:
    """n look-alike rows of the reference, in its column order and types; nested columns by ``nested``."""
    o = options or Options()
    columns = atomic_columns(reference)
    deep = nested.nested_columns(reference)
    if not columns:
        rows = row_source(reference.sparkSession, n, o.partitions)
        return rows.select(*_nested_exprs(reference, deep, o))
    # the row number has its own name, so a column called row_id is no clash
    clash = {"row_id": "row_id__source"} if "row_id" in columns else {}
    source = reference.select(*[F.col(f"`{c}`").alias(clash.get(c, c)) for c in columns])
    columns = [clash.get(c, c) for c in columns]
    # wall-clock times, so that no driver time zone gets in between
    found = infer.analyze_schema(source, columns, o.hints).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("min_ts", "max_ts")}
    )
    meta = {r["column"]: r for r in found.collect()}
    kinds = {c: meta[c]["data_type"] for c in columns}

    rows = row_source(source.sparkSession, n, o.partitions)
    rows = rows.withColumns(_numeric_exprs(source, kinds, o))
    rows = _add_categories(rows, source, kinds, meta, o)
    rows = _add_dates(rows, source, kinds, meta, o)
    rows = rows.withColumns(_person_exprs(rows, source, kinds, o))
    texts = {c: meta[c]["avg_len"] if o.match_lengths else None for c, k in kinds.items() if k == "text"}
    templates = {c: o.overrides[c]["template"] for c in texts if "template" in o.overrides.get(c, {})}
    rows = text.add_texts(rows, o.seed, texts, templates, o.method)
    own = {c: o.generators.get(c) or o.generators.get(kinds[c]) for c in columns}
    rows = rows.withColumns({
        c: make(c, meta[c].asDict(), Draws(o.seed, c, F.col("row_id"), o.method))
        for c, make in own.items() if make
    })
    rows = rows.withColumns(
        {c: F.lit(None).cast(source.schema[c].dataType) for c in columns if c not in rows.columns}
    )
    for c, (lists, by) in o.pools.items():
        u = Draws(o.seed, c, F.col("row_id"), o.method)(0)
        rows = pools.draw_from_pools(rows, c, lists, u, F.col(f"`{by}`") if by else None)
    if o.repair:
        rows = repair(rows, o.seed, method=o.method, integers=False)
    for c in o.unique_columns:
        rows = people.make_unique(rows, c)
    rows = rows.withColumns({c: _typed(F.col(f"`{c}`"), source.schema[c].dataType) for c in columns})
    if o.keep_nulls:
        rows = rows.withColumns({
            c: F.when(
                Draws(o.seed, f"{c}|null", F.col("row_id"), o.method)(0)
                >= F.lit(float(meta[c]["null_pct"])), F.col(f"`{c}`")
            )
            for c in columns if meta[c]["null_pct"] > 0
        })
    ordered = _nested_exprs(reference, deep, o)
    rows = rows.select(*[F.col(f"`{c}`") for c in columns], *ordered) if deep else restore_order(rows, columns).drop("row_id")
    back = {v: k for k, v in clash.items()}
    rows = rows.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in rows.columns])
    return restore_order(rows, reference.columns) if deep else rows


def _nested_exprs(reference: DataFrame, names: list[str], o: Options) -> list[Column]:
    found = nested.fabricated_nested(reference, names, F.col("row_id"), o.seed, o.method, o.keep_nulls)
    own = {c: o.generators[c](c, {}, Draws(o.seed, c, F.col("row_id"), o.method)) for c in names if c in o.generators}
    return [c.alias(name) for name, c in {**found, **own}.items()]


def _typed(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        return c.try_cast(dtype)
    return c.cast(dtype)


def _numeric_exprs(source, kinds, o: Options) -> dict[str, Column]:
    names = [c for c, k in kinds.items() if k == "numeric"]
    if not names:
        return {}
    text_numbers = {c: F.col(f"`{c}`").try_cast("double") for c in names
                    if isinstance(source.schema[c].dataType, T.StringType)}
    numbers = source.withColumns(text_numbers) if text_numbers else source
    if o.outliers != "preserve":
        numbers = numeric.without_outliers(numbers, names, o.outliers)
    parameters = small_copy(numeric.fit_parameters(numbers, names))
    spread = {r["column"]: r.asDict() for r in parameters.collect()}
    whole = {
        c: infer.should_be_integer(c, source.schema[c].dataType, spread[c]["is_integer"])
        for c in names
    }
    # what counts on or was given a distribution needs no fit
    open_columns = [
        c for c in names
        if spread[c]["n"] and not (whole[c] and has_token(c, "id"))
        and "distribution" not in o.overrides.get(c, {})
    ]
    fits = dict(spread)
    if open_columns:
        best = numeric.best_fit(
            numbers, open_columns, parameters.filter(F.col("column").isin(open_columns))
        )
        fits |= {r["column"]: r.asDict() for r in best.collect()}
    row = F.col("row_id")
    mixed = (
        numeric.correlated_columns(numbers, names, row, o.seed, o.method)
        if o.keep_correlations and len(names) > 1 else {}
    )
    out = {}
    for c in names:
        p = fits[c] | {k: v for k, v in o.overrides.get(c, {}).items() if k in ("min", "max")}
        if not p["n"]:
            continue
        if whole[c] and has_token(c, *COUNTER_WORDS) and p["min"] <= 0:
            # counters start at one
            out[c] = row + F.lit(1)
            continue
        over = o.overrides.get(c, {})
        if c in mixed and not (whole[c] and has_token(c, "id")):
            value = clip(mixed[c], float(p["min"]), float(p["max"]))
            out[c] = F.rint(value).cast("long") if whole[c] else value
            continue
        family = over.get("distribution") or p.get("family", "uniform")
        out[c] = numeric.numeric_column(
            c, family, p, row, o.seed, whole[c], o.method, over.get("decimals"), o.enforce_range
        )
    return out


def _add_categories(rows, source, kinds, meta, o: Options) -> DataFrame:
    names = [c for c, k in kinds.items() if k in ("categorical", "boolean")]
    if not names:
        return rows
    counts = categorical.category_counts(
        source, names, {c: meta[c]["n_unique"] for c in names}
    )
    country, city = find_column(names, "country"), find_column(names, "city")
    row = F.col("row_id")
    exprs, long, later = {}, [], []
    for c in names:
        u = Draws(o.seed, c, row, o.method)(0)
        given = o.overrides.get(c, {}).get("categories")
        if given:
            weights = list(given.values()) if isinstance(given, Mapping) else [1] * len(given)
            exprs[c] = categorical.by_frequency(
                [(v, round(w * 1_000_000)) for v, w in zip(given, weights)], u
            )
        elif c == city and country and country != city:
            later.append(c)
        elif counts[c]:
            exprs[c] = categorical.by_frequency(counts[c], u)
        elif counts[c] is None:
            long.append(c)
        else:
            exprs[c] = categorical.by_name(c, u)
    rows = rows.withColumns(exprs)
    for c in long:
        rows = categorical.add_long_category(rows, source, c, o.seed, o.method, o.long_lists)
    for c in later:
        pairs = categorical.city_table(source, country, c, source.sparkSession)
        u = Draws(o.seed, c, row, o.method)(0)
        known = categorical.by_frequency(counts[c], u) if counts[c] else F.lit(None).cast("string")
        rows = categorical.add_city(rows, country, pairs, u, c, known)
    return rows


def _add_dates(rows, source, kinds, meta, o: Options) -> DataFrame:
    for c in [c for c, k in kinds.items() if k == "temporal"]:
        low, high = meta[c]["min_ts"], meta[c]["max_ts"]
        if low is None:
            low, high = temporal.default_range()
        over = o.overrides.get(c, {})
        low, high = over.get("min", low), over.get("max", high)
        days = temporal.span_days(low, high)
        is_text = isinstance(source.schema[c].dataType, T.StringType)
        known = meta[c]["min_ts"] is not None and days > 0
        dated = source
        if is_text and known and o.keep_calendar:
            chosen = column_layouts(source, [c])[c]
            dated = source.select(parse_date(F.col(f"`{c}`"), chosen).alias(c))
        # texts are shown by day, and dates have no time of day
        timed = known and o.keep_clock and isinstance(source.schema[c].dataType, (T.TimestampType, T.TimestampNTZType))
        if timed and temporal.has_clock(source, c):
            rows = temporal.add_timed_dates(rows, c, source, c, low, high, o.seed, o.method, o.keep_calendar)
        elif known and o.keep_calendar:
            weekdays, months = temporal.calendar_counts(dated, c)
            rows = temporal.add_patterned_dates(
                rows, c, low, days, weekdays, months, o.seed, o.method
            )
        else:
            u = Draws(o.seed, c, F.col("row_id"), o.method)(0)
            rows = rows.withColumn(c, temporal.uniform_dates(low, days, u))
        layout = (meta[c]["date_format"] or "%Y-%m-%d") if is_text else None
        rows = rows.withColumn(c, temporal.finish(F.col(f"`{c}`"), o.business_days, layout))
    return rows


def _person_exprs(rows, source, kinds, o: Options) -> dict[str, Column]:
    names = [c for c, k in kinds.items() if k.startswith("pii_")]
    if not names:
        return {}
    row = F.col("row_id")
    country = find_column(rows.columns, "country")
    if country:
        locale: str | Column = lookups.locale_of_country(F.col(f"`{country}`"), o.locale)
    else:
        locale = people.vote_locale(source, o.locale) or o.locale

    def person(name: str) -> dict[str, Column]:
        return people.name_parts(row, o.seed, locale, o.genders, name=name, method=o.method)

    main = person("name")
    out = {}
    for c in names:
        kind = kinds[c]
        style = o.overrides.get(c, {})
        if kind == "pii_email" or has_token(c, "email"):
            out[c] = people.email(main["first"], main["last"], row, o.seed, c,
                                  style.get("domains"), o.method)
        elif kind == "pii_phone" or has_token(c, "phone", "mobile"):
            out[c] = people.phone(row, o.seed, c, style.get("style", "dashes"),
                                  style.get("country", "US"), o.method)
        elif kind == "pii_address" or has_token(c, "address"):
            out[c] = people.address(row, o.seed, c, style.get("style", "full"), o.method)
        elif has_token(c, "first_name"):
            out[c] = main["first"]
        elif has_token(c, "last_name"):
            out[c] = main["last"]
        elif c.lower() == "name" or has_token(c, "full_name"):
            out[c] = people.full_name(main)
        elif kind == "pii_id":
            out[c] = people.identifier(row, o.seed, c, style.get("kind", "custom"), method=o.method)
        else:
            out[c] = people.full_name(person(c))
    return out


def blend(
    real: DataFrame, fabricated: DataFrame, label: str | None = None,
    fractions: Mapping | None = None, seed: int = 42,
) -> DataFrame:
    """Real and fabricated rows with an ``origin`` column; optional class balance of the latter.

    ``fractions`` keeps a share of each label's rows, by a seeded hash of the row (of ``row_id`` where
    there is one), so the same rows stay with any partition layout. Labels that are not named go.
    """
    extra = fabricated
    if label and fractions:
        own = F.col("row_id") if "row_id" in fabricated.columns else F.sha2(F.to_json(F.struct("*")), 256)
        share = F.lit(0.0)
        for value, fraction in fractions.items():
            share = F.when(F.col(f"`{label}`") == F.lit(value), F.lit(float(fraction))).otherwise(share)
        extra = fabricated.filter(uniform(seed, "blend", own) < share)
    return real.withColumn("origin", F.lit("real")).unionByName(
        extra.withColumn("origin", F.lit("fabricated")), allowMissingColumns=True
    )
