"""Disclosure risk: group sizes, re-identification, uniqueness, leakage, and the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twintable.functions.numbers import not_nan
from twintable.operators.columns import (
    atomic_columns, merge_single_rows, rows_from_wide, small_copy,
)
from twintable.operators.frequency import (
    frequency_summary, group_sizes, normalized_entropy, present_rows, unique_rows, value_frequencies,
)

# Defaults and level limits.
DEFAULT_K = 5
RARE_GROUP = 3
LEVELS = ["low", "medium", "high", "critical"]
REID_LIMITS = (0.25, 0.5, 0.75)
UNIQUE_LIMITS = (0.1, 0.3, 0.5)
LEAK_LIMITS = (0.05, 0.1)


def level_by(c: Column, limits: Sequence[float]) -> Column:
    return (
        F.when(c < limits[0], "low").when(c < limits[1], "medium").when(c < limits[2], "high")
        .otherwise("critical")
    )


def _existing(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    wanted = list(columns) if columns else atomic_columns(df)
    return [c for c in wanted if c in df.columns]


def group_summary(
    df: DataFrame, keys: Sequence[str], k: int = DEFAULT_K, rare: int = RARE_GROUP
) -> DataFrame:
    """One row about the group sizes; groups are counted once for all risk measures."""
    size = F.col("group_size")
    sizes = group_sizes(df, keys)
    if any(not isinstance(df.schema[c].dataType, T.NumericType) for c in keys):
        # texts stay where they are: groups are told apart by their digest
        sizes = present_rows(df, keys).groupBy(_digest(df, keys, set()).alias("digest")).agg(F.count("*").alias("group_size"))
    return sizes.agg(
        F.count("*").alias("total_groups"), F.min(size).alias("min_group_size"),
        F.count_if(size < k).alias("groups_below_k"), F.count_if(size == 1).alias("unique_groups"),
        F.count_if(size <= rare).alias("rare_groups"),
    )


def k_anonymity(df: DataFrame, quasi_ids: Sequence[str], k: int = DEFAULT_K) -> DataFrame:
    """(satisfied, min_group_size, required_k, groups_below_k, total_groups)."""
    keys = [c for c in quasi_ids if c in df.columns]
    if not keys:
        raise ValueError("no valid quasi identifiers")
    return group_summary(df, keys, k).select(
        (F.coalesce("min_group_size", F.lit(0)) >= k).alias("satisfied"), "min_group_size",
        F.lit(k).alias("required_k"), "groups_below_k", "total_groups",
    )


def suggest_quasi_identifiers(
    df: DataFrame, columns: Sequence[str] | None = None, max_cardinality: int = 100
) -> DataFrame:
    """Columns with 2 < distinct < max and a distinct share between 1 and 50 per cent.

    A distinct-count sketch rules out columns far above the limit first, so only columns with
    few values are counted exactly.
    """
    columns = _existing(df, columns)
    screen = df.agg(
        F.count("*").alias("rows"),
        *[F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"d{i}")
          for i, c in enumerate(columns)],
    ).first()
    close = [c for i, c in enumerate(columns) if screen[f"d{i}"] < 1.5 * max_cardinality + 10]
    rows = screen["rows"]
    if not close or not rows:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long, ratio double")
    ratio = F.col("n_distinct") / F.lit(rows)
    return (
        frequency_summary(value_frequencies(df, close, keys=True))
        .select("column", "n_distinct", ratio.alias("ratio"))
        .filter((F.col("n_distinct") > 2) & (F.col("n_distinct") < max_cardinality))
        .filter((F.col("ratio") > 0.01) & (F.col("ratio") < 0.5))
    )


def _column_measures(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, mean normalized entropy and the product of the distinct counts."""
    entropies = normalized_entropy(value_frequencies(df, keys, keys=True))
    per_column = entropies.agg(
        F.avg("entropy").alias("distinctiveness"),
        # doubles: a product of counts soon leaves the long range
        F.product(F.col("n_distinct").cast("double")).alias("combinations"),
        F.count("*").alias("present_columns"),
    )
    return merge_single_rows(per_column, df.agg(F.count("*").alias("rows")))


def reid_row(measures: DataFrame, n_keys: int) -> DataFrame:
    # a column without any value has no entropy and makes the product zero
    share = F.col("present_columns") / F.lit(float(n_keys))
    distinct = F.coalesce(F.col("distinctiveness") * share, F.lit(0.0))
    combos = F.when(share < 1, F.lit(0.0)).otherwise(F.col("combinations"))
    unique = F.col("unique_groups") / F.col("rows")
    combined = F.least(F.lit(1.0), combos / F.col("rows"))
    risk = unique * 0.4 + distinct * 0.3 + combined * 0.3
    return measures.select(
        risk.alias("risk"), level_by(risk, REID_LIMITS).alias("risk_level"),
        unique.alias("uniqueness_score"), distinct.alias("distinctiveness_score"),
        combined.alias("combinatorial_risk"),
    )


def reidentification_risk(df: DataFrame, quasi_ids: Sequence[str] | None = None) -> DataFrame:
    """(risk, risk_level, uniqueness_score, distinctiveness_score, combinatorial_risk)."""
    keys = _existing(df, quasi_ids)
    measures = merge_single_rows(group_summary(df, keys), _column_measures(df, keys))
    return reid_row(measures, len(keys))


def uniqueness(
    df: DataFrame, columns: Sequence[str] | None = None, rare: int = RARE_GROUP
) -> DataFrame:
    """(total_records, total_unique_combinations, unique_records, rare_records, percentages)."""
    keys = _existing(df, columns) or atomic_columns(df)
    measures = merge_single_rows(
        group_summary(df, keys, rare=rare), df.agg(F.count("*").alias("rows"))
    )
    groups = F.col("total_groups")

    def pct(c):
        return F.when(groups > 0, F.col(c) / groups * 100).otherwise(F.lit(0.0))

    return measures.select(
        F.col("rows").alias("total_records"), groups.alias("total_unique_combinations"),
        F.col("unique_groups").alias("unique_records"), F.col("rare_groups").alias("rare_records"),
        pct("unique_groups").alias("unique_percentage"),
        pct("rare_groups").alias("rare_percentage"),
    )


def column_uniqueness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, unique_count, unique_ratio); the ratio is over all rows."""
    keys = _existing(df, columns)
    summary = frequency_summary(value_frequencies(df, keys, keys=True))
    totals = rows_from_wide(
        df.agg(F.count("*").alias("rows")),
        [F.struct(F.lit(c).alias("column"), F.col("rows").alias("rows")) for c in keys],
    )
    found = F.coalesce("n_distinct", F.lit(0))
    return totals.join(F.broadcast(summary), "column", "left").select(
        "column", found.alias("unique_count"), (found / F.col("rows")).alias("unique_ratio")
    )


find_unique_records = unique_rows


def _exact_text(c: Column, kind: T.DataType, numeric: bool) -> Column:
    """A cell as text that tells all values apart, timestamps to the microsecond."""
    if numeric or isinstance(kind, (T.DoubleType, T.FloatType)):
        return (c.cast("double") + F.lit(0.0)).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(c.alias("v")))
    return c.cast("string")


def _digest(df: DataFrame, columns: Sequence[str], numeric: set[str]) -> Column:
    """SHA-256 of a row as 32 bytes: rows are compared without shuffling their content."""
    cells = [_exact_text(F.col(f"`{c}`"), df.schema[c].dataType, c in numeric) for c in columns]
    parts = [x for t in cells for x in (F.length(t).cast("string"), F.lit(":"), t)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaked_rows(reference: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(shared_rows, n_syn): distinct complete rows that occur on both sides.

    Rows with a missing cell never match. Copies are combined before the shuffle.
    """
    columns = [c for c in synthetic.columns if c in reference.columns]
    kinds_r, kinds_s = reference.schema, synthetic.schema
    numeric = {
        c for c in columns
        if kinds_r[c].dataType != kinds_s[c].dataType
        and isinstance(kinds_r[c].dataType, T.NumericType)
        and isinstance(kinds_s[c].dataType, T.NumericType)
    }

    def side(df: DataFrame, is_ref: bool) -> DataFrame:
        whole = F.lit(True)
        for c in columns:
            whole = whole & not_nan(F.col(f"`{c}`"), df.schema[c].dataType).isNotNull()
        return df.filter(whole).select(
            _digest(df, columns, numeric).alias("digest"),
            F.lit(is_ref).alias("in_ref"), F.lit(not is_ref).alias("in_syn"),
        )

    shared = (
        side(reference, True).unionByName(side(synthetic, False))
        .groupBy("digest").agg(F.bool_or("in_ref").alias("r"), F.bool_or("in_syn").alias("s"))
        .agg(F.count_if(F.col("r") & F.col("s")).alias("shared_rows"))
    )
    return merge_single_rows(shared, synthetic.agg(F.count("*").alias("n_syn")))


def data_leakage(reference: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(leakage_ratio, score, risk_level)."""
    ratio = F.when(F.col("n_syn") > 0, F.col("shared_rows") / F.col("n_syn")).otherwise(F.lit(0.0))
    return leaked_rows(reference, synthetic).select(
        "shared_rows", ratio.alias("leakage_ratio"), (1 - ratio).alias("score"),
        F.when(ratio == 0, "low").when(ratio < LEAK_LIMITS[0], "medium")
        .when(ratio < LEAK_LIMITS[1], "high").otherwise("critical").alias("risk_level"),
    )


def privacy_report(
    synthetic: DataFrame,
    reference: DataFrame | None = None,
    quasi_ids: Sequence[str] | None = None,
    k: int = DEFAULT_K,
) -> DataFrame:
    """(metric, value, passed, risk_level, details) of all risk measures.

    Group sizes are counted once and shared by the first three metrics.
    """
    if quasi_ids is None:
        quasi_ids = [
            r["column"] for r in suggest_quasi_identifiers(synthetic).orderBy("column").collect()
        ]
        quasi_ids = [c for c in synthetic.columns if c in set(quasi_ids)]
    keys = _existing(synthetic, quasi_ids)
    measures = merge_single_rows(group_summary(synthetic, keys, k), _column_measures(synthetic, keys))
    m = small_copy(measures)

    def details(**parts):
        items = [x for key, c in parts.items() for x in (F.lit(key), c.cast("string"))]
        return F.create_map(*items)

    def row(metric, value, passed, level, info):
        return F.struct(
            F.lit(metric).alias("metric"), value.cast("double").alias("value"),
            passed.alias("passed"), level.alias("risk_level"), info.alias("details"),
        )

    r = small_copy(reid_row(m, len(keys)))
    smallest = F.coalesce(F.col("min_group_size"), F.lit(0))
    groups = F.col("total_groups")
    unique = F.when(groups > 0, F.col("unique_groups") / groups).otherwise(F.lit(0.0))
    rows = []
    if quasi_ids:
        rows.append(
            row("k_anonymity", smallest / F.lit(k), smallest >= k,
                F.when(smallest >= k, "low").otherwise("high"),
                details(min_group_size=smallest, required_k=F.lit(k),
                        groups_below_k=F.col("groups_below_k"), total_groups=groups))
        )
    rows.append(
        row("uniqueness", 1 - unique, unique < 0.3, level_by(unique, UNIQUE_LIMITS),
            details(total_records=F.col("rows"), unique_records=F.col("unique_groups"),
                    rare_records=F.col("rare_groups"), total_unique_combinations=groups))
    )
    out = rows_from_wide(m, rows).unionByName(
        r.select(F.inline(F.array(
            row("reidentification_risk", 1 - F.col("risk"), F.col("risk") < 0.5, F.col("risk_level"),
                details(uniqueness_score=F.col("uniqueness_score"),
                        distinctiveness_score=F.col("distinctiveness_score"),
                        combinatorial_risk=F.col("combinatorial_risk")))
        )))
    )
    if reference is not None:
        leak = data_leakage(reference, synthetic)
        out = out.unionByName(leak.select(F.inline(F.array(
            row("data_leakage", F.col("score"), F.col("score") > 0.95, F.col("risk_level"),
                details(leakage_ratio=F.col("leakage_ratio")))
        ))))
    return out


def privacy_summary(report: DataFrame) -> DataFrame:
    """(total_metrics, critical_risks, high_risks, overall_risk, passed) of a report."""
    order = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("risk_level"))
    worst = F.get(F.array(*map(F.lit, LEVELS)), (F.max(order) - 1).cast("int"))
    return report.agg(
        F.count("*").alias("total_metrics"),
        F.count_if(F.col("risk_level") == "critical").alias("critical_risks"),
        F.count_if(F.col("risk_level") == "high").alias("high_risks"),
        worst.alias("overall_risk"),
        (F.max(order) <= 2).alias("passed"),
    )


# Advice texts.
ADVICE = {
    "k": "Increase k-anonymity by generalizing quasi-identifiers.",
    "reid": "Reduce re-identification risk via noise or aggregation.",
    "critical": "Critical privacy risks detected — do not release data.",
    "high": "High privacy risks detected — mitigation recommended.",
    "passed": "Privacy validation passed.",
}


def recommendations(report: DataFrame) -> DataFrame:
    """(position, recommendation) rows that follow from a report."""
    value = {m: F.max(F.when(F.col("metric") == m, F.col("value")))
             for m in ("k_anonymity", "reidentification_risk")}
    critical = F.count_if(F.col("risk_level") == "critical") > 0
    high = F.count_if(F.col("risk_level") == "high") > 0
    small_groups = (value["k_anonymity"] > 0) & (value["k_anonymity"] < 1)
    risky = value["reidentification_risk"] < 0.5
    advice = report.agg(
        F.array_compact(F.array(
            F.when(small_groups, F.lit(ADVICE["k"])),
            F.when(risky, F.lit(ADVICE["reid"])),
            F.when(critical, F.lit(ADVICE["critical"])),
            F.when(high & ~critical, F.lit(ADVICE["high"])),
        )).alias("advice")
    )
    texts = F.when(F.size("advice") > 0, F.col("advice")).otherwise(
        F.array(F.lit(ADVICE["passed"]))
    )
    return advice.select(F.posexplode(texts).alias("position", "recommendation"))


def risks_at(report: DataFrame, level: str) -> DataFrame:
    return report.filter(F.col("risk_level") == level)


def generalize(
    df: DataFrame, widths: dict[str, float] | None = None, prefixes: dict[str, int] | None = None
) -> DataFrame:
    """Coarser quasi-identifiers: numbers to the lower end of their band, texts to a prefix."""
    changed = {}
    for c, width in (widths or {}).items():
        kind = df.schema[c].dataType
        changed[c] = (F.floor(F.col(f"`{c}`") / F.lit(width)) * F.lit(width)).cast(kind)
    for c, length in (prefixes or {}).items():
        changed[c] = F.substring(F.col(f"`{c}`").cast("string"), 1, length)
    return df.withColumns(changed) if changed else df


def add_noise(df: DataFrame, column: str, scale: float, key: str, seed: int = 42) -> DataFrame:
    """Centred uniform noise of width 2 * scale, seeded by the row key."""
    from twintable.functions.draw import uniform

    u = uniform(seed, column, F.col(f"`{key}`"))
    return df.withColumn(column, F.col(f"`{column}`") + (u * 2 - 1) * F.lit(float(scale)))


def suppress_small_groups(df: DataFrame, keys: Sequence[str], k: int = DEFAULT_K) -> DataFrame:
    """Keep rows whose group has at least k members; a missing key is a value of its own.

    The key list of the large groups is far shorter than the table; it is joined back, so no
    group is gathered in one task.
    """
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    large = (
        df.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in names.items()]).agg(F.count("*").alias("_size"))
        .filter(F.col("_size") >= k)
    )
    same = [F.col(f"`{key}`").eqNullSafe(F.col(n)) for key, n in names.items()]
    return df.join(large, on=same, how="left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def enforce_k_anonymity(
    df: DataFrame,
    quasi_ids: Sequence[str],
    k: int = DEFAULT_K,
    widths: dict[str, float] | None = None,
    prefixes: dict[str, int] | None = None,
) -> DataFrame:
    """Generalize, then drop what is still in a group below k."""
    return suppress_small_groups(generalize(df, widths, prefixes), quasi_ids, k)
