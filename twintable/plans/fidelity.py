"""Fidelity of a stand-in against its source: (column, metric, value, threshold, passed, details)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twintable.functions.numbers import plain_text, relative_difference, unit_interval
from twintable.functions.text import tokens
from twintable.operators.aggregates import correlation_pairs
from twintable.operators.columns import is_numeric, rows_from_wide, small_copy
from twintable.operators.ecdf import two_sample_ks
from twintable.operators.frequency import melt, value_key
from twintable.operators.quantiles import clean_number, quantile_values
from twintable.session import durable

# Default thresholds and the format patterns of two personal-data kinds.
THRESHOLD = 0.7
PII_THRESHOLD = 0.8
REPORT_THRESHOLD = 0.8
LEAK_THRESHOLD = 0.95
FORMATS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "phone": r"^[\+\d][\d\s\-\(\)\.]{7,}$",
}
METRIC_SCHEMA = (
    "column string, metric string, value double, threshold double, passed boolean, "
    "details map<string,double>"
)


def _metric(
    column: Column, metric: str, value: Column, threshold: float, details: Column | None = None
) -> Column:
    return F.struct(
        column.alias("column"), F.lit(metric).alias("metric"), value.alias("value"),
        F.lit(float(threshold)).alias("threshold"), (value >= F.lit(float(threshold))).alias("passed"),
        (details if details is not None else F.create_map().cast("map<string,double>"))
        .alias("details"),
    )


def _metric_rows(df: DataFrame, *metrics: Column) -> DataFrame:
    return df.select(F.inline(F.array(*metrics))).filter(F.col("value").isNotNull())


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], METRIC_SCHEMA)


# ------------------------------------------------------------------ numeric


def ks_p_value(ks: Column, n_ref: Column, n_syn: Column) -> Column:
    """Asymptotic p-value of the two-sample statistic."""
    x = F.sqrt(n_ref * n_syn / (n_ref + n_syn)) * ks
    terms = F.sequence(F.lit(1), F.lit(60))
    series = F.aggregate(
        terms, F.lit(0.0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        * F.exp(F.lit(-2.0) * i * i * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(unit_interval(series))


def _both_moments(reference: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, r_*, s_*): count, mean, std, min, max, quartiles per side."""
    frames = []
    for df, p in ((reference, "r"), (synthetic, "s")):
        q = quantile_values(df, columns, [0.25, 0.5, 0.75])
        aggs, structs = [], []
        for i, name in enumerate(columns):
            c = clean_number(df, name)
            parts = {"n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c),
                     "min": F.min(c), "max": F.max(c)}
            aggs += [v.alias(f"c{i}_{k}") for k, v in parts.items()]
            structs.append(F.struct(
                F.lit(name).alias("column"),
                *[F.col(f"c{i}_{k}").alias(f"{p}_{k}") for k in parts],
                *[F.lit(v).cast("double").alias(f"{p}_q{j}") for j, v in enumerate(q[name])],
            ))
        frames.append(rows_from_wide(df.agg(*aggs), structs))
    # one row per column on both sides
    return frames[0].join(F.broadcast(frames[1]), "column")


def _mean_of(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / F.lit(float(len(parts)))


def statistics_score() -> Column:
    pairs = [("mean", "mean"), ("std", "std"), ("q0", "q0"), ("q1", "q1"), ("q2", "q2")]
    diffs = [relative_difference(F.col(f"r_{a}"), F.col(f"s_{b}")) for a, b in pairs]
    return unit_interval(1 - _mean_of(diffs))


def range_score() -> Column:
    spread = F.col("r_max") - F.col("r_min")
    low = F.when(F.col("s_min") < F.col("r_min") - 0.1 * spread, 0.2).otherwise(0.0)
    high = F.when(F.col("s_max") > F.col("r_max") + 0.1 * spread, 0.2).otherwise(0.0)
    return F.when(spread == 0, F.lit(1.0)).otherwise(unit_interval(1 - (low + high)))


def numeric_metrics(
    reference: DataFrame, synthetic: DataFrame, columns: Sequence[str],
    threshold: float = THRESHOLD, correlations: bool = True,
) -> DataFrame:
    """KS, statistics and range score per column, correlation preservation over all of them."""
    columns = [c for c in columns if c in synthetic.columns]
    if not columns:
        return _empty(reference)
    ks = two_sample_ks(reference, synthetic, columns)
    gap = F.col("ks")
    out = _metric_rows(
        ks,
        _metric(F.col("column"), "ks_test", unit_interval(1 - gap), threshold,
                F.create_map(F.lit("ks"), gap, F.lit("p"),
                             ks_p_value(gap, F.col("n_ref"), F.col("n_syn")))),
    )
    both = _both_moments(reference, synthetic, columns).filter(
        (F.col("r_n") > 0) & (F.col("s_n") > 0)
    )
    out = out.unionByName(_metric_rows(
        both,
        _metric(F.col("column"), "statistics", statistics_score(), threshold),
        _metric(F.col("column"), "range", range_score(), threshold),
    ))
    if correlations and len(columns) > 1:
        out = out.unionByName(correlation_preservation(reference, synthetic, columns, threshold))
    return out


def correlation_preservation(
    reference: DataFrame, synthetic: DataFrame, columns: Sequence[str], threshold: float = THRESHOLD
) -> DataFrame:
    """1 - mean absolute difference over the whole matrix, diagonal included."""
    a = correlation_pairs(reference, columns)
    b = correlation_pairs(synthetic, columns).withColumnRenamed("corr", "corr_syn")
    diff = a.join(F.broadcast(b), ["column_a", "column_b"]).agg(
        F.avg(F.abs(F.col("corr") - F.col("corr_syn"))).alias("diff")
    )
    return _metric_rows(
        diff,
        _metric(F.lit("*"), "correlation_preservation", unit_interval(1 - F.col("diff")), threshold),
    )


# --------------------------------------------------------------------- text


def _sided(reference: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, is_ref, value) of both sides as text."""
    r = melt(reference, columns).withColumn("is_ref", F.lit(1))
    s = melt(synthetic, columns).withColumn("is_ref", F.lit(0))
    return r.unionByName(s)


def _side_counts() -> list[Column]:
    return [F.sum("is_ref").alias("ref"), F.sum(1 - F.col("is_ref")).alias("syn")]


def length_scores(
    reference: DataFrame, synthetic: DataFrame, columns: Sequence[str], threshold: float = THRESHOLD
) -> DataFrame:
    def lengths(df):
        types = {f.name: f.dataType for f in df.schema.fields}
        return df.select(*[
            F.length(plain_text(F.col(f"`{c}`"), types[c])).alias(f"len_{i}")
            for i, c in enumerate(columns)
        ])

    names = [f"len_{i}" for i in range(len(columns))]
    rl, sl = lengths(reference), lengths(synthetic)
    frames = []
    for df, p in ((rl, "r"), (sl, "s")):
        wide = df.agg(*[f(c).alias(f"{c}_{k}") for c in names
                        for k, f in (("mean", F.avg), ("std", F.stddev_samp))])
        frames.append(rows_from_wide(wide, [
            F.struct(F.lit(c).alias("column"), F.col(f"{c}_mean").alias(f"{p}_mean"),
                     F.col(f"{c}_std").alias(f"{p}_std")) for c in names
        ]))
    joined = (
        two_sample_ks(rl, sl, names)
        .join(F.broadcast(frames[0]), "column").join(F.broadcast(frames[1]), "column")
    )
    mean_gap = F.abs(F.col("r_mean") - F.col("s_mean")) / (F.col("r_mean") + F.lit(1e-9))
    std_gap = F.abs(F.col("r_std") - F.col("s_std")) / (F.col("r_std") + F.lit(1e-9))
    label = F.create_map(*[F.lit(x) for pair in zip(names, columns) for x in pair])
    score = unit_interval(1 - _mean_of([mean_gap, std_gap, F.col("ks")]))
    return _metric_rows(
        joined, _metric(label[F.col("column")], "length_distribution", score, threshold)
    )


def vocabulary_table(
    reference: DataFrame, synthetic: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """(column, ref_words, syn_words, both, either, ref_tokens, syn_tokens).

    Tokens are counted per side in one shuffle; no word set is ever held anywhere.
    """
    counted = (
        _sided(reference, synthetic, columns)
        .select("column", "is_ref", F.explode(tokens(F.col("value"))).alias("token"))
        .groupBy("column", "token").agg(*_side_counts())
    )
    r, s = F.col("ref") > 0, F.col("syn") > 0
    return counted.groupBy("column").agg(
        F.count_if(r).alias("ref_words"), F.count_if(s).alias("syn_words"),
        F.count_if(r & s).alias("both"), F.count("*").alias("either"),
        F.sum("ref").alias("ref_tokens"), F.sum("syn").alias("syn_tokens"),
    )


def vocabulary_scores(
    reference: DataFrame, synthetic: DataFrame, columns: Sequence[str], threshold: float = THRESHOLD
) -> DataFrame:
    v = vocabulary_table(reference, synthetic, columns)
    overlap = F.col("both") / F.col("either")
    spread = F.abs(
        F.col("ref_words") / F.greatest("ref_tokens", F.lit(1))
        - F.col("syn_words") / F.greatest("syn_tokens", F.lit(1))
    )
    score = F.when(
        (F.col("ref_words") > 0) & (F.col("syn_words") > 0),
        unit_interval(overlap * 0.7 + F.greatest(F.lit(0.0), 1 - spread) * 0.3),
    ).otherwise(F.lit(0.0))
    return _metric_rows(v, _metric(F.col("column"), "vocabulary", score, threshold))


def value_overlap(
    reference: DataFrame, synthetic: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """(column, ref_rows, syn_rows, ref_distinct, syn_distinct, both): values on either side."""
    counted = (
        _sided(reference, synthetic, columns)
        .select("column", "is_ref", value_key(F.col("value")).alias("value"))
        .groupBy("column", "value").agg(*_side_counts())
    )
    r, s = F.col("ref") > 0, F.col("syn") > 0
    return counted.groupBy("column").agg(
        F.sum("ref").alias("ref_rows"), F.sum("syn").alias("syn_rows"),
        F.count_if(r).alias("ref_distinct"), F.count_if(s).alias("syn_distinct"),
        F.count_if(r & s).alias("both"),
    ).filter((F.col("ref_rows") > 0) & (F.col("syn_rows") > 0))


def uniqueness_scores(
    reference: DataFrame, synthetic: DataFrame, columns: Sequence[str], threshold: float = THRESHOLD
) -> DataFrame:
    o = value_overlap(reference, synthetic, columns)
    gap = F.abs(F.col("ref_distinct") / F.col("ref_rows") - F.col("syn_distinct") / F.col("syn_rows"))
    return _metric_rows(o, _metric(F.col("column"), "uniqueness", unit_interval(1 - gap), threshold))


def text_metrics(
    reference: DataFrame, synthetic: DataFrame, columns: Sequence[str], threshold: float = THRESHOLD
) -> DataFrame:
    columns = [c for c in columns if c in synthetic.columns]
    if not columns:
        return _empty(reference)
    return (
        length_scores(reference, synthetic, columns, threshold)
        .unionByName(vocabulary_scores(reference, synthetic, columns, threshold))
        .unionByName(uniqueness_scores(reference, synthetic, columns, threshold))
    )


# ------------------------------------------------------------ personal data


def pii_metrics(
    reference: DataFrame, synthetic: DataFrame, kinds: Mapping[str, str],
    threshold: float = PII_THRESHOLD,
) -> DataFrame:
    """Format validity, absence of leaked values and diversity of columns of known kinds."""
    columns = [c for c in kinds if c in synthetic.columns]
    if not columns:
        return _empty(reference)
    aggs, structs = [], []
    for i, c in enumerate(columns):
        text = F.col(f"`{c}`").cast("string")
        pattern = FORMATS.get(kinds[c])
        valid = F.avg(text.rlike(pattern).cast("double")) if pattern else F.max(
            F.when(text.isNotNull(), F.lit(1.0))
        )
        aggs.append(valid.alias(f"v{i}"))
        structs.append(_metric(F.lit(c), "format_validity", F.col(f"v{i}"), threshold))
    formats = _metric_rows(synthetic.agg(*aggs), *structs)
    o = value_overlap(reference, synthetic, columns)
    return formats.unionByName(_metric_rows(
        o,
        _metric(F.col("column"), "no_leakage", 1 - F.col("both") / F.col("syn_rows"), LEAK_THRESHOLD),
        _metric(F.col("column"), "diversity", F.col("syn_distinct") / F.col("syn_rows"), threshold),
    ))


# ----------------------------------------------------------------- temporal


def calendar_histograms(
    reference: DataFrame, synthetic: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """(column, part, slot, ref, syn): weekday (0 = Monday) and month counts of both sides."""
    def side(df, is_ref):
        cells = [
            F.struct(F.lit(c).alias("column"), F.lit(part).alias("part"), f(F.col(f"`{c}`")).alias("slot"))
            for c in columns for part, f in (("weekday", F.weekday), ("month", F.month))
        ]
        return df.select(F.inline(F.array(*cells))).withColumn("is_ref", F.lit(is_ref)).filter(
            F.col("slot").isNotNull()
        )

    return (
        side(reference, 1).unionByName(side(synthetic, 0))
        .groupBy("column", "part", "slot").agg(*_side_counts())
    )


def distribution_distance(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, js): Jensen-Shannon distance (natural log, square root) of ref and syn counts."""
    totals = counts.groupBy(*by).agg(F.sum("ref").alias("nr"), F.sum("syn").alias("ns"))
    p, q = F.col("ref") / F.col("nr"), F.col("syn") / F.col("ns")
    m = (p + q) / 2

    def part(x):
        return F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))

    # counts and totals have a handful of rows per column
    return (
        counts.join(F.broadcast(totals.filter((F.col("nr") > 0) & (F.col("ns") > 0))), list(by))
        .groupBy(*by).agg((F.sum(part(p) + part(q)) / 2).alias("divergence"))
        .select(*by, F.sqrt(F.greatest("divergence", F.lit(0.0))).alias("js"))
    )


def temporal_metrics(
    reference: DataFrame, synthetic: DataFrame, columns: Sequence[str], threshold: float = THRESHOLD
) -> DataFrame:
    """Range, weekday and month scores."""
    columns = [c for c in columns if c in synthetic.columns]
    if not columns:
        return _empty(reference)
    frames = []
    for df, p in ((reference, "r"), (synthetic, "s")):
        wide = df.agg(*[
            f(F.unix_micros(F.col(f"`{c}`").cast("timestamp"))).alias(f"c{i}_{k}")
            for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))
        ])
        frames.append(rows_from_wide(wide, [
            F.struct(F.lit(c).alias("column"), F.col(f"c{i}_lo").alias(f"{p}_lo"),
                     F.col(f"c{i}_hi").alias(f"{p}_hi")) for i, c in enumerate(columns)
        ]))
    day = 86_400_000_000
    days = F.greatest(F.floor((F.col("r_hi") - F.col("r_lo")) / F.lit(day)), F.lit(1))
    slack = days * F.lit(0.1 * day)
    low = F.when(F.col("s_lo") < F.col("r_lo") - slack, 0.2).otherwise(0.0)
    high = F.when(F.col("s_hi") > F.col("r_hi") + slack, 0.2).otherwise(0.0)
    spans = frames[0].join(F.broadcast(frames[1]), "column").filter(
        F.col("r_lo").isNotNull() & F.col("s_lo").isNotNull()
    )
    out = _metric_rows(spans, _metric(F.col("column"), "range", unit_interval(1 - (low + high)), threshold))
    distances = distribution_distance(
        calendar_histograms(reference, synthetic, columns), ["column", "part"]
    ).groupBy("column").agg(
        F.max(F.when(F.col("part") == "weekday", F.col("js"))).alias("weekday"),
        F.max(F.when(F.col("part") == "month", F.col("js"))).alias("month"),
    )
    return out.unionByName(_metric_rows(
        distances,
        _metric(F.col("column"), "weekday_distribution", unit_interval(1 - F.col("weekday")), threshold),
        _metric(F.col("column"), "monthly_distribution", unit_interval(1 - F.col("month")), threshold),
    ))


# ------------------------------------------------------------------- report


def metric_types(df: DataFrame) -> dict[str, str]:
    """Column -> temporal, numeric or text, by physical type."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[f.name] = "temporal"
        elif is_numeric(f.dataType):
            out[f.name] = "numeric"
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out[f.name] = "text"
    return out


def quality_report(
    reference: DataFrame,
    synthetic: DataFrame,
    column_types: Mapping[str, str] | None = None,
    threshold: float = REPORT_THRESHOLD,
    pii_kinds: Mapping[str, str] | None = None,
    correlations: bool = False,
    stage: bool = False,
) -> DataFrame:
    """All metrics of all columns in one frame; columns of one type share their jobs.

    The metrics scan both tables several times. ``stage`` checkpoints them first, which pays
    when they are costly to compute and not plain files.
    """
    if stage:
        reference, synthetic = durable(reference), durable(synthetic)
    kinds = dict(column_types or metric_types(reference))
    by_kind = {k: [c for c, t in kinds.items() if t == k and c in synthetic.columns]
               for k in ("numeric", "temporal")}
    texts = [c for c, t in kinds.items() if t not in by_kind and c in synthetic.columns]
    out = numeric_metrics(reference, synthetic, by_kind["numeric"], threshold, correlations)
    out = out.unionByName(temporal_metrics(reference, synthetic, by_kind["temporal"], threshold))
    out = out.unionByName(text_metrics(reference, synthetic, texts, threshold))
    if pii_kinds:
        out = out.unionByName(pii_metrics(reference, synthetic, pii_kinds))
    # a few rows per column: run once, so that roll-ups do not repeat the work
    return small_copy(out)


def column_scores(report: DataFrame) -> DataFrame:
    return report.groupBy("column").agg(F.avg("value").alias("score"), F.count("*").alias("metrics"))


def quality_summary(report: DataFrame, threshold: float = REPORT_THRESHOLD) -> DataFrame:
    overall = F.coalesce(F.avg("value"), F.lit(0.0))
    return report.agg(
        overall.alias("overall_score"),
        ((F.count("*") > 0) & (overall >= threshold)).alias("passed"),
        F.count("*").alias("total_metrics"),
        F.count_if("passed").alias("passed_metrics"),
        F.count_if(~F.col("passed")).alias("failed_metrics"),
    )


def failed_metrics(report: DataFrame) -> DataFrame:
    return report.filter(~F.col("passed"))
