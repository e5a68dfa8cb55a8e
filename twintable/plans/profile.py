"""Column profiles: numeric, text, categorical, temporal and the combined table profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twintable.functions import dates
from twintable.functions.text import shape_pattern
from twintable.operators.aggregates import sample_kurtosis, sample_skewness
from twintable.operators.columns import (
    atomic_columns, numeric_columns, rows_from_wide, rows_per_column,
)
from twintable.operators.frequency import (
    LONG_VALUE, frequency_summary, melt, top_values, value_frequencies, value_key,
)
from twintable.operators.quantiles import DISTINCT_LIMIT, clean_number, quantile_values
from twintable.plans import detect, infer

QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
OUTLIER_FENCE = 1.5


def profile_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, distinct_limit: int = DISTINCT_LIMIT
) -> DataFrame:
    """One row per numeric column: moments, exact quantiles, shape, flags, outliers.

    The quantiles (a few numbers per column) become literals, so moments and the outlier
    count share a single further scan.
    """
    columns = list(columns or numeric_columns(df))
    found = quantile_values(df, columns, list(QUANTILES.values()), distinct_limit)
    per_column = []
    for i, name in enumerate(columns):
        c = clean_number(df, name)
        q = dict(zip(QUANTILES, found[name]))
        if q["q25"] is None:
            outliers = F.lit(0).cast("long")
        else:
            fence = OUTLIER_FENCE * (q["q75"] - q["q25"])
            outliers = F.count_if((c < q["q25"] - fence) | (c > q["q75"] + fence))
        n = F.count(c)
        parts: dict[str, Column] = {
            "n": n,
            "min": F.min(c),
            "max": F.max(c),
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
            "variance": F.var_samp(c),
            "skewness": sample_skewness(c, n),
            "kurtosis": sample_kurtosis(c, n),
            "is_integer": F.bool_and(c % 1 == 0),
            "is_positive": F.bool_and(c > 0),
            "outlier_count": outliers,
        }
        row = F.struct(
            F.lit(name).alias("column"),
            *[F.col(f"c{i}_{k}").alias(k) for k in parts],
            F.lit(q["q50"]).cast("double").alias("median"),
            *[F.lit(v).cast("double").alias(k) for k, v in q.items()],
            (F.col(f"c{i}_outlier_count") > 0).alias("has_outliers"),
        )
        per_column.append(([v.alias(f"c{i}_{k}") for k, v in parts.items()], [row]))
    return rows_per_column(df, per_column)


def _count_of(c: Column, runs: str) -> Column:
    """Characters in runs of a class: cutting runs out is quicker than counting single matches."""
    return F.length(c) - F.length(F.regexp_replace(c, runs, ""))


def length_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column: length statistics and character class shares, in one scan."""
    per_column = []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`").cast("string")
        size = F.length(c)
        # distinct lengths are bounded by the longest text, so the exact median stays small
        parts = {
            "n": F.count(c),
            "min_length": F.min(size),
            "max_length": F.max(size),
            "avg_length": F.avg(size),
            "median_length": F.percentile(size, F.lit(0.5)),
            "chars": F.sum(size),
            "upper": F.sum(_count_of(c, "[A-Z]+")),
            "lower": F.sum(_count_of(c, "[a-z]+")),
            "digits": F.sum(_count_of(c, r"\d+")),
            "special": F.sum(_count_of(c, r"[^a-zA-Z0-9\s]+")),
        }
        row = F.struct(F.lit(name).alias("column"), *[F.col(f"c{i}_{k}").alias(k) for k in parts])
        per_column.append(([v.alias(f"c{i}_{k}") for k, v in parts.items()], [row]))
    wide = rows_per_column(df, per_column)

    def share(k):
        return F.when(F.col("chars") > 0, F.col(k) / F.col("chars"))

    return wide.select(
        "column", "n", "min_length", "max_length", "avg_length", "median_length",
        share("upper").alias("uppercase_ratio"), share("lower").alias("lowercase_ratio"),
        share("digits").alias("numeric_ratio"), share("special").alias("special_char_ratio"),
    )


# Keys of long shapes that are broadcast at most; more of them are joined by key.
TIED_KEYS = 50_000


def shape_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of shape keys; long shapes travel as hashes."""
    return (
        melt(df, columns)
        .select("column", value_key(shape_pattern(F.col("value"))).alias("value"))
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def common_shapes(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """(column, rank, shape, n): the k most frequent shapes that repeat; ties go to the lower shape.

    Counting goes by key. All keys that tie at the k-th count are then candidates; the texts of
    long ones are looked up in the data, so only texts that may be shown are moved.
    """
    freq = shape_frequencies(df, columns).filter(F.col("n") > 1)
    least = top_values(freq, k).groupBy("column").agg(F.min("n").alias("least"))
    # a row per column on the right
    tied = freq.join(F.broadcast(least), "column").filter(F.col("n") >= F.col("least")).drop("least")
    keys = tied.filter(F.length("value") == LONG_VALUE).select("column", "value")
    if keys.limit(TIED_KEYS + 1).count() <= TIED_KEYS:
        keys = F.broadcast(keys)
    texts = (
        melt(df, columns)
        .withColumn("shape", shape_pattern(F.col("value")))
        .filter(F.length("shape") >= LONG_VALUE)
        .withColumn("value", value_key(F.col("shape")))
        .join(keys, ["column", "value"])
        .groupBy("column", "value")
        .agg(F.first("shape").alias("shape"))
    )
    shown = tied.join(texts, ["column", "value"], "left").select(
        "column", F.coalesce("shape", "value").alias("value"), "n"
    )
    return top_values(shown, k).withColumnRenamed("value", "shape")


def format_consistency(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """(column, top_share, has_consistent_format): share of the top shape, if it repeats."""
    summary = frequency_summary(shape_frequencies(df, columns))
    share = F.when(F.col("top_count") > 1, F.col("top_count") / F.col("n_values")).otherwise(0.0)
    return summary.select(
        "column", share.alias("top_share"), (share >= threshold).alias("has_consistent_format")
    )


def profile_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return length_profile(df, columns).join(
        F.broadcast(format_consistency(df, columns)), "column", "left"
    )


def profile_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_values, n_distinct, cardinality_ratio, is_categorical, top_count)."""
    ratio = F.col("n_distinct") / F.col("n_values")
    return frequency_summary(value_frequencies(df, columns, keys=True)).select(
        "column", "n_values", "n_distinct", ratio.alias("cardinality_ratio"),
        ((ratio < 0.05) | (F.col("n_distinct") < 50)).alias("is_categorical"), "top_count",
    )


def profile_temporal(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, min_date, max_date, date_range_days, date_format); text that is no date is left out."""
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in (columns or df.columns) if isinstance(types[c], kinds)]
    texts = [c for c in columns if isinstance(types[c], T.StringType)]
    chosen = dates.column_layouts(df, texts)
    aggs, structs = [], []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`")
        if isinstance(types[name], T.StringType):
            moment = dates.parse_date(c, chosen[name])
            layout = F.lit(dates.layout_name(chosen[name]))
        else:
            moment = c.cast("timestamp")
            text = F.min(c).cast("string")
            layout = dates.date_format_name(text)
        aggs += [
            F.count(c).alias(f"n{i}"), F.count(moment).alias(f"ok{i}"),
            F.min(moment).alias(f"lo{i}"), F.max(moment).alias(f"hi{i}"),
            layout.alias(f"fmt{i}"),
        ]
        span = F.floor(
            (F.unix_micros(F.col(f"hi{i}")) - F.unix_micros(F.col(f"lo{i}"))) / F.lit(86400000000)
        )
        structs.append(
            F.struct(
                F.lit(name).alias("column"),
                ((F.col(f"ok{i}") == F.col(f"n{i}")) & (F.col(f"n{i}") > 0)).alias("is_temporal"),
                F.col(f"lo{i}").alias("min_date"), F.col(f"hi{i}").alias("max_date"),
                span.cast("long").alias("date_range_days"), F.col(f"fmt{i}").alias("date_format"),
            )
        )
    return rows_from_wide(df.agg(*aggs), structs).filter("is_temporal").drop("is_temporal")


def with_consistency(profile: DataFrame) -> DataFrame:
    """Mean of completeness, type confidence, .9 for one format, .9 for few missing values."""
    parts = F.array_compact(
        F.array(
            F.col("completeness"),
            F.col("type_confidence"),
            F.when(F.col("has_consistent_format"), F.lit(0.9)),
            F.when((1 - F.col("completeness")) * 100 < 5, F.lit(0.9)),
        )
    )
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return profile.withColumn("consistency", total / F.size(parts))


def analyze_table(
    df: DataFrame, columns: Sequence[str] | None = None, whole_words: bool = False
) -> DataFrame:
    """The table profile: one row per column with counts, inferred type, personal data, quality.

    Three jobs whatever the number of columns: one scan for all signals and detectors each, and
    one shuffle of (column, value) counts.
    """
    columns = list(columns or atomic_columns(df))
    scored = infer.override_by_pii(
        infer.type_scores(df, columns), detect.primary_types(df, columns, whole_words)
    )
    formats = format_consistency(df, columns)
    total = F.col("total_count")
    profile = scored.join(F.broadcast(formats), "column", "left").select(
        "column", total, (total - F.col("n")).alias("null_count"),
        F.col("n_distinct").alias("unique_count"),
        (total - F.col("n_distinct")).alias("duplicate_count"),
        F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("completeness"),
        F.when(total > 0, F.col("n_distinct") / total).otherwise(0.0).alias("uniqueness"),
        "inferred_type", "type_confidence", "pii_type",
        F.col("pii_type").isNotNull().alias("contains_pii"),
        # the format check belongs to the text profile
        (F.col("inferred_type").isin("text", "categorical")
         & F.coalesce("has_consistent_format", F.lit(False))).alias("has_consistent_format"),
    )
    return with_consistency(profile)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Seeded uniform sample of n rows, the same on every run and partitioning.

    Each task keeps its n lowest hashes (top-k), so nothing is sorted as a whole.
    """
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return (
        df.withColumn("_mark", mark).orderBy("_mark", *keys).limit(n).drop("_mark")
    )
