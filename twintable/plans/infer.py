"""Type inference with confidence, and the router that decides how a column is fabricated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twintable.functions import dates
from twintable.functions.numbers import not_nan, plain_text, text_to_number
from twintable.operators import aggregates
from twintable.operators.columns import (
    atomic_columns, has_token, is_numeric, rows_from_wide, rows_per_column, small_copy,
)
from twintable.operators.frequency import frequency_summary, value_frequencies
from twintable.plans import detect

# Words users may give as type hints, and the family that fabricates a type.
HINT_TYPES = {
    "numeric": "numeric",
    "text": "text",
    "categorical": "categorical",
    "name": "pii_name",
    "email": "pii_email",
    "phone": "pii_phone",
    "address": "pii_address",
    "id": "pii_id",
    "date": "temporal",
    "datetime": "temporal",
    "boolean": "boolean",
}
FAMILIES = {
    "numeric": "numeric",
    "boolean": "numeric",
    "text": "text",
    "categorical": "hybrid",
    "temporal": "temporal",
    "pii_name": "pii",
    "pii_email": "pii",
    "pii_phone": "pii",
    "pii_address": "pii",
    "pii_id": "pii",
    "unknown": "hybrid",
}
DATE_WORDS = ("date", "time", "timestamp", "created_at", "updated_at", "dob")
ROUTING_SIGNALS = ("n", "n_parsed", "avg_len", "max_len", "all_bool")
INTEGER_WORDS = ("age", "sl no", "serial no", "serial number", "record id", "id")


def hinted_type(hint: str) -> str:
    return HINT_TYPES.get(hint.lower(), "unknown")


def family_of(data_type: str) -> str:
    return FAMILIES.get(data_type, "hybrid")


def should_be_integer(column: str, dtype: T.DataType, all_integral: bool | None) -> bool:
    """Integer by type, by name, or because every value is whole."""
    if isinstance(dtype, T.IntegralType):
        return True
    return has_token(column, *INTEGER_WORDS) or bool(all_integral)


def signals(df: DataFrame, columns: Sequence[str], scores: bool = True) -> DataFrame:
    """Per column the counts that types are inferred from; one scan, no shuffle of values.

    Routing needs only some of them; ``scores`` adds what the type scores use.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    per_column = []
    for i, name in enumerate(columns):
        dtype = types[name]
        value = not_nan(F.col(f"`{name}`"), dtype)
        text = plain_text(value, dtype)
        length = F.length(text)
        if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            parsed, number = value.isNotNull(), F.lit(None).cast("double")
            is_bool = F.lit(False)
        elif is_numeric(dtype) or isinstance(dtype, T.BooleanType):
            parsed, number = F.lit(False), value.cast("double")
            is_bool = value.cast("double").isin(0.0, 1.0)
        else:
            parsed, number = dates.parse_date(text).isNotNull(), text_to_number(text)
            is_bool = F.lit(False)
        parts = {
            "n": F.count(value),
            "n_numeric": F.count(number),
            "n_parsed": F.count_if(parsed & value.isNotNull()),
            "n_date_like": F.count_if(dates.date_like(text)),
            "n_spaces": F.count_if(F.contains(text, F.lit(" "))),
            "n_mixed_case": F.count_if(text.rlike("[a-z]") & text.rlike("[A-Z]")),
            "avg_len": F.avg(length),
            "std_len": F.stddev_samp(length),
            "max_len": F.max(length),
            "all_bool": F.bool_and(is_bool),
        }
        if not scores:
            parts = {k: parts[k] for k in ROUTING_SIGNALS}
        dated = isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
        row = F.struct(
            F.lit(name).alias("column"), F.lit(is_numeric(dtype)).alias("numeric_type"),
            F.lit(dated).alias("date_type"), F.col("rows").alias("total_count"),
            *[F.col(f"c{i}_{k}").alias(k) for k in parts],
        )
        per_column.append(([v.alias(f"c{i}_{k}") for k, v in parts.items()], [row]))
    return rows_per_column(df, per_column, [F.count("*").alias("rows")])


def with_distinct_counts(
    df: DataFrame, columns: Sequence[str], sig: DataFrame
) -> DataFrame:
    summary = frequency_summary(value_frequencies(df, columns, keys=True))
    # one row per column on both sides
    return (
        sig.join(F.broadcast(summary.drop("n_values")), "column", "left")
        .fillna({"n_distinct": 0, "top_count": 0})
    )


def type_scores(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, numeric, categorical, text, temporal, inferred_type, type_confidence, ...)."""
    columns = list(columns or atomic_columns(df))
    return score_types(with_distinct_counts(df, columns, signals(df, columns)))


def score_types(sig: DataFrame) -> DataFrame:
    n = F.col("n")

    def points(*steps):
        """First condition that holds gives its points."""
        out = F.lit(0.0)
        for condition, value in reversed(steps):
            out = F.when(condition, F.lit(value)).otherwise(out)
        return out

    def share(c):
        return F.when(n > 0, F.col(c) / n).otherwise(F.lit(0.0))

    present = n > 0
    ratio = F.col("n_distinct") / n
    all_convert = present & (F.col("n_numeric") == n)
    numeric = points((F.col("numeric_type"), 0.4)) + points((all_convert, 0.5))
    categorical = F.when(
        present,
        points((ratio < 0.01, 0.4), (ratio < 0.05, 0.3), (ratio < 0.1, 0.2))
        + points((F.col("n_distinct") < 10, 0.2), (F.col("n_distinct") < 50, 0.1))
        + points((F.col("top_count") / n > 0.3, 0.1)),
    ).otherwise(F.lit(0.0))
    text = F.when(
        present,
        points((F.col("avg_len") > 20, 0.3))
        + points((F.coalesce(F.col("std_len"), F.lit(0.0)) > 10, 0.2))
        + points((share("n_spaces") > 0.5, 0.2))
        + points((share("n_mixed_case") > 0.3, 0.1)),
    ).otherwise(F.lit(0.0))
    temporal = points((share("n_parsed") >= 0.95, 0.5), (share("n_parsed") >= 0.8, 0.3)) + points(
        ((~F.col("numeric_type")) & (share("n_date_like") > 0.7), 0.2)
    )
    named = [("numeric", numeric), ("categorical", categorical), ("text", text),
             ("temporal", temporal)]
    scored = sig.withColumns({f"{k}_score": F.round(v, 6) for k, v in named})
    best = F.greatest(
        *[
            F.when(
                F.col(f"{k}_score") > 0.3,
                F.struct(F.col(f"{k}_score").alias("confidence"), F.lit(-i).alias("order"),
                         F.lit(k).alias("kind")),
            )
            for i, (k, _) in enumerate(named)
        ]
    )
    return scored.withColumn("best", best).select(
        "*",
        F.coalesce(F.col("best.kind"), F.lit("text")).alias("inferred_type"),
        F.coalesce(F.col("best.confidence"), F.lit(0.2)).alias("type_confidence"),
    ).drop("best")


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Winning type per column, with personal-data types taking over when they are surer."""
    columns = list(columns or atomic_columns(df))
    return override_by_pii(
        type_scores(df, columns), detect.primary_types(df, columns)
    )


def override_by_pii(scores: DataFrame, primary: DataFrame) -> DataFrame:
    found = primary.select(
        "column", "pii_type", F.col("confidence").alias("pii_confidence")
    )
    wins = (F.col("pii_confidence") > 0.8) & (F.col("pii_confidence") > F.col("type_confidence"))
    return scores.join(F.broadcast(found), "column", "left").withColumns(
        {
            "inferred_type": F.when(wins, F.concat(F.lit("pii_"), F.col("pii_type")))
            .otherwise(F.col("inferred_type")),
            "type_confidence": F.when(wins, F.col("pii_confidence"))
            .otherwise(F.col("type_confidence")),
        }
    )


def _type_by_name(column: str) -> str | None:
    if has_token(column, "email", "e-mail"):
        return "pii_email"
    if has_token(column, "first_name", "last_name", "full_name", "name"):
        return "pii_name"
    if has_token(column, "phone", "mobile"):
        return "pii_phone"
    if has_token(column, "address"):
        return "pii_address"
    if has_token(column, "city", "country"):
        return "categorical"
    return None


def route_types(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    hints: Mapping[str, str] | None = None,
) -> DataFrame:
    """(column, data_type, pipeline, ...): how each column will be fabricated.

    Decision list: hint, name, boolean, numeric, temporal, personal data, categorical, text.
    """
    columns = list(columns or atomic_columns(df))
    sig = with_distinct_counts(df, columns, signals(df, columns, scores=False))
    strings = [f.name for f in df.schema.fields
               if f.name in columns and isinstance(f.dataType, T.StringType)]
    if strings:
        sig = sig.join(
            F.broadcast(detect.router_pii(df, strings).select("column", "pii_type")),
            "column", "left",
        )
    else:
        sig = sig.withColumn("pii_type", F.lit(None).cast("string"))
    n = F.col("n")
    parsed = F.when(n > 0, F.col("n_parsed") / n).otherwise(F.lit(0.0))
    dated = [c for c in columns if has_token(c, *DATE_WORDS)]
    hinted_date = F.col("column").isin(dated) if dated else F.lit(False)
    by_value = (
        F.when(n == 0, "unknown")
        .when(F.col("all_bool"), "boolean")
        .when(F.col("numeric_type"), "numeric")
        .when(F.col("date_type"), "temporal")
        .when(hinted_date & (parsed >= 0.7), "temporal")
        .when(parsed >= 0.9, "temporal")
        .when(F.col("pii_type").isNotNull(), F.col("pii_type"))
        .when((F.col("n_distinct") / n < 0.05) | (F.col("n_distinct") < 20), "categorical")
        .otherwise("text")
    )
    data_type = by_value
    for c in columns:
        hint = (hints or {}).get(c)
        if hint:
            data_type = F.when(F.col("column") == c, F.lit(hinted_type(hint))).otherwise(data_type)
        elif _type_by_name(c):
            data_type = F.when(
                (F.col("column") == c) & (n > 0), F.lit(_type_by_name(c))
            ).otherwise(data_type)
    pipeline = F.lit("hybrid")
    for kind, family in FAMILIES.items():
        pipeline = F.when(F.col("data_type") == kind, F.lit(family)).otherwise(pipeline)
    return sig.withColumn("data_type", data_type).withColumn("pipeline", pipeline)


def columns_of_type(metadata: DataFrame, data_type: str) -> list[str]:
    """Names of the columns with a semantic type (metadata has one row per column)."""
    return [r[0] for r in metadata.filter(F.col("data_type") == data_type).select("column").collect()]


def columns_of_pipeline(metadata: DataFrame, pipeline: str) -> list[str]:
    return [r[0] for r in metadata.filter(F.col("pipeline") == pipeline).select("column").collect()]


def analyze_schema(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    hints: Mapping[str, str] | None = None,
) -> DataFrame:
    """One metadata row per column: type, pipeline, missing share, range, moments, lengths, dates.

    Columns are routed first, so that moments and date spans are computed only where they
    belong. Hinted columns get statistics like all others.
    """
    columns = list(columns or atomic_columns(df))
    types = {f.name: f.dataType for f in df.schema.fields}
    is_text, is_date = F.col("data_type") == "text", F.col("data_type") == "temporal"
    routed = small_copy(route_types(df, columns, hints).select(
        "column", "data_type", "pipeline",
        (F.col("n") < F.col("total_count")).alias("nullable"),
        F.when(F.col("total_count") > 0, 1 - F.col("n") / F.col("total_count"))
        .otherwise(F.lit(0.0)).alias("null_pct"),
        F.col("n_distinct").alias("n_unique"),
        F.when(is_text, F.col("avg_len")).alias("avg_len"),
        F.when(is_text, F.col("max_len")).alias("max_len"),
    ))
    numeric = [c for c in columns if is_numeric(types[c])]
    dated = columns_of_type(routed, "temporal")
    out = routed
    if numeric:
        stats = aggregates.moments(df, numeric).select(
            "column", "min", "max", "mean", "std", F.col("skewness").alias("skew")
        )
        out = out.join(F.broadcast(stats), "column", "left")
    else:
        out = out.withColumns(
            {k: F.lit(None).cast("double") for k in ("min", "max", "mean", "std", "skew")}
        )
    spans = _date_spans(df, [c for c in columns if c in dated])
    if spans is not None:
        return out.join(F.broadcast(spans), "column", "left")
    return out.withColumns({
        "min_ts": F.lit(None).cast("timestamp"), "max_ts": F.lit(None).cast("timestamp"),
        "date_format": F.lit(None).cast("string"),
    })


def _date_spans(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """First and last moment plus layout of date-typed and textual columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = [c for c in columns if isinstance(types[c], T.StringType)]
    chosen = dates.column_layouts(df, texts)
    aggs, structs = [], []
    for i, c in enumerate(columns):
        if isinstance(types[c], T.StringType):
            moment = dates.parse_date(F.col(f"`{c}`"), chosen[c])
            known = chosen[c] in dates.DATE_FORMATS[: dates.ROUTER_FORMATS]
            layout = F.lit(dates.layout_name(chosen[c]) if known else dates.DEFAULT_FORMAT)
        elif is_numeric(types[c]):
            continue
        else:
            moment, layout = F.col(f"`{c}`").cast("timestamp"), F.lit(None).cast("string")
        aggs += [F.min(moment).alias(f"lo{i}"), F.max(moment).alias(f"hi{i}"),
                 layout.alias(f"fmt{i}")]
        structs.append(
            F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("min_ts"),
                     F.col(f"hi{i}").alias("max_ts"), F.col(f"fmt{i}").alias("date_format"))
        )
    return rows_from_wide(df.agg(*aggs), structs) if structs else None
