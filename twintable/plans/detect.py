"""Personal-data detection over whole columns.

Every detector of every column is a conditional count in one aggregate: one scan, no shuffle
of values, no sampling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintable.functions.numbers import not_nan, plain_text
from twintable.operators.columns import (
    atomic_columns, numeric_columns, rows_from_wide, rows_per_column,
)

# Detector patterns, all anchored.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\+]?[(]?[0-9]{1,4}[)]?[-\s\.]?[(]?[0-9]{1,4}[)]?[-\s\.]?[0-9]{1,9}$",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "credit_card": r"^(?:\d{4}[-\s]?){3}\d{4}$",
    "zip_code": r"^\d{5}(?:-\d{4})?$",
    "ip_address": r"^(?:\d{1,3}\.){3}\d{1,3}$",
    "url": r"^https?://[^\s]+$",
    "identifier": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}
FULL_NAME = r"^[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?$"
TITLED_NAME = r"^(Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z]"
# Common names and address words.
COMMON_FIRST_NAMES = [
    "james", "john", "robert", "michael", "william", "mary", "patricia", "jennifer",
    "linda", "elizabeth", "david", "richard", "joseph", "thomas", "charles",
]
COMMON_LAST_NAMES = [
    "smith", "johnson", "williams", "brown", "jones", "garcia", "miller", "davis",
    "rodriguez", "martinez", "hernandez", "lopez", "gonzalez", "wilson", "anderson",
]
ADDRESS_WORDS = [
    "street", "st", "avenue", "ave", "road", "rd", "drive", "dr",
    "lane", "ln", "boulevard", "blvd", "way", "court", "ct",
]
# Patterns of the type router.
ROUTER_PATTERNS = {
    "pii_email": (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", 0.8),
    "pii_phone": (r"^[\d\s\-\(\)]{10,}$", 0.8),
    "pii_name": (r"^[A-Z][a-z]+(\s[A-Z][a-z]+)+$", 0.6),
}

# Narrow formats first: on equal confidence a card number is not reported as a phone.
PRIORITY = [
    "ssn", "credit_card", "zip_code", "identifier", "ip_address", "url", "email", "phone",
    "name", "address",
]


# A known first word with another word behind it, or a known last word behind another one.
_KNOWN_NAME = (
    rf"(?i)^({'|'.join(COMMON_FIRST_NAMES)})\s+\S|\s({'|'.join(COMMON_LAST_NAMES)})$"
)


def is_person_name(text: Column) -> Column:
    value = F.regexp_replace(text, r"^\s+|\s+$", "")
    # all three have a gap between words
    return text.rlike(r"\S\s+\S") & (value.rlike(FULL_NAME) | value.rlike(_KNOWN_NAME) | value.rlike(TITLED_NAME))


def is_address(text: Column, whole_words: bool = False) -> Column:
    any_word = "|".join(ADDRESS_WORDS)
    pattern = rf"\b({any_word})\b" if whole_words else f"({any_word})"
    return text.rlike(r"\d") & F.lower(text).rlike(pattern)


def detectors(text: Column, whole_words: bool = False) -> dict[str, Column]:
    found = {kind: text.rlike(p) for kind, p in PATTERNS.items()}
    found["name"] = is_person_name(text)
    found["address"] = is_address(text, whole_words)
    return found


def match_counts(
    df: DataFrame, columns: Sequence[str] | None = None, whole_words: bool = False
) -> DataFrame:
    """(column, pii_type, match_count, total_count, match_rate) for every detector."""
    columns = list(columns or atomic_columns(df))
    types = {f.name: f.dataType for f in df.schema.fields}
    per_column = []
    for i, name in enumerate(columns):
        text = plain_text(not_nan(F.col(f"`{name}`"), types[name]), types[name])
        aggs, structs = [F.count(text).alias(f"n{i}")], []
        for kind, hit in detectors(text, whole_words).items():
            aggs.append(F.count_if(hit).alias(f"m{i}_{kind}"))
            structs.append(
                F.struct(
                    F.lit(name).alias("column"), F.lit(kind).alias("pii_type"),
                    F.col(f"m{i}_{kind}").alias("match_count"), F.col(f"n{i}").alias("total_count"),
                )
            )
        per_column.append((aggs, structs))
    return rows_per_column(df, per_column).withColumn(
        "match_rate",
        F.when(F.col("total_count") > 0, F.col("match_count") / F.col("total_count"))
        .otherwise(F.lit(0.0)),
    )


def score_matches(counts: DataFrame) -> DataFrame:
    """Confidence per detection; weak matches are dropped."""
    rate = F.col("match_rate")
    stepped = (
        F.when(rate >= 0.95, 0.95).when(rate >= 0.8, 0.85).when(rate >= 0.6, 0.7)
        .otherwise(rate * 0.8)
    )
    confidence = (
        F.when(F.col("pii_type") == "name", F.least(F.lit(0.9), rate + 0.2))
        .when(F.col("pii_type") == "address", F.least(F.lit(0.85), rate + 0.15))
        .otherwise(stepped)
    )
    loose = F.col("pii_type").isin("name", "address")
    return (
        counts.filter(F.when(loose, rate >= 0.3).otherwise(rate > 0.1))
        .withColumn("confidence", confidence)
        .withColumn("is_likely", (F.col("confidence") >= 0.7) & (rate >= 0.7))
    )


def detect(
    df: DataFrame, columns: Sequence[str] | None = None, whole_words: bool = False
) -> DataFrame:
    """Ranked detections per column: best confidence first, then the narrower format."""
    scored = score_matches(match_counts(df, columns, whole_words))
    order = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("pii_type"))
    # at most one row per detector and column
    w = Window.partitionBy("column").orderBy(F.desc("confidence"), order)
    return scored.withColumn("rank", F.row_number().over(w))


def primary_types(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    whole_words: bool = False,
    include_numeric: bool = False,
) -> DataFrame:
    """(column, pii_type, confidence, match_rate): best likely detection per column.

    Columns of a numeric type are skipped unless asked for: nearly any number looks like a phone.
    """
    columns = list(columns or atomic_columns(df))
    if not include_numeric:
        numeric = set(numeric_columns(df))
        columns = [c for c in columns if c not in numeric]
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, pii_type string, confidence double, match_rate double"
        )
    ranked = detect(df, columns, whole_words).filter("is_likely")
    return ranked.groupBy("column").agg(
        F.min_by("pii_type", "rank").alias("pii_type"),
        F.min_by("confidence", "rank").alias("confidence"),
        F.min_by("match_rate", "rank").alias("match_rate"),
    )


def match_examples(df: DataFrame, column: str, kind: str, k: int = 5) -> DataFrame:
    """The k lowest distinct values that a detector matches."""
    text = F.col(f"`{column}`").cast("string")
    return (
        df.select(text.alias("value"))
        .filter(detectors(F.col("value"))[kind])
        .distinct()
        .orderBy("value")
        .limit(k)
    )


def router_pii(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, pii_email, pii_phone, pii_name, pii_type): rates and choice of the type router."""
    aggs, structs = [], []
    for i, name in enumerate(columns):
        text = F.col(f"`{name}`").cast("string")
        for kind, (pattern, _) in ROUTER_PATTERNS.items():
            aggs.append(F.avg(text.rlike(pattern).cast("double")).alias(f"r{i}_{kind}"))
        structs.append(
            F.struct(F.lit(name).alias("column"),
                     *[F.col(f"r{i}_{k}").alias(k) for k in ROUTER_PATTERNS])
        )
    choice = F.coalesce(
        *[F.when(F.col(k) > limit, F.lit(k)) for k, (_, limit) in ROUTER_PATTERNS.items()]
    )
    return rows_from_wide(df.agg(*aggs), structs).withColumn("pii_type", choice)
