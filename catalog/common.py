"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns; sums in another order differ in the last bits."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def u_sql(seed: int, name: str, row: str, draw: int | str = 0) -> str:
    """SQL of the seeded uniform draw."""
    key = f"'{seed}|{name}|' || CAST({draw} AS VARCHAR) || '|' || CAST({row} AS VARCHAR)"
    return f"(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) / 4503599627370496.0)"


def list_sql(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def pick_sql(values, u: str) -> str:
    return f"({list_sql(values)})[1 + CAST(floor({u} * {float(len(values))}) AS INT)]"


def between_sql(u: str, low: int, high: int) -> str:
    return f"({low} + CAST(floor({u} * {float(high - low + 1)}) AS BIGINT))"
