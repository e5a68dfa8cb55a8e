"""Cleaning: missing values, outliers, redaction, text."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintable.functions.numbers import not_nan
from twintable.functions.text import normalize_text
from twintable.operators.columns import check_types, redact
from twintable.operators.fill import fill_backward, fill_forward
from twintable.operators.quantiles import clean_number, quantile_values

remove_pii = redact
validate_data_types = check_types


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    out = df
    for c in columns:
        out = out.filter(not_nan(F.col(f"`{c}`"), types[c]).isNotNull())
    return out


def fill_constant(df: DataFrame, columns: Sequence[str], value: Any) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {c: F.coalesce(not_nan(F.col(f"`{c}`"), types[c]), F.lit(value).cast(types[c]))
         for c in columns}
    )


def handle_missing_values(
    df: DataFrame,
    strategy: str = "drop",
    fill_value: Any = None,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
    partition_by: Sequence[str] | None = None,
) -> DataFrame:
    """``drop``, ``fill``, ``forward`` or ``backward``. The last two need the row order named."""
    columns = list(columns or df.columns)
    if strategy == "drop":
        return drop_missing(df, columns)
    if strategy == "fill":
        return fill_constant(df, columns, fill_value)
    if strategy in ("forward", "backward"):
        if not order_by:
            raise ValueError("rows of a distributed table have no order; give order_by")
        fill = fill_forward if strategy == "forward" else fill_backward
        return fill(df, columns, order_by, partition_by)
    raise ValueError(f"Unknown strategy: {strategy}")


def remove_outliers(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 1.5
) -> DataFrame:
    """Drop rows outside the fences, column after column: each sees what the ones before left.

    ``iqr`` also drops missing values, ``zscore`` keeps them.
    """
    out = df
    for name in columns:
        if name not in out.columns:
            continue
        c = clean_number(out, name)
        if method == "iqr":
            q1, q3 = quantile_values(out, [name], [0.25, 0.75])[name]
            if q1 is None:
                out = out.filter(c.isNotNull())
                continue
            fence = threshold * (q3 - q1)
            out = out.filter((c >= q1 - fence) & (c <= q3 + fence))
        elif method == "zscore":
            mean, std = out.agg(F.avg(c), F.stddev_pop(c)).first()
            if mean is None:
                continue
            # a constant column has no defined score and loses its known rows
            near = (F.abs(c - F.lit(mean)) / F.lit(std) < threshold) if std else F.lit(False)
            out = out.filter(c.isNull() | near)
        else:
            raise ValueError(f"Unknown method: {method}")
    return out


def normalize_column(df: DataFrame, column: str, **options) -> DataFrame:
    return df.withColumn(column, normalize_text(F.col(f"`{column}`"), **options))
