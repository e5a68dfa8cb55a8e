"""Column selection, naming and type checks. Nothing here touches rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Select the requested columns that exist, in the requested order."""
    return df.select(*[c for c in columns if c in df.columns])


def restore_order(df: DataFrame, original: Sequence[str]) -> DataFrame:
    """Original columns first in their order, extra ones last."""
    known = [c for c in original if c in df.columns]
    extra = [c for c in df.columns if c not in set(original)]
    return df.select(*known, *extra)


def name_tokens(column: str) -> list[str]:
    """Words of a column name, split at separators and camel case: ``userID`` -> user, id."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", column)
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", spaced)
    return [w.lower() for w in re.split(r"[^A-Za-z0-9]+", spaced) if w]


def has_token(column: str, *wanted: str) -> bool:
    """True when a wanted word or word sequence (``sl no``) occurs at word boundaries."""
    tokens = name_tokens(column)
    for want in wanted:
        seq = name_tokens(want)
        if any(tokens[i : i + len(seq)] == seq for i in range(len(tokens) - len(seq) + 1)):
            return True
        # 'firstname', 'slno': run-together spelling of a multi-word token
        if len(seq) > 1 and "".join(seq) in tokens:
            return True
    return False


def find_columns(columns: Iterable[str], *tokens: str) -> list[str]:
    return [c for c in columns if has_token(c, *tokens)]


def find_column(columns: Iterable[str], *tokens: str) -> str | None:
    return next(iter(find_columns(columns, *tokens)), None)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def temporal_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def atomic_columns(df: DataFrame) -> list[str]:
    """Columns that can be compared and grouped as one value."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


# Accepted physical types per expected type word.
TYPE_WORDS = {
    "int": ("bigint", "int", "smallint", "tinyint"),
    "float": ("double", "float"),
    "string": ("string",),
    "datetime": ("timestamp", "timestamp_ntz", "date"),
    "bool": ("boolean",),
}


def check_types(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One row per violated expectation: (column, expected, actual, error)."""
    actual = dict(df.dtypes)
    rows = []
    for column, want in expected.items():
        if column not in actual:
            rows.append((column, want, None, f"Missing column: {column}"))
        elif want in TYPE_WORDS and actual[column] not in TYPE_WORDS[want]:
            rows.append(
                (column, want, actual[column],
                 f"Column {column}: expected {want}, got {actual[column]}")
            )
    schema = "column string, expected string, actual string, error string"
    return df.sparkSession.createDataFrame(rows, schema)


def rows_from_wide(wide: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn the single row of a wide aggregate into one row per struct."""
    return wide.select(F.inline(F.array(*structs)))


COLUMNS_PER_SCAN = 40


def rows_per_column(
    df: DataFrame, parts: Sequence[tuple[Sequence[Column], Sequence[Column]]],
    shared: Sequence[Column] = (),
) -> DataFrame:
    """Report rows from (aggregates, structs) of each column, plus aggregates all may use.

    Up to COLUMNS_PER_SCAN columns share a scan. Wider tables take several: each reads only its
    own columns, and no single aggregate grows beyond what generated code can hold.
    """
    out = None
    for start in range(0, max(len(parts), 1), COLUMNS_PER_SCAN):
        chunk = parts[start : start + COLUMNS_PER_SCAN]
        wide = df.agg(*shared, *[a for aggs, _ in chunk for a in aggs])
        rows = rows_from_wide(wide, [s for _, structs in chunk for s in structs])
        out = rows if out is None else out.unionByName(rows)
    return out


def redact(df: DataFrame, columns: Iterable[str], replacement: str = "[REDACTED]") -> DataFrame:
    """Overwrite columns by a constant; missing columns are skipped."""
    hidden = {c for c in columns if c in df.columns}
    return df.withColumns({c: F.lit(replacement) for c in hidden}) if hidden else df


def merge_single_rows(*frames: DataFrame) -> DataFrame:
    """One row out of several one-row frames with different columns, without any join."""
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def small_copy(df: DataFrame) -> DataFrame:
    """Run a report whose size is a few rows per column once, and keep its rows as a local table."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
