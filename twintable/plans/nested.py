"""Nested columns: profiles by path, and look-alike arrays, maps and structs.

The schema is walked into paths: ``a.b`` is a field, ``a[]`` the elements of an array, ``a{key}`` and ``a{value}`` the sides of a
map, to any depth. A path's values in one row are one array expression, so all paths are unnested in a single scan and
partial aggregates travel, a row a path. Fabricated values are drawn from the outside in: the length
of an array from the observed lengths, then each element by its own number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twintable.functions import numbers as num
from twintable.functions.draw import pick_weighted, standard_normal, uniform
from twintable.operators.columns import atomic_columns, is_numeric
from twintable.operators.prefix import draw_order
from twintable.plans.fabricate import text

# Up to this many different lengths or categories of a path become literals.
LITERALS = 256
# Longer texts are told apart by their digest.
KEY_LENGTH = 64


@dataclass(frozen=True)
class Path:
    """``values`` holds all values of a row at this path as an array."""

    name: str
    dtype: T.DataType
    values: Column


def nested_columns(df: DataFrame) -> list[str]:
    """Columns that hold other values."""
    flat = set(atomic_columns(df))
    return [c for c in df.columns if c not in flat]


def walk(name: str, dtype: T.DataType, values: Column) -> Iterator[Path]:
    """A path and all below it. Children of a missing parent are not there, rather than missing."""
    yield Path(name, dtype, values)
    there = F.filter(values, lambda v: v.isNotNull())
    for below, kind, found in _children(name, dtype, there):
        yield from walk(below, kind, found)


def _field(name: str) -> Callable[[Column], Column]:
    return lambda v: v.getField(name)


def _children(name: str, dtype: T.DataType, there: Column) -> list[tuple[str, T.DataType, Column]]:
    if isinstance(dtype, T.StructType):
        return [(f"{name}.{f.name}", f.dataType, F.transform(there, _field(f.name))) for f in dtype.fields]
    if isinstance(dtype, T.ArrayType):
        return [(f"{name}[]", dtype.elementType, F.flatten(there))]
    if isinstance(dtype, T.MapType):
        return [(f"{name}{{key}}", dtype.keyType, F.flatten(F.transform(there, F.map_keys))),
                (f"{name}{{value}}", dtype.valueType, F.flatten(F.transform(there, F.map_values)))]
    return []


def paths_of(df: DataFrame, columns: Sequence[str] | None = None) -> list[Path]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [p for c in (df.columns if columns is None else columns) for p in walk(c, types[c], F.array(F.col(f"`{c}`")))]


def _measures(dtype: T.DataType, v: Column) -> tuple[Column, Column, Column]:
    """Whether a value is there, its number (or length), and what tells values apart as text."""
    none = F.lit(None)
    if isinstance(dtype, T.StructType):
        return v.isNotNull(), none.cast("double"), none.cast("string")
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        size = F.when(v.isNotNull(), F.size(v))
        return v.isNotNull(), size.cast("double"), size.cast("string")
    if is_numeric(dtype):
        number = v.cast("double")
        known = v.isNotNull() & ~F.coalesce(F.isnan(number), F.lit(False))
        return known, F.when(known, number), F.when(known, v.cast("string"))
    shown = v.cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return v.isNotNull(), F.unix_micros(v.cast("timestamp")) / F.lit(1e6), shown
    if isinstance(dtype, T.BooleanType):
        return v.isNotNull(), v.cast("double"), shown
    return v.isNotNull(), F.length(shown).cast("double"), shown


def unnested(df: DataFrame, paths: Sequence[Path]) -> DataFrame:
    """(path, there, number, text): a row for each value at each path."""

    def entries(p: Path) -> Column:
        def entry(v: Column) -> Column:
            there, number, shown = _measures(p.dtype, v)
            return F.struct(F.lit(p.name).alias("path"), there.alias("there"), number.alias("number"), shown.alias("text"))

        return F.transform(p.values, entry)

    return df.select(F.explode(F.concat(*map(entries, paths))).alias("v")).select("v.*")


def profile_nested(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per path: path, type, n_total, n_missing, n_distinct, min, max, mean, std.

    ``n_total`` counts places for a value: rows for a column, elements for ``[]``. The last four are of numbers and seconds as they are,
    of texts and containers by length; structs have none, and no ``n_distinct`` (that of containers counts lengths).
    NaN counts as missing. A path without a place is listed with zeros.
    """
    paths = paths_of(df, columns)
    key = F.when(F.length("text") >= KEY_LENGTH, F.sha2("text", 256)).otherwise(F.col("text"))
    found = unnested(df, paths).groupBy("path").agg(
        F.count("*").alias("n_total"), F.count_if(~F.col("there")).alias("n_missing"), F.count_distinct(key).alias("n_distinct"),
        F.min("number").alias("min"), F.max("number").alias("max"), F.avg("number").alias("mean"), F.stddev_pop("number").alias("std"))
    listed = df.sparkSession.createDataFrame(
        [(i, p.name, p.dtype.simpleString(), isinstance(p.dtype, T.StructType)) for i, p in enumerate(paths)],
        "place int, path string, type string, is_struct boolean")
    counts = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_total", "n_missing")}
    return F.broadcast(listed).join(found, "path", "left").select(
        "path", "type", *counts.values(), F.when(~F.col("is_struct"), F.coalesce("n_distinct", F.lit(0))).alias("n_distinct"),
        "min", "max", "mean", "std")


def value_counts(df: DataFrame, paths: Sequence[Path]) -> dict[str, list[tuple[str, int]]]:
    """Values (or lengths) of paths that have few, with their counts."""
    if not paths:
        return {}
    found: dict[str, list[tuple[str, int]]] = {p.name: [] for p in paths}
    for r in unnested(df, paths).filter("text IS NOT NULL").groupBy("path", "text").count().collect():
        found[r["path"]].append((r["text"], r["count"]))
    return found


@dataclass(frozen=True)
class NestedDraws:
    """Draws by path, row and the element's number: ``7|turns[].role|2.0|41`` for draw 0 of element 2 in row 41."""

    seed: int
    row_id: Column
    method: str
    stats: Mapping[str, Mapping]
    counts: Mapping[str, list[tuple[str, int]]]
    keep_nulls: bool = False

    def uniform(self, path: str, at: Column | None, draw: int | str) -> Column:
        step = F.lit(str(draw)) if at is None else F.concat(at, F.lit(f".{draw}"))
        return uniform(self.seed, path, self.row_id, step, self.method)

    def value(self, path: str, dtype: T.DataType, at: Column | None = None) -> Column:
        s = self.stats[path]
        if s["n_total"] == s["n_missing"]:
            return F.lit(None).cast(dtype)
        drawn = self._drawn(path, dtype, at, s).cast(dtype)
        if self.keep_nulls and s["n_missing"]:
            drawn = F.when(self.uniform(path, at, "null") >= F.lit(s["n_missing"] / s["n_total"]), drawn)
        return drawn

    def _drawn(self, path: str, dtype: T.DataType, at: Column | None, s: Mapping) -> Column:
        if isinstance(dtype, T.StructType):
            return F.struct(*[self.value(f"{path}.{f.name}", f.dataType, at).alias(f.name) for f in dtype.fields])
        if isinstance(dtype, T.ArrayType):
            return self._elements(f"{path}[]", dtype.elementType, self._length(path, at, s), at)
        if isinstance(dtype, T.MapType):
            keys = F.array_distinct(F.filter(
                self._elements(f"{path}{{key}}", dtype.keyType, self._length(path, at, s), at), lambda k: k.isNotNull()))
            return F.map_from_arrays(keys, F.transform(
                keys, lambda _, i: self.value(f"{path}{{value}}", dtype.valueType, self._inner(at, i))))
        if path in self.counts and not is_numeric(dtype):
            ordered = sorted(self.counts[path], key=lambda vn: draw_order(vn[0]))
            return pick_weighted([v for v, _ in ordered], [n for _, n in ordered], self.uniform(path, at, 0))
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            seconds = F.floor(F.lit(s["min"]) + self.uniform(path, at, 0) * F.lit(s["max"] - s["min"]))
            return F.timestamp_seconds(seconds.cast("long"))
        if is_numeric(dtype):
            # twelve digits: sums over another layout differ in the last ones
            mean, std = (float(f"{s[k]:.12g}") for k in ("mean", "std"))
            x = F.lit(mean) + F.lit(std) * standard_normal(self.uniform(path, at, 0), self.uniform(path, at, 1))
            x = num.clip(x, s["min"], s["max"])
            return num.round_half_even(x) if isinstance(dtype, T.IntegralType) else x
        row = self.row_id.cast("string") if at is None else F.concat(self.row_id.cast("string"), F.lit("."), at)
        return text.template_text(row, self.seed, path, method=self.method)

    def _length(self, path: str, at: Column | None, s: Mapping) -> Column:
        u = self.uniform(path, at, "length")
        if path in self.counts:
            ordered = sorted((int(float(v)), n) for v, n in self.counts[path])
            return pick_weighted([v for v, _ in ordered], [n for _, n in ordered], u)
        return (F.lit(int(s["min"])) + F.floor(u * F.lit(float(s["max"] - s["min"] + 1)))).cast("int")

    def _elements(self, path: str, dtype: T.DataType, length: Column, at: Column | None) -> Column:
        # an array of the drawn length to begin with: a sequence down to -1 would not be empty
        places = F.array_repeat(F.lit(0), length)
        return F.transform(places, lambda _, i: self.value(path, dtype, self._inner(at, i)))

    @staticmethod
    def _inner(at: Column | None, i: Column) -> Column:
        return i.cast("string") if at is None else F.concat(at, F.lit("."), i.cast("string"))


def fabricated_nested(
    reference: DataFrame, columns: Sequence[str], row_id: Column, seed: int, method: str = "md5",
    keep_nulls: bool = False,
) -> dict[str, Column]:
    """An expression for each nested column: lengths by their observed frequency, then the elements.

    Numbers are normal within the observed range, texts and booleans with few values follow their frequency, other texts are filled
    templates, moments lie between the first and the last. Values are missing as often as observed with ``keep_nulls``.
    Map keys that are drawn twice count once. A path without a value stays NULL.
    """
    if not columns:
        return {}
    paths = paths_of(reference, columns)
    stats = {r["path"]: r.asDict() for r in profile_nested(reference, columns).collect()}
    few = [p for p in paths if not is_numeric(p.dtype) and not isinstance(p.dtype, T.StructType)
           and 0 < stats[p.name]["n_distinct"] <= LITERALS]
    few = [p for p in few if not isinstance(p.dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    draws = NestedDraws(seed, row_id, method, stats, value_counts(reference, few), keep_nulls)
    types = {f.name: f.dataType for f in reference.schema.fields}
    return {c: draws.value(c, types[c]) for c in columns}
