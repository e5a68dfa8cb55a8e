"""Domain knowledge: constraints, relationships, rules, distributions, anonymization.

Knowledge is given as short Python objects; predicates and formulas are Spark SQL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twintable.functions.draw import Draws, integer_between, pick, pick_weighted
from twintable.functions.numbers import clip, not_nan
from twintable.operators.aggregates import deterministic_mode
from twintable.operators.columns import is_numeric, rows_from_wide


@dataclass(frozen=True)
class Constraint:
    """kind: range, category, pattern, precision, dependency or formula."""

    column: str
    kind: str
    parameters: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    """A predicate all rows should satisfy, or ``when`` that implies ``condition``."""

    rule_id: str
    condition: str
    when: str | None = None
    level: str = "strict"
    description: str = ""

    def violated(self) -> Column:
        """True for rows that break the rule; an undecided predicate breaks nothing."""
        broken = ~F.expr(self.condition)
        if self.when:
            broken = F.expr(self.when) & broken
        return F.coalesce(broken, F.lit(False))


@dataclass(frozen=True)
class Knowledge:
    domain: str = ""
    constraints: Sequence[Constraint] = ()
    relationships: Mapping[str, Sequence[str]] = field(default_factory=dict)
    rules: Sequence[Rule] = ()
    terminology: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def constraints_for(self, column: str) -> list[Constraint]:
        return [c for c in self.constraints if c.column == column]

    def related_to(self, column: str) -> list[str]:
        return list(self.relationships.get(column, ()))

    def terms(self, column: str, category: str | None = None) -> list[str]:
        if category:
            return list(self.terminology.get(f"{column}_{category}", ()))
        return [t for key, values in self.terminology.items() if column in key for t in values]

    @staticmethod
    def from_dict(data: Mapping, domain: str = "") -> Knowledge:
        """From the nested form: constraints {column: [{type, parameters}]}, relationships, terminology."""
        found = [
            Constraint(column, item["type"], item.get("parameters", {}))
            for column, items in (data.get("constraints") or {}).items() for item in items
        ]
        return Knowledge(domain, found, data.get("relationships") or {}, (), data.get("terminology") or {})


def constrain(value: Column, c: Constraint, row_id: Column, seed: int = 42) -> Column:
    """The constrained value; a constraint without its parameters changes nothing."""
    p = c.parameters
    draws = Draws(seed, f"{c.column}|{c.kind}", row_id)
    if c.kind == "range":
        if p.get("min") is None or p.get("max") is None:
            return value
        return clip(value, p["min"], p["max"])
    if c.kind == "category":
        valid = list(p.get("categories", ()))
        if not valid:
            return value
        ok = F.coalesce(value.isin(valid), F.lit(False))
        return F.when(ok, value).otherwise(pick(valid, draws(0)))
    if c.kind == "pattern":
        if not (p.get("pattern") and p.get("null_out")):
            return value
        return F.when(value.cast("string").rlike(_anchored(p["pattern"])), value)
    if c.kind == "precision":
        return F.round(value, int(p.get("decimal_places", 2)))
    if c.kind == "dependency":
        out = value
        for i, (key, rule) in enumerate(p["rules"].items()):
            here = F.col(f"`{p['depends_on']}`").cast("string") == F.lit(str(key))
            if isinstance(rule, Mapping):
                fixed = clip(value, rule.get("min"), rule.get("max"))
            else:
                fixed = F.when(F.coalesce(value.isin(list(rule)), F.lit(False)), value).otherwise(
                    pick(list(rule), draws(i))
                )
            out = F.when(here, fixed).otherwise(out)
        return out
    if c.kind == "formula":
        return F.coalesce(F.expr(p["formula"]), value)
    raise ValueError(f"unknown kind of constraint: {c.kind}")


def _anchored(pattern: str) -> str:
    return f"^(?:{pattern})"


def enforce_constraints(
    df: DataFrame, constraints: Sequence[Constraint], row_id: str, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(constrained rows, report of (column, constraint, modified, violations)).

    Constraints are applied in order, each on what the ones before it left. The report is one
    aggregate over the same expressions.
    """
    used = [c for c in constraints if c.column in df.columns]
    out, traced = df, df
    aggs, structs = [], []
    for i, c in enumerate(used):
        kind = df.schema[c.column].dataType
        old = F.col(f"`{c.column}`")
        new = constrain(old, c, F.col(row_id), seed).cast(kind)
        broken = F.lit(0).cast("long")
        if c.kind == "pattern" and c.parameters.get("pattern"):
            miss = ~old.cast("string").rlike(_anchored(c.parameters["pattern"]))
            traced = traced.withColumn(f"_bad_{i}", F.coalesce(miss, F.lit(False)))
            broken = F.count_if(F.col(f"_bad_{i}"))
        traced = traced.withColumn(f"_old_{i}", old).withColumn(c.column, new)
        traced = traced.withColumn(f"_changed_{i}", ~F.col(f"_old_{i}").eqNullSafe(F.col(f"`{c.column}`")))
        out = out.withColumn(c.column, new)
        modified = F.count_if(F.col(f"_changed_{i}"))
        aggs += [modified.alias(f"m{i}"), broken.alias(f"v{i}")]
        structs.append(F.struct(
            F.lit(c.column).alias("column"), F.lit(c.kind).alias("constraint"),
            F.col(f"m{i}").alias("modified"),
            (F.col(f"v{i}") if c.kind == "pattern" else F.col(f"m{i}")).alias("violations"),
        ))
    if not structs:
        empty = df.sparkSession.createDataFrame(
            [], "column string, constraint string, modified long, violations long"
        )
        return df, empty
    return out, rows_from_wide(traced.agg(*aggs), structs)


def constrained_column(
    df: DataFrame, knowledge: Knowledge, column: str, row_id: str, seed: int = 42
) -> DataFrame:
    """The rows with one column constrained; a column that does not exist is all NULL."""
    base = df if column in df.columns else df.withColumn(column, F.lit(None).cast("double"))
    return enforce_constraints(base, knowledge.constraints_for(column), row_id, seed)[0]


def enforce_relationships(df: DataFrame, relationships: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each dependent column takes its most frequent value within the primary value.

    Modes come from counts, so a hot primary value is combined before it moves. The table of
    modes has one row per primary value; whether it is broadcast is decided by its real size.
    """
    out = df
    for primary, dependents in relationships.items():
        wanted = [c for c in dependents if c in df.columns and c != primary]
        if primary not in df.columns or not wanted:
            continue
        known = out.filter(F.col(f"`{primary}`").isNotNull())
        modes = None
        for i, c in enumerate(wanted):
            one = deterministic_mode(known, c, [primary]).select(
                primary, F.col("mode").alias(f"_mode_{i}")
            )
            modes = one if modes is None else modes.join(one, primary, "full_outer")
        # the table itself is joined once, however many columns depend on it
        out = out.join(modes, primary, "left").withColumns(
            {c: F.coalesce(f"_mode_{i}", F.col(f"`{c}`")) for i, c in enumerate(wanted)}
        ).select(*df.columns)
    return out


def check_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_id, level, rows, violations, compliance_rate, passed): all rules in one scan."""
    aggs = [F.count("*").alias("rows")] + [
        F.count_if(r.violated()).alias(f"v{i}") for i, r in enumerate(rules)
    ]
    structs = [
        F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level"),
            F.col("rows").alias("rows"), F.col(f"v{i}").alias("violations"),
            F.when(F.col("rows") > 0, 1 - F.col(f"v{i}") / F.col("rows")).otherwise(F.lit(1.0))
            .alias("compliance_rate"),
            (F.col(f"v{i}") == 0).alias("passed"),
        )
        for i, r in enumerate(rules)
    ]
    return rows_from_wide(df.agg(*aggs), structs)


def enhance(
    df: DataFrame, knowledge: Knowledge, row_id: str, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Constraints, then relationships; report rows of constraints and of rules."""
    fixed, report = enforce_constraints(df, knowledge.constraints, row_id, seed)
    entries = report.select(
        F.concat_ws(":", "column", "constraint").alias("item"), F.lit("constraint").alias("kind"),
        F.col("violations"),
    )
    if knowledge.rules:
        entries = entries.unionByName(
            check_rules(fixed, knowledge.rules).select(
                F.col("rule_id").alias("item"), F.lit("rule").alias("kind"), "violations"
            )
        )
    return enforce_relationships(fixed, knowledge.relationships), entries


def term_examples(terms: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """n terms of a (key, term) table whose key holds a word, without replacement, seeded."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("key"), F.col("term")))
    return (
        terms.filter(F.contains(F.col("key"), F.lit(key)))
        .withColumn("_mark", mark).orderBy("_mark", "key", "term").limit(n).drop("_mark")
    )


# ------------------------------------------------ declared domain knowledge


def check_balance(
    df: DataFrame, by: Sequence[str], left: str, right: str, tolerance: float = 0.01
) -> DataFrame:
    """Aggregate rule per group: (|left - right| <= tolerance), both Spark SQL aggregates."""
    sides = df.groupBy(*by).agg(F.expr(left).alias("left_value"), F.expr(right).alias("right_value"))
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    return sides.withColumn("passed", gap <= F.lit(float(tolerance)))


@dataclass(frozen=True)
class Band:
    """A labelled value band with its share."""

    label: str
    low: float
    high: float
    share: float


def draw_from_bands(
    bands: Sequence[Band], row_id: Column, seed: int, name: str, whole: bool = False
) -> tuple[Column, Column]:
    """(label, value): a band by its share, then a uniform value inside it."""
    d = Draws(seed, name, row_id)
    weights = [round(b.share * 1_000_000) for b in bands]
    label = pick_weighted([b.label for b in bands], weights, d(0))
    value = F.lit(None).cast("long" if whole else "double")
    for b in bands:
        inside = (
            integer_between(d(1), int(b.low), int(b.high)) if whole
            else F.lit(float(b.low)) + d(1) * F.lit(float(b.high - b.low))
        )
        value = F.when(label == b.label, inside).otherwise(value)
    return label, value


def band_shares(df: DataFrame, column: str, bands: Sequence[Band]) -> DataFrame:
    """(label, expected, observed, gap) of a column against the bands; ends belong to the band."""
    c = F.col(f"`{column}`")
    aggs = [F.count(c).alias("n")] + [
        F.count_if(c.between(b.low, b.high)).alias(f"n{i}") for i, b in enumerate(bands)
    ]
    structs = []
    for i, b in enumerate(bands):
        observed = F.col(f"n{i}") / F.col("n")
        structs.append(F.struct(
            F.lit(b.label).alias("label"), F.lit(float(b.share)).alias("expected"),
            observed.alias("observed"), F.abs(observed - F.lit(float(b.share))).alias("gap"),
        ))
    return rows_from_wide(df.agg(*aggs), structs)


def anonymize(
    df: DataFrame,
    age_columns: Sequence[str] = (),
    date_columns: Sequence[str] = (),
    zip_columns: Sequence[str] = (),
    places: Mapping[str, DataFrame] | None = None,
    oldest: int = 90,
    unlisted: str = "null",
) -> DataFrame:
    """Ages from 90 on become 90, dates their year, zip codes three digits, places their region.

    ``places`` maps a column to a (place, region) table; of a place listed twice the smallest region
    counts. A place that is not listed becomes NULL, or stays as it is with ``unlisted="keep"``.
    """
    changed: dict[str, Column] = {}
    for c in age_columns:
        changed[c] = F.least(F.col(f"`{c}`"), F.lit(oldest).cast(df.schema[c].dataType))
    for c in date_columns:
        changed[c] = F.year(F.col(f"`{c}`"))
    for c in zip_columns:
        changed[c] = F.substring(F.col(f"`{c}`").cast("string"), 1, 3)
    out = df.withColumns(changed) if changed else df
    for c, table in (places or {}).items():
        regions = table.groupBy(F.col("place").alias(c)).agg(F.min("region").alias("_region"))
        region = F.coalesce("_region", F.col(f"`{c}`")) if unlisted == "keep" else F.col("_region")
        out = out.join(regions, c, "left").withColumn(c, region).drop("_region")
    return out.select(*df.columns)


def check_completeness(df: DataFrame, groups: Mapping[str, tuple[Sequence[str], float]]) -> DataFrame:
    """(field_group, completeness, threshold, passed): share of known cells per group of columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs, structs = [F.count("*").alias("rows")], []
    for i, (name, (columns, threshold)) in enumerate(groups.items()):
        known = F.lit(0)
        for c in columns:
            known = known + F.count(not_nan(F.col(f"`{c}`"), types[c]))
        aggs.append(known.alias(f"k{i}"))
        share = F.col(f"k{i}") / (F.col("rows") * F.lit(len(columns)))
        structs.append(F.struct(
            F.lit(name).alias("field_group"), share.alias("completeness"),
            F.lit(float(threshold)).alias("threshold"), (share >= threshold).alias("passed"),
        ))
    return rows_from_wide(df.agg(*aggs), structs)


def seasonal_amounts(
    df: DataFrame, amount: str, day: str, category: str, seasons: Sequence[tuple]
) -> DataFrame:
    """Adds ``seasonal_amount``: the amount times the multiplier of its month and category.

    ``seasons`` holds (months, categories, multiplier); several that fit multiply.
    """
    factor = F.lit(1.0)
    for months, categories, multiplier in seasons:
        fits = F.month(F.col(f"`{day}`")).isin(list(months)) & F.col(f"`{category}`").isin(
            list(categories)
        )
        factor = factor * F.when(fits, F.lit(float(multiplier))).otherwise(F.lit(1.0))
    return df.withColumn("seasonal_amount", F.col(f"`{amount}`") * factor)


# Acceptance limits of a generated table.
ACCEPTANCE = {
    "min_variance": 1e-9,
    "min_unique_ratio": 0.001,
    "max_unique_ratio": 0.999,
    "min_avg_length": 1.0,
}


def acceptance_gate(
    df: DataFrame, columns: Sequence[str] | None = None, limits: Mapping[str, float] | None = None
) -> DataFrame:
    """(column, check, value, limit, passed): variance, distinct share and text length limits.

    One scan for variances and lengths, one shuffle of value counts for the distinct shares.
    """
    from twintable.operators.frequency import frequency_summary, value_frequencies

    limits = ACCEPTANCE | dict(limits or {})
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs, structs = [F.count("*").alias("rows")], []

    def row(column, check, value, limit, passed):
        return F.struct(
            column.alias("column"), F.lit(check).alias("check"), value.alias("value"),
            F.lit(float(limit)).alias("limit"), passed.alias("passed"),
        )

    for i, c in enumerate(columns):
        if is_numeric(types[c]):
            limit = limits["min_variance"]
            aggs.append(F.var_samp(not_nan(F.col(f"`{c}`"), types[c])).alias(f"s{i}"))
            structs.append(row(F.lit(c), "variance", F.col(f"s{i}"), limit, F.col(f"s{i}") >= limit))
        elif isinstance(types[c], T.StringType):
            limit = limits["min_avg_length"]
            aggs.append(F.avg(F.length(F.col(f"`{c}`"))).alias(f"s{i}"))
            structs.append(row(F.lit(c), "avg_length", F.col(f"s{i}"), limit, F.col(f"s{i}") >= limit))
    spread = frequency_summary(value_frequencies(df, columns, keys=True))
    ratio = F.col("n_distinct") / F.col("n_values")
    low, high = limits["min_unique_ratio"], limits["max_unique_ratio"]
    shares = spread.select(F.inline(F.array(
        row(F.col("column"), "min_unique_ratio", ratio, low, ratio >= low),
        row(F.col("column"), "max_unique_ratio", ratio, high, ratio <= high),
    )))
    wide = df.agg(*aggs)
    return rows_from_wide(wide, structs).unionByName(shares) if structs else shares
