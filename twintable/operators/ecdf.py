"""Distribution distances from empirical distribution functions (Kolmogorov-Smirnov).

A running count over all values would be one task. Instead the value range of every column
is cut at sketch quantiles; counts per bucket give the distribution functions at all bucket
edges and an upper bound of the distance inside each bucket. Only buckets that could beat
the best edge stay open. An open bucket with many rows is cut again at its own sketch quantiles,
round by round, until every open one is small or holds a single value; the small ones are looked
into value by value, each in its own window partition. So the result is exact, no window holds
more than ``ROWS_PER_BUCKET`` rows, and the number of buckets has no fixed top.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintable.operators.columns import small_copy
from twintable.operators.quantiles import clean_number
from twintable.session import durable

ROWS_PER_BUCKET = 200_000
MIN_BUCKETS, MAX_BUCKETS = 16, 8192
# First-round bucket counts of all columns together pass through the driver; this bounds their number.
MAX_COUNTS = 200_000
#: Sketch quantiles at which an open bucket is cut in each further round.
CUTS = 16
#: Open buckets up to which their list is broadcast; a longer one is joined by its key.
BROADCAST_BUCKETS = 100_000

PLACE = ["column", "parent", "part", "bucket"]


def _cuts(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Sketch quantiles per column, as many as the row count asks for (bounded)."""
    rows = df.count()
    most = min(MAX_BUCKETS, MAX_COUNTS // len(columns))
    n = max(MIN_BUCKETS, min(most, rows // ROWS_PER_BUCKET))
    probs = [i / n for i in range(1, n)]
    # the sketch size is the accuracy; two ranks per bucket are plenty for balance
    accuracy = max(1000, 4 * n)
    found = df.agg(
        *[F.percentile_approx(c, probs, accuracy).alias(f"q{i}") for i, c in enumerate(columns)]
    ).first()
    # infinite values lie in the outer buckets anyway
    return {c: sorted({x for x in found[i] or [] if math.isfinite(x)} or {0.0}) for i, c in enumerate(columns)}


def _bucketed(df: DataFrame, columns: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """(column, parent, part, bucket, value, measures) rows; NULL and NaN are dropped."""
    cuts = _cuts(df, columns)
    cells = [f"cell_{i}" for i in range(len(columns))]
    cut = Bucketizer(
        inputCols=list(columns),
        outputCols=cells,
        splitsArray=[[-math.inf, *cuts[c], math.inf] for c in columns],
        handleInvalid="keep",
    ).transform(df)
    structs = [
        F.struct(F.lit(c).alias("column"), F.lit("").alias("parent"), F.col(b).cast("int").alias("part"),
                 F.col(b).cast("int").cast("string").alias("bucket"), F.col(c).alias("value"))
        for c, b in zip(columns, cells)
    ]
    return (
        cut.select(*[m.alias(name) for name, m in measures.items()], F.explode(F.array(*structs)).alias("row"))
        .select("row.*", *measures)
        .filter(F.col("value").isNotNull())
    )


def _counts(rows: DataFrame, measures: Sequence[str]) -> DataFrame:
    return rows.groupBy(*PLACE).agg(
        *[F.sum(m).alias(m) for m in measures], F.count("*").alias("held"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"),
    )


def _with_edges(counts: DataFrame, measures: Sequence[str], parents: DataFrame | None = None) -> DataFrame:
    """Running totals before and after each bucket plus the column total.

    In the first round a window holds the buckets of a column, later the few parts of one bucket,
    whose totals go on from those before it.
    """
    before = Window.partitionBy("column", "parent").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.partitionBy("column", "parent")
    if parents is not None:
        counts = counts.join(_by_size(parents.select(
            "column", F.col("bucket").alias("parent"),
            *[F.col(f"{m}_lo").alias(f"{m}_from") for m in measures], *[f"{m}_n" for m in measures],
        )), ["column", "parent"])
    added = {}
    for m in measures:
        lo = F.coalesce(F.sum(m).over(before), F.lit(0))
        if parents is None:
            added[f"{m}_n"] = F.sum(m).over(everything)
        else:
            lo = lo + F.col(f"{m}_from")
        added[f"{m}_lo"] = lo
        added[f"{m}_hi"] = lo + F.col(m)
    return counts.withColumns(added)


def _by_size(buckets: DataFrame) -> DataFrame:
    return F.broadcast(buckets) if buckets.count() <= BROADCAST_BUCKETS else buckets


def _cut_again(rows: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of large buckets in parts of their own: below, at and above each of some values of theirs.

    A cut is a value of the bucket and has a part to itself, so a bucket of two values or more
    always falls apart, however heavy one of them is.
    """
    own = rows.join(_by_size(large.select("column", "bucket")), ["column", "bucket"])
    probs = [i / CUTS for i in range(1, CUTS)]
    cuts = durable(own.groupBy("column", "bucket").agg(
        F.array_distinct(F.percentile_approx("value", probs, 1000)).alias("cuts")
    ))
    value = F.col("value")
    part = F.size(F.filter("cuts", lambda c: c < value)) + F.size(F.filter("cuts", lambda c: c <= value))
    return own.join(_by_size(cuts), ["column", "bucket"]).withColumns({
        "parent": F.col("bucket"), "part": part,
        "bucket": F.concat_ws(".", "bucket", part.cast("string")),
    }).drop("cuts")


def _best(edges: DataFrame, families: Sequence[str]) -> DataFrame:
    return edges.groupBy("column").agg(*[F.max(f"edge_{k}").alias(f"best_{k}") for k in families])


def _still_open(edges: DataFrame, best: DataFrame, families: Sequence[str]) -> DataFrame:
    """Buckets that may hold a larger distance than the best one known. A single value shows its own at its edge."""
    worth = F.lit(False)
    for k in families:
        worth = worth | F.coalesce(F.col(f"bound_{k}") > F.col(f"best_{k}"), F.lit(False))
    names = edges.columns
    # a row per column
    return edges.join(F.broadcast(best), "column").filter(worth & (F.col("lowest") < F.col("highest"))).select(*names)


def _narrowed_down(
    rows: DataFrame, edges: DataFrame, measures: Sequence[str], families: Sequence[str],
    place: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Best distance at an edge by column, and pairs of rows and the small open buckets to look into.

    ``edges`` are first-round buckets with their distance (edge) and its bound by family, as ``place`` gives them.
    Each round handles only the rows of the open buckets that are still too large.
    """
    cells = edges.collect()  # at most MAX_COUNTS, a local table
    if all(r["held"] <= ROWS_PER_BUCKET for r in cells):
        best = _best(edges, families)
        return best, [(rows, F.broadcast(_still_open(edges, best, families)))]
    best = small_copy(_best(edges, families))
    found = []
    while True:
        todo = _still_open(edges, best, families)
        found.append((rows, todo.filter(F.col("held") <= ROWS_PER_BUCKET)))
        large = todo.filter(F.col("held") > ROWS_PER_BUCKET)
        if large.isEmpty():
            break
        large = durable(large)
        rows = durable(_cut_again(rows, large))
        edges = durable(place(_with_edges(_counts(rows, measures), measures, large)))
        # a row per column
        best = small_copy(best.union(_best(edges, families)).groupBy("column").agg(
            *[F.max(f"best_{k}").alias(f"best_{k}") for k in families]
        ))
    # what was found later may close buckets that were open before
    return best, [(r, _by_size(_still_open(todo, best, families))) for r, todo in found]


def _steps(found: Sequence[tuple[DataFrame, DataFrame]], measures: Sequence[str]) -> DataFrame:
    """Distinct values of small buckets, with the totals up to and before each."""
    edges = [f"{m}_{end}" for m in measures for end in ("lo", "n")]
    parts = [
        rows.select("column", "bucket", "value", *measures)
        .join(todo.select("column", "bucket", *edges), ["column", "bucket"])
        for rows, todo in found
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    values = every.groupBy("column", "bucket", "value", *edges).agg(*[F.sum(m).alias(m) for m in measures])
    w = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return values.withColumns({f"{m}_upto": F.col(f"{m}_lo") + F.sum(m).over(w) for m in measures})


def two_sample_ks(reference: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_ref, n_syn, ks): exact two-sample statistic for every numeric column."""
    names = [f"v{i}" for i in range(len(columns))]
    both = reference.select(
        F.lit(1).alias("is_ref"), *[clean_number(reference, c).alias(v) for c, v in zip(columns, names)]
    ).unionByName(
        synthetic.select(
            F.lit(0).alias("is_ref"),
            *[clean_number(synthetic, c).alias(v) for c, v in zip(columns, names)],
        )
    )
    measures = {"ref": F.col("is_ref"), "syn": 1 - F.col("is_ref")}
    rows = _bucketed(both, names, measures)

    def place(edges: DataFrame) -> DataFrame:
        f_lo, f_hi = F.col("ref_lo") / F.col("ref_n"), F.col("ref_hi") / F.col("ref_n")
        g_lo, g_hi = F.col("syn_lo") / F.col("syn_n"), F.col("syn_hi") / F.col("syn_n")
        return edges.filter((F.col("ref_n") > 0) & (F.col("syn_n") > 0)).select(
            "*", F.abs(f_hi - g_hi).alias("edge_ks"),
            F.greatest(f_hi - g_lo, g_hi - f_lo).alias("bound_ks"),
        )

    # a bounded table of counts: taken once, so that the scan behind it is not repeated
    edges = small_copy(place(_with_edges(_counts(rows, list(measures)), list(measures))))
    best, found = _narrowed_down(rows, edges, list(measures), ["ks"], place)
    gap = F.abs(F.col("ref_upto") / F.col("ref_n") - F.col("syn_upto") / F.col("syn_n"))
    inner = _steps(found, list(measures)).groupBy("column").agg(F.max(gap).alias("best_inner"))
    sizes = edges.groupBy("column").agg(F.first("ref_n").alias("n_ref"), F.first("syn_n").alias("n_syn"))
    label = _labels(names, columns)
    # a row per column each
    return (
        best.join(F.broadcast(sizes), "column").join(F.broadcast(inner), "column", "left")
        .select(
            label[F.col("column")].alias("column"), "n_ref", "n_syn",
            F.greatest("best_ks", F.coalesce("best_inner", F.lit(0.0))).alias("ks"),
        )
    )


def _labels(names: Sequence[str], columns: Sequence[str]) -> Column:
    pairs = [F.lit(x) for pair in zip(names, columns) for x in pair]
    return F.create_map(*pairs)


def one_sample_ks(
    df: DataFrame, columns: Sequence[str], parameters: DataFrame, cdfs: dict[str, Column]
) -> DataFrame:
    """(column, family, n, ks): distance of columns from several distribution functions at once.

    ``parameters`` has one row per column; ``cdfs`` are expressions over ``value`` and the
    parameter columns. At its lowest and highest value a bucket shows a distance each family
    has at least, and by monotony one that no value inside can exceed; only buckets that could
    raise some family's distance are looked into.
    """
    names = [f"v{i}" for i in range(len(columns))]
    label = _labels(names, columns)
    data = df.select(*[clean_number(df, c).alias(v) for c, v in zip(columns, names)])
    rows = _bucketed(data, names, {"obs": F.lit(1)}).withColumn("column", label[F.col("column")])

    def place(edges: DataFrame) -> DataFrame:
        placed = edges.join(F.broadcast(parameters), "column")
        for at, prefix in (("lowest", "low"), ("highest", "high")):
            placed = placed.withColumn("value", F.col(at)).withColumns(
                {f"{prefix}_{k}": c for k, c in cdfs.items()}
            ).drop("value")
        f_lo, f_hi = F.col("obs_lo") / F.col("obs_n"), F.col("obs_hi") / F.col("obs_n")
        return placed.select(
            "column", "bucket", "obs_lo", "obs_n", "held", "lowest", "highest",
            *[F.greatest(f_hi - F.col(f"high_{k}"), F.col(f"low_{k}") - f_lo).alias(f"edge_{k}")
              for k in cdfs],
            *[F.greatest(f_hi - F.col(f"low_{k}"), F.col(f"high_{k}") - f_lo).alias(f"bound_{k}")
              for k in cdfs],
        )

    counts = small_copy(_counts(rows, ["obs"]))
    edges = _with_edges(counts, ["obs"])
    sizes = edges.groupBy("column").agg(F.first("obs_n").alias("total_obs"))
    if counts.count() <= MIN_BUCKETS * len(columns) and counts.filter(F.col("held") > ROWS_PER_BUCKET).isEmpty():
        # little data: looking into all buckets is cheaper than ruling some out
        best = sizes.select("column", *[F.lit(None).cast("double").alias(f"best_{k}") for k in cdfs])
        found = [(rows, F.broadcast(edges))]
    else:
        best, found = _narrowed_down(rows, small_copy(place(edges)), ["obs"], list(cdfs), place)
    steps = (
        _steps(found, ["obs"]).select(
            "column", "value", (F.col("obs_upto") / F.col("obs_n")).alias("f_at"),
            ((F.col("obs_upto") - F.col("obs")) / F.col("obs_n")).alias("f_before"),
        )
        .join(F.broadcast(parameters), "column")
        .withColumns({f"cdf_{k}": c for k, c in cdfs.items()})
    )
    inner = steps.groupBy("column").agg(*[
        F.max(F.greatest(F.col("f_at") - F.col(f"cdf_{k}"), F.col(f"cdf_{k}") - F.col("f_before")))
        .alias(f"inner_{k}")
        for k in cdfs
    ])
    structs = [
        F.struct(F.lit(k).alias("family"), F.col("total_obs").alias("n"),
                 F.greatest(f"best_{k}", f"inner_{k}").alias("ks"))
        for k in cdfs
    ]
    # a row per column each
    return sizes.join(F.broadcast(best), "column").join(F.broadcast(inner), "column", "left").select(
        "column", F.inline(F.array(*structs))
    )
