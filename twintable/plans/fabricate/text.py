"""Text columns: templates, length matching, and a hook for the user's own text source."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintable.functions import text
from twintable.functions.draw import Draws, pick
from twintable.plans.fabricate import lookups

LENGTH_VARIANCE = 0.2


def template_text(
    row_id: Column, seed: int, name: str = "text", category: str = "description",
    templates: Mapping[str, Sequence[str]] | None = None,
    variables: Mapping[str, Sequence[str]] | None = None, method: str = "md5",
) -> Column:
    """A template of the category with its placeholders filled; one draw per placeholder."""
    templates = templates or lookups.TEMPLATES
    variables = variables or lookups.VARIABLES
    chosen = templates.get(category) or next(iter(templates.values()))
    d = Draws(seed, name, row_id, method)
    used = [k for k in variables if any("{" + k + "}" in t for t in chosen)]
    fills = {k: pick(list(variables[k]), d(i + 1)) for i, k in enumerate(used)}
    return text.fill_template(pick(list(chosen), d(0)), fills)


def reference_length(df: DataFrame, column: str) -> float | None:
    """Mean length of the reference texts."""
    return df.agg(F.avg(F.length(F.col(f"`{column}`").cast("string")))).first()[0]


def lengthen(c: Column, target: Column, row_id: Column, seed: int, name: str,
             method: str = "md5") -> Column:
    """Repeat the first sentence behind filler phrases until the target length, then cut.

    Each round draws its own filler; the rounds are as many as the shortest filler may need.
    """
    d = Draws(seed, f"{name}|filler", row_id, method)
    lead = F.concat(F.lit(" "), F.substring_index(c, ".", 1), F.lit("."))
    step = F.length(lead) + min(map(len, lookups.FILLERS))
    rounds = F.greatest(F.ceil((target - F.length(c)) / step).cast("int"), F.lit(1))
    added = F.transform(F.sequence(F.lit(0), rounds - 1), lambda i: F.concat(pick(lookups.FILLERS, d(i)), lead))
    return F.substr(F.concat(c, F.array_join(added, "")), F.lit(1), target)


def match_length(
    c: Column, mean_length: float, row_id: Column, seed: int, name: str,
    variance: float = LENGTH_VARIANCE, method: str = "md5",
) -> Column:
    """Bring a text near mean * (1 +- variance): lengthen below .8 of it, shorten above 1.2."""
    u = Draws(seed, f"{name}|length", row_id, method)(0)
    target = F.floor(
        F.lit(float(mean_length)) * (1 + (u * 2 - 1) * F.lit(float(variance)))
    ).cast("int")
    return (
        F.when(F.length(c) < target * 0.8, lengthen(c, target, row_id, seed, name, method))
        .when(F.length(c) > target * 1.2, text.cut_at_sentence(c, target))
        .otherwise(c)
    )


def add_texts(
    rows: DataFrame, seed: int, columns: Mapping[str, float | None],
    categories: Mapping[str, str] | None = None, method: str = "md5",
) -> DataFrame:
    """Adds text columns, each near the given mean length (or as it comes, without one).

    The template text is a projection of its own: the length rules look at it several times,
    but it is filled once per row.
    """
    row = F.col("row_id")
    out = rows.withColumns({
        c: template_text(row, seed, c, (categories or {}).get(c, "description"), method=method)
        for c in columns
    })
    return out.withColumns({
        c: match_length(F.col(f"`{c}`"), mean, row, seed, c, method=method)
        for c, mean in columns.items() if mean is not None
    })


def with_text_source(
    rows: DataFrame, name: str, source: Callable[[int, int], Sequence[str]], seed: int,
    batch: int = 10,
) -> DataFrame:
    """Adds texts from the user's callable, asked for ``batch`` texts at a time inside the tasks.

    ``source(first_row_id, how_many)`` may return numbered lines or too few; numbers are
    stripped, and template texts fill what is missing. Rows are grouped by their id, so the
    partition layout changes nothing; a source should answer the same question alike.
    """

    @F.pandas_udf("string")
    def fill(row_ids: pd.Series, fallback: pd.Series) -> pd.Series:
        out = fallback.astype("object").copy()
        group = row_ids // batch
        for g in group.unique():
            # a group that two Arrow batches share is asked for twice, with the same answer
            given = [t.strip() for t in (source(int(g) * batch, batch) or []) if t and t.strip()][:batch]
            at = (row_ids - g * batch)[group == g]
            known = at[at < len(given)]
            out[known.index] = [given[i] for i in known]
        return out.str.replace(r"^\d+[.)]\s*", "", regex=True)

    return rows.withColumn(name, fill(F.col("row_id"), template_text(F.col("row_id"), seed, name)))
