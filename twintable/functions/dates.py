"""Date expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Date layouts tried in this order. The lenient d/M forms also accept
# padded values, so 2023-1-5 and 2023-01-05 both parse.
DATE_FORMATS = [
    "yyyy-M-d",
    "d/M/yyyy",
    "M/d/yyyy",
    "yyyy/M/d",
    "yyyy-M-d H:m:s",
    "d-M-yyyy",
    "M-d-yyyy",
    "yyyyMMdd",
    "d.M.yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
]
# The names under which a layout is reported, same order as above.
FORMAT_NAMES = [
    "%Y-%m-%d",
    "%d/%m/%Y",
    "%m/%d/%Y",
    "%Y/%m/%d",
    "%Y-%m-%d %H:%M:%S",
    "%d-%m-%Y",
    "%m-%d-%Y",
    "%Y%m%d",
    "%d.%m.%Y",
    "%b %d, %Y",
    "%B %d, %Y",
]
# The router only knows the first six layouts.
ROUTER_FORMATS = 6
DEFAULT_FORMAT = "%Y-%m-%d"
OUTPUT_PATTERNS = {
    "%Y-%m-%d": "yyyy-MM-dd",
    "%d/%m/%Y": "dd/MM/yyyy",
    "%m/%d/%Y": "MM/dd/yyyy",
    "%Y/%m/%d": "yyyy/MM/dd",
    "%Y-%m-%d %H:%M:%S": "yyyy-MM-dd HH:mm:ss",
    "%d-%m-%Y": "dd-MM-yyyy",
    "%m-%d-%Y": "MM-dd-yyyy",
    "%Y%m%d": "yyyyMMdd",
    "%d.%m.%Y": "dd.MM.yyyy",
    "%b %d, %Y": "MMM dd, yyyy",
    "%B %d, %Y": "MMMM dd, yyyy",
}


# A cheap pre-filter: text without this outline cannot match any layout above, so the
# parsers (which build an exception per miss) never run on ordinary prose.
_OUTLINE = (
    r"^(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?( ?[AaPp][Mm]| ?Z| ?[+-]\d{2}:?\d{2})?)?|\d{8}"
    r"|\p{L}{3,9} \d{1,2},? \d{4}|\d{1,2} \p{L}{3,9},? \d{4})$"
)
# Layouts that are read, but have no name of their own.
OTHER_FORMATS = [
    "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "M/d/yyyy h:m:s a", "M/d/yyyy h:m a",
    "yyyy-M-d h:m:s a", "yyyy-M-d h:m a",
]


def date_like(c: Column) -> Column:
    """Contains something that looks like a numeric date."""
    return c.rlike(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}")


# What a letter of a layout stands for, where days and months are in range. Others are numbers of any length.
_SHAPES = {"yyyy": r"\d{4}", "M": r"0*([1-9]|1[0-2])", "MMM": r"\p{L}+", "MMMM": r"\p{L}+", "d": r"0*([1-9]|[12]\d|3[01])", "a": "[AP]M"}


def shape(layout: str) -> str:
    """Pattern of the texts that a layout can parse, and few others: the parser builds an exception per miss."""
    if layout == "yyyyMMdd":
        return r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"
    parts = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z]+)", layout)
    return "^" + "".join(re.escape(other) if other else _SHAPES.get(first + more, r"\d+") for first, more, other in parts) + "$"


def _attempt(c: Column, layout: str) -> Column:
    # the parser knows AM and PM in capitals only
    text = F.upper(c) if layout.endswith(" a") else c
    return F.when(text.rlike(shape(layout)), F.try_to_timestamp(text, F.lit(layout)))


def parse_date(c: Column, layout: str | None = None) -> Column:
    """A text as a timestamp; NULL when no layout parses it.

    A column should be read in one ``layout`` (see ``column_layouts``), which is tried before ISO
    8601; without one each value takes the first layout that parses it.
    """
    attempts = [_attempt(c, fmt) for fmt in ([layout] if layout else DATE_FORMATS + OTHER_FORMATS)]
    iso = F.try_to_timestamp(c)
    return F.when(c.rlike(_OUTLINE), F.coalesce(*attempts, iso))


def column_layouts(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The layout that parses most values of each text column, in one pass; ties go by list order."""
    layouts = DATE_FORMATS + OTHER_FORMATS
    if not columns:
        return {}
    found = df.agg(*[
        F.count(F.when(F.col(f"`{c}`").rlike(_OUTLINE), _attempt(F.col(f"`{c}`"), fmt))).alias(f"n_{i}_{j}")
        for i, c in enumerate(columns) for j, fmt in enumerate(layouts)
    ]).first()
    return {
        c: layouts[max(range(len(layouts)), key=lambda j: (found[f"n_{i}_{j}"], -j))]
        for i, c in enumerate(columns)
    }


def layout_name(layout: str) -> str:
    """Name of a layout, or the default one."""
    return dict(zip(DATE_FORMATS, FORMAT_NAMES)).get(layout, DEFAULT_FORMAT)


def date_format_name(c: Column, formats: int = len(DATE_FORMATS)) -> Column:
    """Name of the first layout that parses a value, else the default one."""
    out = F.lit(DEFAULT_FORMAT)
    for fmt, name in reversed(list(zip(DATE_FORMATS[:formats], FORMAT_NAMES[:formats]))):
        out = F.when(F.try_to_timestamp(c, F.lit(fmt)).isNotNull(), F.lit(name)).otherwise(out)
    return F.when(c.rlike(_OUTLINE), out).otherwise(F.lit(DEFAULT_FORMAT))


def to_business_day(d: Column) -> Column:
    """Saturday and Sunday move to the next Monday; the time of day is kept."""
    shift = F.when(F.weekday(d) >= 5, F.lit(7) - F.weekday(d)).otherwise(F.lit(0))
    return d + F.make_dt_interval(shift)


def moment(at: datetime | str) -> Column:
    """A wall-clock time in the session's time zone, whatever zone the driver runs in."""
    return F.lit(at if isinstance(at, str) else at.isoformat(sep=" ")).cast("timestamp")


def add_days(d: Column, days: Column) -> Column:
    return d + F.make_dt_interval(days.cast("int"))
