"""Personal data: names, e-mails, phones, addresses, identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintable.functions import text
from twintable.functions.draw import Draws, integer_between, pick, pick_from, pick_weighted
from twintable.operators.aggregates import deterministic_mode
from twintable.operators.columns import find_column
from twintable.operators.prefix import running_span
from twintable.operators.sets import list_lookup
from twintable.plans.fabricate import lookups

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
DIGITS = "0123456789"
# Genders are drawn as counts out of this many.
GENDER_UNITS = 1_000_000


def gender_draw(u: Column, shares: Mapping[str, float] | None = None) -> Column:
    shares = shares or {"male": 0.5, "female": 0.5}
    return pick_weighted(
        list(shares), [round(v * GENDER_UNITS) for v in shares.values()], u
    )


def _first_pool(locale: str, gender: str) -> list[str]:
    pools = lookups.FIRST_NAMES.get(locale, lookups.FIRST_NAMES[lookups.DEFAULT_LOCALE])
    # a gender without its own pool draws from all names of the locale
    return pools.get(gender) or sorted(set(pools["male"]) | set(pools["female"]))


def name_parts(
    row_id: Column,
    seed: int,
    locale: str | Column = lookups.DEFAULT_LOCALE,
    genders: Mapping[str, float] | None = None,
    gender: str | None = None,
    name: str = "name",
    method: str = "md5",
) -> dict[str, Column]:
    """gender, first, middle, last, title and suffix (one in ten) of a person per row.

    The pools are literal arrays. With a locale column they sit in one constant map.
    """
    d = Draws(seed, name, row_id, method)
    who = F.lit(gender) if gender else gender_draw(d(0), genders)
    kinds = [gender] if gender else list(genders or {"male": 0.5, "female": 0.5})

    def from_pool(pools: dict[str, Sequence[str]], key: Column, draw: int) -> Column:
        values = list_lookup(pools, key)
        fallback = F.array(*map(F.lit, pools[next(iter(pools))]))
        return pick_from(F.coalesce(values, fallback), d(draw))

    if isinstance(locale, Column):
        known = list(lookups.FIRST_NAMES)
        first_pools = {f"{loc}|{g}": _first_pool(loc, g) for loc in known for g in kinds}
        first = from_pool(first_pools, F.concat_ws("|", locale, who), 1)
        last = from_pool({loc: lookups.LAST_NAMES[loc] for loc in known}, locale, 2)
        middle = from_pool({loc: lookups.MIDDLE_NAMES[loc] for loc in known}, locale, 3)
    else:
        place = locale if locale in lookups.FIRST_NAMES else lookups.DEFAULT_LOCALE
        first = F.lit(None).cast("string")
        for g in kinds:
            first = F.when(who == g, pick(_first_pool(place, g), d(1))).otherwise(first)
        last = pick(lookups.LAST_NAMES[place], d(2))
        middle = pick(lookups.MIDDLE_NAMES[place], d(3))
    title = F.when(who == "male", pick(lookups.TITLES["male"], d(4))).otherwise(
        pick(lookups.TITLES["female"], d(4))
    )
    suffix = F.when(d(5) < 0.1, pick(lookups.SUFFIXES, d(6)))
    return {"gender": who, "first": first, "middle": middle, "last": last, "title": title,
            "suffix": suffix}


def full_name(
    parts: Mapping[str, Column], middle: bool = False, title: bool = False, suffix: bool = False
) -> Column:
    """Parts joined by spaces; absent parts leave no gap."""
    order = [
        parts["title"] if title else None, parts["first"], parts["middle"] if middle else None,
        parts["last"], parts["suffix"] if suffix else None,
    ]
    return F.concat_ws(" ", *[p for p in order if p is not None])


def email(
    first: Column, last: Column, row_id: Column, seed: int, name: str = "email",
    domains: Sequence[str] | None = None, method: str = "md5",
) -> Column:
    """One of four styles: first.last, firstlast, first + 1..999, f.last."""
    d = Draws(seed, name, row_id, method)
    f = text.letters_only(first, "user")
    s = text.letters_only(last, "name")
    style = integer_between(d(0), 0, 3)
    # each name is used once, so its clean-up runs once per row
    head = F.substr(f, F.lit(1), F.when(style == 3, F.lit(1)).otherwise(F.lit(1_000_000)))
    dot = F.when(style.isin(0, 3), F.lit(".")).otherwise(F.lit(""))
    tail = F.when(style == 2, integer_between(d(1), 1, 999).cast("string")).otherwise(s)
    local = F.concat(head, dot, tail)
    return F.concat(local, F.lit("@"), pick(domains or lookups.EMAIL_DOMAINS, d(2)))


# Separators of the phone styles (before area, after area, before number).
PHONE_STYLES = {
    "standard": ("", "", ""),
    "dashes": ("", "-", "-"),
    "dots": ("", ".", "."),
    "spaces": ("", " ", " "),
    "parentheses": ("(", ") ", "-"),
}


def phone(
    row_id: Column, seed: int, name: str = "phone", style: str = "dashes", country: str = "US",
    method: str = "md5",
) -> Column:
    """US style: area and exchange 200..999, number 1000..9999. Others: + country code, 9 digits."""
    d = Draws(seed, name, row_id, method)
    if country != "US":
        digits = F.lpad(integer_between(d(1), 0, 999_999_999).cast("string"), 9, "0")
        return F.concat(F.lit("+"), integer_between(d(0), 1, 99).cast("string"), F.lit(" "), digits)
    before, after, inner = PHONE_STYLES.get(style, PHONE_STYLES["dashes"])
    return F.concat(
        F.lit(before), integer_between(d(0), 200, 999).cast("string"), F.lit(after),
        integer_between(d(1), 200, 999).cast("string"), F.lit(inner),
        integer_between(d(2), 1000, 9999).cast("string"),
    )


def address(
    row_id: Column, seed: int, name: str = "address", style: str = "full", method: str = "md5"
) -> Column:
    """``full``, ``street_only`` or ``city_state_zip``."""
    d = Draws(seed, name, row_id, method)
    street = F.concat_ws(
        " ", integer_between(d(0), 1, 9999).cast("string"), pick(lookups.STREET_NAMES, d(1)),
        pick(lookups.STREET_TYPES, d(2)),
    )
    place = F.concat(
        pick(lookups.ADDRESS_CITIES, d(3)), F.lit(", "), pick(lookups.US_STATES, d(4)), F.lit(" "),
        integer_between(d(5), 10000, 99999).cast("string"),
    )
    if style == "street_only":
        return street
    return place if style == "city_state_zip" else F.concat(street, F.lit(", "), place)


def identifier(
    row_id: Column, seed: int, name: str = "id", kind: str = "uuid", prefix: str = "ID",
    length: int = 8, letters: bool = True, method: str = "md5",
) -> Column:
    """``uuid`` (version 4 layout), ``ssn`` (look-alike) or ``custom`` (prefix + random characters)."""
    d = Draws(seed, name, row_id, method)
    if kind == "uuid":
        h = F.md5(F.concat(F.lit(f"{seed}|{name}|uuid|"), row_id.cast("string")))
        variant = pick(["8", "9", "a", "b"], d(0))
        return F.concat(
            F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"),
            F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"),
            F.substring(h, 21, 12),
        )
    if kind == "ssn":
        return F.concat_ws(
            "-", integer_between(d(0), 100, 899).cast("string"),
            integer_between(d(1), 10, 99).cast("string"),
            integer_between(d(2), 1000, 9999).cast("string"),
        )
    pool = ALPHABET if letters else DIGITS
    size = float(len(pool))
    chars = [
        F.substr(F.lit(pool), F.floor(d(i) * F.lit(size)).cast("int") + 1, F.lit(1))
        for i in range(length)
    ]
    return F.concat(F.lit(prefix), *chars)


def vote_locale(reference: DataFrame, default: str = lookups.DEFAULT_LOCALE) -> str | None:
    """Most frequent locale over all rows, by country column or else by city column."""
    country = find_column(reference.columns, "country")
    city = find_column(reference.columns, "city")
    for column, lookup in ((country, lookups.locale_of_country), (city, lookups.locale_of_city)):
        if column:
            c = F.col(f"`{column}`")
            votes = reference.filter(c.isNotNull()).select(lookup(c, default).alias("locale"))
            best = deterministic_mode(votes, "locale").first()
            if best is not None:
                return best["mode"]
    return None


def profile_table(rows: DataFrame, seed: int, method: str = "md5") -> DataFrame:
    """Complete profiles: id, name, email, phone, address per row."""
    r = F.col("row_id")
    parts = name_parts(r, seed, method=method)
    return rows.select(
        "row_id", identifier(r, seed, "id", "custom", method=method).alias("id"),
        full_name(parts).alias("name"),
        email(parts["first"], parts["last"], r, seed, method=method).alias("email"),
        phone(r, seed, method=method).alias("phone"), address(r, seed, method=method).alias("address"),
    )


def make_unique(df: DataFrame, column: str, key: str = "row_id") -> DataFrame:
    """Mark repeated values of a text column by a running number; e-mails keep their domain.

    The number is the position of the row among its equals and stands behind one dash more than
    any value has at that place, so a marked value never meets another one. Positions come from
    a prefix sum over hash buckets, so a value that repeats often is not one task's work.
    """
    value = F.col(f"`{column}`")
    dashes = df.agg(
        F.max(F.length(F.regexp_extract(value, r"(-*)\d*(@|$)", 1)))
    ).first()[0] or 0
    pairs = df.select(value.alias("_value"), F.col(key).alias("_key")).filter(
        F.col("_value").isNotNull()
    )
    repeated = pairs.groupBy("_value").agg(F.count("*").alias("_n")).filter("_n > 1")
    # only repeated values are numbered
    spans = running_span(
        pairs.join(repeated.select("_value"), "_value", "left_semi").withColumn("_one", F.lit(1)),
        "_one", "_key", ["_value"],
    ).select(F.col("_key").alias(key), F.col("span_lo").alias("_nth"))
    mark = F.concat(F.lit("-" * (dashes + 1)), F.col("_nth").cast("string"))
    at = F.instr(value, "@")
    renamed = F.when(
        at > 0, F.concat(F.substr(value, F.lit(1), at - 1), mark, F.substr(value, at))
    ).otherwise(F.concat(value, mark))
    return df.join(spans, key, "left").withColumn(
        column, F.when(F.col("_nth") > 0, renamed).otherwise(value)
    ).select(*df.columns)
