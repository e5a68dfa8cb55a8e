"""Text expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \w is ASCII only; this class also covers accented letters and agrees with RE2.
TOKEN = r"[\p{L}\p{N}_]+"


def normalize_text(
    c: Column,
    lowercase: bool = True,
    remove_punctuation: bool = False,
    remove_extra_spaces: bool = True,
) -> Column:
    out = c
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = F.regexp_replace(out, r"[\p{Punct}]", "")
    if remove_extra_spaces:
        out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return out


def shape_pattern(c: Column) -> Column:
    """Letters to a/A and digits to 9; one native pass over the string.

    ``translate`` is a character table lookup, far cheaper than three regex passes.
    """
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    return F.translate(c, lower + upper + digits, "a" * 26 + "A" * 26 + "9" * 10)


def words(c: Column) -> Column:
    """White-space separated words; an empty text has none."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def first_name(full_name: Column, default: str = "User") -> Column:
    return F.coalesce(F.get(words(full_name), F.lit(0)), F.lit(default))


def last_name(full_name: Column, default: str = "Name") -> Column:
    w = words(full_name)
    return F.when(F.size(w) >= 2, F.element_at(w, -1)).otherwise(F.lit(default))


def letters_only(c: Column, default: str = "user") -> Column:
    """Lower-case letters of a name, for e-mail local parts."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}]", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def email_domain(c: Column, default: str = "test.com") -> Column:
    parts = F.split(c, "@")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.lit(default))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def strip_numbering(c: Column) -> Column:
    return F.regexp_replace(c, r"^\d+[.)]\s*", "")


def style_features(c: Column) -> dict[str, Column]:
    """Per-text style measures, keyed by name."""
    w = words(c)
    total = F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    cased = F.upper(c) != F.lower(c)
    return {
        "n_chars": F.length(c).cast("long"),
        "n_words": F.size(w).cast("long"),
        "avg_word_length": F.when(F.size(w) > 0, total / F.size(w)).otherwise(F.lit(0.0)),
        "has_punctuation": c.rlike(r"[.,!?;:]"),
        "has_numbers": c.rlike(r"\d"),
        "is_uppercase": (F.upper(c) == c) & cased,
        "is_lowercase": (F.lower(c) == c) & cased,
        "capitalized_words": F.regexp_count(c, F.lit(r"(^|\s)\p{Lu}")).cast("long"),
    }


def fill_template(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace each ``{name}`` by its value."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def cut_at_sentence(c: Column, limit: Column) -> Column:
    """Keep the leading sentences whose summed length stays under ``limit``.

    Full stops do not count towards the first comparison of each sentence; when the kept part
    still exceeds the limit the text is cut at the last word that fits and gets an ellipsis.
    """
    sentences = F.split(c, r"\.")
    state = F.aggregate(
        sentences,
        F.struct(F.lit("").alias("kept"), F.lit(True).alias("open")),
        lambda acc, s: F.when(
            acc["open"] & (F.length(acc["kept"]) + F.length(s) < limit),
            F.struct(F.concat(acc["kept"], s, F.lit(".")).alias("kept"), F.lit(True).alias("open")),
        ).otherwise(F.struct(acc["kept"].alias("kept"), F.lit(False).alias("open"))),
    )
    kept = state["kept"]
    head = F.substr(c, F.lit(1), limit)
    by_word = F.concat(F.regexp_replace(head, r"(?s) [^ ]*$", ""), F.lit("..."))
    return (
        F.when(F.length(c) <= limit, c)
        .when(F.length(kept) > limit, by_word)
        .otherwise(kept)
    )
