"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of characters that are no letters becomes one blank, and
the n-grams of 1 to 4 characters of each word with its blanks are hashed into a fixed number of
buckets. The matrix of log-probabilities (buckets x languages) has a fixed number of rows and is
broadcast; texts are scored in Arrow batches as sparse rows times that matrix, whole texts, a
bounded number of n-grams at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Training rows of each language, on average: all of a smaller one, of a larger one a share by hash of id and
#: text. The fit is on this bounded sample; predictions are for all rows.
ROWS_PER_LANGUAGE = 2000
#: Characters of a text that are taken at a time.
PIECE = 1 << 18
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text with a blank for each run of other characters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    keep = letter_table()[points]
    if not keep.any():
        return points[:0]
    first = np.concatenate(([True], keep[:-1]))
    out = np.where(keep, points, np.uint32(32))[keep | first]
    return np.concatenate((np.array([32], np.uint32), out[int(out[0] == 32):], np.array([32], np.uint32)))


def grams_of(points: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each n-gram; those over a blank within are left out."""
    found = []
    blank = points == 32
    inner = np.concatenate(([0], np.cumsum(blank)))
    h = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x01000193)) ^ (points[n - 1:] * np.uint32(0x9E3779B1))
        # blanks only at the ends: none strictly inside, and not a lone blank
        good = inner[n - 1:n - 1 + m] - inner[1:m + 1] == 0 if n > 2 else ~blank[:m] if n == 1 else np.ones(m, bool)
        mixed = (h + np.uint32(n)) * np.uint32(0x85EBCA6B)
        found.append((mixed[good] >> np.uint32(8)) % np.uint32(buckets))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a long text, cut at blanks, so that no n-gram is lost or doubled."""
    at = 0
    while at < len(points):
        end = at + PIECE
        if end < len(points):
            blanks = np.flatnonzero(points[at + 1:end] == 32)
            if not len(blanks):  # one endless word
                blanks = np.flatnonzero(points[end:] == 32) + end - at - 1
                end = at + 1 + int(blanks[0])
            else:
                end = at + 1 + int(blanks[-1])
        else:
            end = len(points) - 1
        if end <= at:
            break
        yield points[at:end + 1]
        at = end


@dataclass(frozen=True)
class Model:
    """languages: in order; logs: buckets x languages, float32; priors: log shares."""

    languages: tuple[str, ...]
    logs: np.ndarray
    priors: np.ndarray


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id",
        rows_per_language: int = ROWS_PER_LANGUAGE, buckets: int = BUCKETS) -> Model:
    """Counts of the labelled sample, with add-one-half smoothing. Rows without text or label are left out."""
    own = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"),
                      F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h")).dropna(subset=["text", "lang"])
    # a row a language, as the model has a column for each: it is broadcast, so no text is shuffled
    sizes = own.groupBy("lang").agg(F.count("*").alias("rows"))
    sizes = F.broadcast(docs.sparkSession.createDataFrame(sizes.collect(), sizes.schema))
    # a share of each language by hash: no sort, no group in one task, and the same rows each time
    share = F.pmod(F.col("h"), F.lit(1 << 40)) / float(1 << 40)
    sample = own.join(sizes, "lang").filter(share * F.col("rows") < rows_per_language)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for value, label in zip(batch["text"], batch["lang"], strict=True):
                rows[label] = rows.get(label, 0) + 1
                into = totals.setdefault(label, np.zeros(buckets, np.int64))
                for piece in pieces(letters_of(value)):
                    into += np.bincount(grams_of(piece, buckets), minlength=buckets)
        for label, into in totals.items():
            at = np.flatnonzero(into)
            yield pd.DataFrame({"lang": label, "bucket": np.concatenate(([-1], at)),
                                "n": np.concatenate(([rows[label]], into[at]))})

    counts = (sample.select("text", "lang").mapInPandas(count, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    names = tuple(sorted(counts["lang"].unique()))
    table = np.full((buckets, len(names)), 0.5)
    rows = np.ones(len(names))
    for k, name in enumerate(names):
        own_counts = counts[counts["lang"] == name]
        here = own_counts["bucket"].to_numpy()
        n = own_counts["n"].to_numpy()
        table[here[here >= 0], k] += n[here >= 0]
        rows[k] = n[here < 0].sum()
    logs = np.log(table) - np.log(table.sum(axis=0)) if names else table
    return Model(names, logs.astype(np.float32), np.log(rows / rows.sum()) if names else rows)


def posterior(model: Model, text: str | None) -> tuple[str, float]:
    """Most probable language and its probability; the unknown one for a text without letters."""
    if text is None or not model.languages:
        return UNKNOWN, 0.0
    points = letters_of(text)
    if not len(points):
        return UNKNOWN, 0.0
    total = model.priors.copy()
    step = max(1, (1 << 22) // len(model.languages))
    for piece in pieces(points):
        row = np.sort(grams_of(piece, len(model.logs)))  # the sparse row: buckets with their counts
        start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
        n = np.diff(np.concatenate((start, [len(row)])))
        for at in range(0, len(start), step):
            total += n[at:at + step] @ model.logs[row[start[at:at + step]]]
    best = int(np.argmax(total))  # ties: the first by name
    return model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: dict[str, str]) -> DataFrame:
    """The columns of ``keep`` (new name: old name) with ``lang_pred`` and ``score``.

    One row for each input row, repeated ones too. Null texts and texts without a letter (empty
    ones, digits only) get ``und`` with score 0, as do all where nothing could be learned.
    """
    own = docs.select(*[F.col(f"`{old}`").alias(new) for new, old in keep.items()],
                      F.col(f"`{text}`").alias("text_"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        found = [posterior(sent.value, t) for t in texts]
        return pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    return own.withColumn("judged", judge("text_")).select(
        *keep, F.col("judged.lang_pred").alias("lang_pred"), F.col("judged.score").alias("score"))
