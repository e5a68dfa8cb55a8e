"""Passages of documents that can hold a repeated window, gathered where equal windows meet.

A window is a fixed number of consecutive units (bytes, or hashes of words) of one document. The
smallest hash of the k-grams in it (its minimizer) depends on the window alone, so equal windows
have equal minimizers. Consecutive windows with the same leftmost minimizer form a run; a run whose minimizer
no other run has holds no repeated window and is left out. This loses none. Runs with a minimizer that very
many share are thinned out window by window, by counts of the windows' own hashes. What is left goes, with its
text, to the task of its minimizer, one row for each batch and distinct text.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintable.llm import tally
from twintable.llm.base import gram_hashes, numbered, release_memory, sliding_min

#: Windows of a document that are hashed at a time.
CHUNK = 1 << 19
#: From so many runs on, a minimizer's windows are counted one by one.
HOT = 32

#: Windows from which on a passage of joined runs is cut.
LONGEST = 1 << 17

#: Bytes of distinct passages that are sorted at once, but for a minimizer that has more.
SHARD_BYTES = 2 << 20

PASSAGES = "minimizer long, passage binary, windows int, batch long, places binary"


@dataclass(frozen=True)
class Kind:
    """units: an array for each text; dtype: of a unit; window and gram: units in a window and in a k-gram."""

    units: Callable[[Iterable[str | None]], Iterator[np.ndarray]]
    dtype: type
    window: int
    gram: int


def runs(units: np.ndarray, kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, windows, minimizer) of the runs, a chunk of the document at a time."""
    for at in range(0, len(units) - kind.window + 1, CHUNK):
        some = units[at:at + CHUNK + kind.window - 1]
        grams = gram_hashes(some, kind.gram)
        low = sliding_min(grams, kind.window - kind.gram + 1)
        edge = np.flatnonzero((low[1:] != low[:-1]) | (grams[:len(low) - 1] == low[:-1])) + 1
        start = np.concatenate(([0], edge))
        yield start + at, np.diff(np.append(start, len(low))), low[start]


def joined(start: np.ndarray, size: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that follow each other with equal minimizers as one, up to ``LONGEST`` windows: in a stretch of one
    byte each window is a run, and all but the last of the joined ones are the same passage."""
    if not len(start):
        return start, size, low
    new = np.concatenate(([True], (start[1:] != start[:-1] + size[:-1]) | (low[1:] != low[:-1])))
    begin = start[np.flatnonzero(new)][np.cumsum(new) - 1]
    part = (start - begin) // LONGEST
    new[1:] |= part[1:] != part[:-1]
    first = np.flatnonzero(new)
    return start[first], np.add.reduceat(size, first), low[first]


def all_runs(units: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = list(runs(units, kind))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def window_hashes(units: np.ndarray, start: np.ndarray, size: np.ndarray, kind: Kind) -> np.ndarray:
    """Hashes of the windows of some runs, one after the other."""
    out, ends = [], start + size
    i = 0
    while i < len(start):  # runs that lie close together share one pass
        j = int(np.searchsorted(ends, start[i] + CHUNK, "right"))
        j = max(j, i + 1)
        base = start[i]
        h = gram_hashes(units[base:ends[j - 1] + kind.window - 1], kind.window)
        n = size[i:j]
        index = np.repeat(start[i:j] - base - np.cumsum(n) + n, n) + np.arange(n.sum())
        out.append(h[index])
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def passages(batches: DataFrame, kind: Kind, total: int) -> DataFrame:
    """Candidate passages of a table of batch, rid, key, text (see ``PASSAGES``)."""
    buckets = tally.buckets_for(total)

    def minimizers(rows: pd.DataFrame) -> Iterator[np.ndarray]:
        for units in kind.units(rows["text"]):
            yield all_runs(units, kind)[2]

    def candidates(rows: pd.DataFrame, answers: pd.DataFrame) -> Iterator[tuple]:
        """Units and repeated runs of each document, and which of them are hot."""
        units = list(kind.units(rows["text"]))
        found = [all_runs(u, kind) for u in units]
        counts = tally.answer(np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.uint64), answers)
        at = 0
        for u, (start, size, low) in zip(units, found, strict=True):
            n = counts[at:at + len(low)]
            at += len(low)
            keep = n >= 2
            yield u, start[keep], size[keep], low[keep], n[keep] >= HOT

    def hot_windows(found: Iterable[tuple]) -> Iterator[np.ndarray]:
        for units, start, size, _, hot in found:
            if hot.any():
                yield window_hashes(units, start[hot], size[hot], kind)

    def ask_again(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return tally.question(0, np.zeros(0, np.uint64), buckets)
        parts = list(hot_windows(candidates(rows, answers)))
        return tally.question(rows["batch"].iloc[0], np.concatenate(parts) if parts else np.zeros(0, np.uint64), buckets)

    def gather(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in PASSAGES.split(", ")]
        if not len(rows):
            return pd.DataFrame(columns=names)
        first, second = answers[answers["kind"] == 1], answers[answers["kind"] == 2]
        counts = None
        release_memory()
        known: dict[tuple[int, bytes], bytearray] = {}
        width, more, pack = np.dtype(kind.dtype).itemsize, kind.window - 1, struct.Struct("<4q").pack
        found = list(candidates(rows, first))
        if len(second):
            parts = list(hot_windows(found))
            counts = tally.answer(np.concatenate(parts), second)
        used = 0
        for (units, start, size, low, hot), rid, key in zip(found, rows["rid"], rows["key"], strict=True):
            place = (rid, 0, 1) if pd.isna(key) else (rid, int(key), 0)
            if hot.any():
                n = int(size[hot].sum())
                good = counts[used:used + n] >= 2
                used += n
                start, size, low = split_runs(start, size, low, hot, good)
            start, size, low = joined(start, size, low)
            raw = units.tobytes()
            for a, n, m in zip(start.tolist(), size.tolist(), low.tolist(), strict=True):
                passage = m, raw[a * width:(a + n + more) * width]
                known.setdefault(passage, bytearray()).extend(pack(*place, a))
        batch = rows["batch"].iloc[0]
        return pd.DataFrame({
            "minimizer": np.array([m for m, _ in known], np.uint64).view(np.int64),
            "passage": [p for _, p in known],
            "windows": np.array([len(p) // width - kind.window + 1 for _, p in known], np.int32),
            "batch": np.full(len(known), batch, np.int64),
            "places": [bytes(p) for p in known.values()]}, columns=names)

    first = tally.totals(tally.ask(batches, minimizers, buckets))
    again = batches.groupBy("batch").cogroup(first.groupBy("batch")).applyInPandas(ask_again, tally.ASKED)
    both = first.withColumn("kind", F.lit(1)).union(tally.totals(again).withColumn("kind", F.lit(2)))
    return batches.groupBy("batch").cogroup(both.groupBy("batch")).applyInPandas(gather, PASSAGES)


def split_runs(start: np.ndarray, size: np.ndarray, low: np.ndarray, hot: np.ndarray, good: np.ndarray) -> tuple:
    """Runs in order, the hot ones replaced by their stretches of good windows."""
    n = size[hot]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    begin = good.copy()
    begin[1:] &= ~good[:-1]
    begin[first] = good[first]  # a run starts anew
    last = good.copy()
    last[:-1] &= ~good[1:]
    ends = first + n - 1
    last[ends] = good[ends]
    a, b = np.flatnonzero(begin), np.flatnonzero(last)
    of = np.searchsorted(first, a, "right") - 1
    new_start = start[hot][of] + a - first[of]
    cold = ~hot
    out = (np.concatenate((start[cold], new_start)), np.concatenate((size[cold], b - a + 1)),
           np.concatenate((low[cold], low[hot][of])))
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)


@dataclass
class Shard:
    """Passages that share minimizers: the distinct ones, with the number of windows of each, and all their places."""

    texts: list[bytes]
    windows: np.ndarray  # by passage
    passage: np.ndarray  # by place
    batch: np.ndarray
    places: np.ndarray  # rid, key, key is null, first window

    @classmethod
    def parts(cls, batches: Iterator[pd.DataFrame]) -> Iterator[Shard]:
        """Rows sorted by minimizer, cut between minimizers when their texts take ``SHARD_BYTES``."""
        texts: dict[bytes, int] = {}
        number, batch, places, windows, size, last = [], [], [], [], 0, None

        def shard() -> Shard:
            n = np.fromiter(map(len, places), np.int64, len(places)) // 32
            return cls(list(texts), np.array(windows, np.int64), np.repeat(np.array(number, np.int64), n),
                       np.repeat(np.array(batch, np.int64), n), np.frombuffer(b"".join(places), np.int64).reshape(-1, 4))

        for rows in batches:
            for m, p, w, b, x in zip(rows["minimizer"].tolist(), rows["passage"], rows["windows"].tolist(), rows["batch"].tolist(),
                                     rows["places"], strict=True):
                if size >= SHARD_BYTES and m != last:
                    yield shard()
                    texts, number, batch, places, windows, size = {}, [], [], [], [], 0
                last = m
                k = texts.get(p)
                if k is None:
                    texts[p] = k = len(texts)
                    windows.append(w)
                    size += len(p)
                number.append(k)
                batch.append(b)
                places.append(x)
        if texts:
            yield shard()


def first_places(shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct passage, by (key is null, key, rid, window), and the ages of the windows
    there, one passage after the other: a number that orders windows so and is the same for one window in two passages."""
    places = shard.places
    order = np.lexsort((places[:, 3], places[:, 0], places[:, 1], places[:, 2], shard.passage))
    sorted_passage = shard.passage[order]
    first = places[order[np.concatenate(([True], sorted_passage[1:] != sorted_passage[:-1]))]]
    by = np.lexsort((first[:, 0], first[:, 1], first[:, 2]))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(np.concatenate(([0], first[by][1:, 0] != first[by][:-1, 0])))
    n = shard.windows
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first, np.repeat(rank << 32, n) + np.repeat(first[:, 3], n) + within


def covered(flags: np.ndarray, windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of units that flagged windows cover: passage, first unit, unit behind; in order."""
    offset = np.cumsum(windows) - windows
    at = np.flatnonzero(flags)
    passage = np.repeat(np.arange(len(windows)), windows)[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > window) | (passage[1:] != passage[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[:len(first)] - 1
    of = passage[first]
    return of, at[first] - offset[of], at[last] - offset[of] + window


def spans_of(shard: Shard, flags: np.ndarray, first: np.ndarray | None, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(batch, spans of rid, first unit, unit behind) at all places of the passages.

    ``flags`` are those of the windows of all passages, one after the other. With ``first`` they hold for these places,
    and all windows at other places are flagged.
    """
    passage, places = shard.passage, shard.places
    own = np.ones(len(places), bool) if first is None else (places[:, 0] == first[passage, 0]) & (places[:, 3] == first[passage, 3])
    of, a, b = covered(flags, shard.windows, window)
    low, n = np.searchsorted(of, np.arange(len(shard.windows))), np.bincount(of, minlength=len(shard.windows))
    at = np.flatnonzero(own)
    times = n[passage[at]]
    index = np.repeat(low[passage[at]] - np.cumsum(times) + times, times) + np.arange(times.sum())
    at = np.repeat(at, times)
    rest = np.flatnonzero(~own)
    start = places[rest, 3]
    found = np.concatenate((
        np.stack((places[at, 0], places[at, 3] + a[index], places[at, 3] + b[index]), axis=1),
        np.stack((places[rest, 0], start, start + shard.windows[passage[rest]] + window - 1), axis=1)))
    return np.concatenate((shard.batch[at], shard.batch[rest])), found


def removed_units(batches: DataFrame, decide: Callable[[Shard], tuple[np.ndarray, np.ndarray | None]],
                  kind: Kind, total: int) -> DataFrame:
    """(batch, spans): spans holds rid, first unit and unit behind, of what flagged windows cover.

    ``decide`` gives flags and first places of a shard (see ``spans_of``).
    """

    def work(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list[bytes]] = {}
        for shard in Shard.parts(rows):
            release_memory()
            batch, spans = spans_of(shard, *decide(shard), kind.window)
            order = np.argsort(batch, kind="stable")
            batch, spans = batch[order], spans[order]
            cut = np.flatnonzero(np.diff(batch)) + 1
            for b, part in zip(batch[np.concatenate(([0], cut))].tolist() if len(batch) else [], np.split(spans, cut), strict=False):
                found.setdefault(b, []).append(part.tobytes())
        yield pd.DataFrame({"batch": np.array(list(found), np.int64), "spans": [b"".join(x) for x in found.values()]})

    sorted_rows = passages(batches, kind, total).repartition("minimizer").sortWithinPartitions("minimizer")
    return sorted_rows.mapInPandas(work, "batch long, spans binary")


def keep_mask(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of n units no span covers."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def apply_spans(batches: DataFrame, spans: DataFrame, finish: Callable[[pd.Series, np.ndarray], tuple], schema: str,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """``finish(text, spans)`` of every document; the columns named by the schema follow, then those of ``keep``."""
    names = [c.split()[0] for c in schema.split(", ")]
    held = {f"kept_{i}": c for i, c in enumerate(keep) if f"kept_{i}" in batches.columns}
    types = dict(batches.dtypes)
    full = f"rid long, key long, {schema}" + "".join(f", {c} {types[c]}" for c in held)

    def work(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        every = np.concatenate([np.frombuffer(s, np.int64) for s in found["spans"]]).reshape(-1, 3) if len(found) else np.zeros((0, 3), np.int64)
        every = every[np.argsort(every[:, 0], kind="stable")]
        rid = rows["rid"].to_numpy()
        low, high = np.searchsorted(every[:, 0], rid), np.searchsorted(every[:, 0], rid, "right")
        out = pd.DataFrame([finish(text, every[i:j, 1:]) for text, i, j in zip(rows["text"], low, high, strict=True)],
                           columns=names)
        out.insert(0, "rid", rid)
        out.insert(1, "key", rows["key"].astype("Int64").reset_index(drop=True))
        for c in held:
            values = rows[c].reset_index(drop=True)
            out[c] = values.astype("Int64") if types[c] in ("bigint", "int") else values
        return out

    done = batches.groupBy("batch").cogroup(spans.groupBy("batch")).applyInPandas(work, full)
    shown = [c for c in ("rid", "key", *names) if c not in held.values()]
    return done.select(*shown, *[F.col(old).alias(new) for old, new in held.items()],
                       *[F.col("key").alias(c) for i, c in enumerate(keep) if c not in held.values() and c not in shown and c != "text"])


def prepared(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = (),
             batch_bytes: int = tally.BATCH_BYTES) -> tuple[DataFrame, int]:
    """The table in batches, and its bytes of text. Columns that are kept become one struct, ``kept_columns``."""
    own = numbered(docs, key=key, text=text, **{f"kept_{i}": c for i, c in enumerate(keep)})
    own = own.select("rid", F.col("key").cast("long").alias("key"), "text",
                     *[F.col(f"kept_{i}") for i, c in enumerate(keep) if c not in (key, text)])
    total = tally_bytes(own)
    return tally.batched(own, total, batch_bytes), total


def tally_bytes(own: DataFrame) -> int:
    return own.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 1
