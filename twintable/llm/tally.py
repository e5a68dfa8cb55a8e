"""Counts of hashes over all documents, given back to the documents that have them.

Documents are dealt into batches of some megabytes. A batch sends each bucket of the hash range its
distinct hashes there (sorted) with their counts, as one row; the bucket adds up over batches and
answers each with the totals, in the order in which it was asked. So a frequent hash costs each
batch one entry, and no table of hashes is ever broadcast or collected.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintable.llm.base import release_memory

#: Bytes of text in a batch, and in what the hashes of one bucket come from.
BATCH_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20

#: Bytes of a step that are kept as they are.
LOW_BYTES = 5

#: The largest hash stands for a sum over all batches.
TOTAL = np.uint64(0xFFFFFFFFFFFFFFFF)

ASKED = "batch long, bucket int, hashes binary, counts binary"
ANSWERED = "batch long, bucket int, counts binary"


def batched(docs: DataFrame, total: int, least: int = BATCH_BYTES) -> DataFrame:
    """A table with rid and a batch number; the square root keeps batches x buckets in proportion at any size."""
    size = max(least, int((total * 64) ** 0.5))
    return docs.withColumn("batch", F.pmod(F.xxhash64("rid"), F.lit(max(1, -(-total // size)))))


def buckets_for(total: int) -> int:
    return max(16, -(-total // BUCKET_BYTES))


def packed(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers, as their count and steps, all first bytes first. Low bytes are as good as random; the high
    ones are small or zero, and entropy coding takes each plane of them to a few bits a number."""
    planes = np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, 8).T
    high = [zlib.compress(plane.tobytes(), 1) for plane in planes[LOW_BYTES:]]
    sizes = np.array([len(values), *map(len, high)], np.int32).tobytes()
    return b"".join((sizes, planes[:LOW_BYTES].tobytes(), *high))


def unpacked(data: bytes) -> np.ndarray:
    head = 4 * (9 - LOW_BYTES)
    n, *sizes = np.frombuffer(data[:head], np.int32).tolist()
    planes = np.empty((8, n), np.uint8)
    planes[:LOW_BYTES] = np.frombuffer(data, np.uint8, LOW_BYTES * n, head).reshape(LOW_BYTES, n)
    at = head + LOW_BYTES * n
    for plane, size in zip(planes[LOW_BYTES:], sizes, strict=True):
        plane[:] = np.frombuffer(zlib.decompress(data[at:at + size]), np.uint8)
        at += size
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def plain(values: np.ndarray) -> bytes:
    """Counts, mostly small: entropy coding takes them to a few bits each."""
    return zlib.compress(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unplain(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def question(batch: int, hashes: np.ndarray, buckets: int, total: int | None = None) -> pd.DataFrame:
    """One row for each bucket. total: what the batch adds to the count of ``TOTAL``."""
    found, counts = np.unique(hashes, return_counts=True)
    if total is not None:
        found, counts = np.append(found, TOTAL), np.append(counts, total)
    bucket = (found >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(found) else np.zeros(0, int)
    stop = np.append(start[1:], len(found))[:len(start)]
    return pd.DataFrame({
        "batch": np.full(len(start), batch, np.int64), "bucket": bucket[start].astype(np.int32),
        "hashes": [packed(found[i:j]) for i, j in zip(start, stop, strict=True)],
        "counts": [plain(counts[i:j]) for i, j in zip(start, stop, strict=True)]})


def totals(asked: DataFrame) -> DataFrame:
    """For each row that asks the sums over all batches."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(h) for h in rows["hashes"]]
        every = np.concatenate(parts)
        n = np.concatenate([unplain(c) for c in rows["counts"]])
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        sums = np.add.reduceat(n[order], np.flatnonzero(first))
        back = np.empty(len(every), np.uint64)
        back[order] = sums[np.cumsum(first) - 1]
        ends = np.cumsum([len(p) for p in parts])[:-1]
        return pd.DataFrame({"batch": rows["batch"].to_numpy(), "bucket": rows["bucket"].to_numpy(),
                             "counts": [plain(x) for x in np.split(back, ends)]})

    return asked.groupBy("bucket").applyInPandas(add, ANSWERED)


def answer(hashes: np.ndarray, rows: pd.DataFrame, total: bool = False) -> np.ndarray:
    """Total count of each hash, from the answers to its batch; with ``total`` that of ``TOTAL`` at the end."""
    found, back = np.unique(hashes, return_inverse=True)
    parts = [unplain(c) for c in rows.sort_values("bucket")["counts"]]
    counts = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if len(counts) != len(found) + total:
        raise RuntimeError("answers do not fit the batch: its rows changed between two reads")
    return np.append(counts[back], counts[len(found):])


def ask(docs: DataFrame, hashes: Callable[[pd.DataFrame], Iterator[np.ndarray]], buckets: int) -> DataFrame:
    """Questions of all batches."""

    def emit(rows: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        parts = list(hashes(rows))
        return question(rows["batch"].iloc[0], np.concatenate(parts) if parts else np.zeros(0, np.uint64), buckets)

    return docs.groupBy("batch").applyInPandas(emit, ASKED)
