"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintable.session import durable

#: Plan nodes that give the same rows in the same order and partitions each time they run.
REPLAYED = {"Project", "Filter", "Relation", "RelationV2", "DataSourceV2ScanRelation", "LocalRelation",
            "LogicalRDD", "ExternalRDD", "SubqueryAlias", "Range", "SerializeFromObject", "View"}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def numbered(df: DataFrame, **columns: str) -> DataFrame:
    """``rid`` (unique per row) and the named columns only, under the names given here.

    Other columns of the table are left behind, so their names cannot clash. A row number only
    holds if the plan below replays row by row (scans, projections, filters); any other input is
    checkpointed first, so that a task that is run again numbers the same rows alike.
    """
    own = df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    if not set(re.findall(r"^[\s:+!'-]*(\w+)", plan, re.MULTILINE)) <= REPLAYED:
        own = durable(own)
    return own.withColumn("rid", F.monotonically_increasing_id())


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column: what the number of batches is derived from."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


#: Rows of a narrow table up to which it is broadcast.
BROADCAST_ROWS = 100_000


def small_side(rows: DataFrame) -> DataFrame:
    """Marks a materialised narrow table for broadcast if it is short; a longer one is joined by its key."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


#: What empties the stores that a Python worker keeps from task to task.
STORES: list[Callable[[], None]] = []


def trim_memory() -> None:
    """Gives what earlier work has freed back to the system: Python workers live on into later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def release_memory() -> None:
    """Empties the stores of other operators and gives back what earlier groups have freed."""
    for empty in STORES:
        empty()
    trim_memory()


#: Bytes of whole texts that go to a Python worker at a time: with a row count alone, long texts make large batches.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads neighbouring values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(units: np.ndarray, k: int, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """A hash of each run of k consecutive units (uint64), by doubling the length."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    modulus = 1 << 64
    power, length, h = base, 1, units.astype(np.uint64, copy=False)
    out, done = None, 0
    while True:
        if k & length:
            if out is None:
                out, done = h[:n + k - length].copy(), length
            else:  # out covers `done` units; append the next `length`
                m = len(units) - done - length + 1
                out = out[:m] * np.uint64(power) + h[done:done + m]
                done += length
        if done == k:
            return mixed(out[:n])
        h = h[:-length] * np.uint64(power) + h[length:] if len(h) > length else h[:0]
        power, length = power * power % modulus, length * 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of `width` consecutive values."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[:n], h[width - span:width - span + n])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a UTF-8 text, parted by bytes 0x20 and 0x09-0x0D: hash, first byte, byte after."""
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([1], blank.astype(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    # Eight bytes at a time: each word's hash takes in one more block while it has one.
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    blocks = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))
    size = end - start
    h = size.astype(np.uint64)
    at, todo = start.copy(), np.arange(len(start))
    masks = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
    left = size.copy()
    while len(todo):
        word = np.ascontiguousarray(blocks[at[todo]]).view(np.uint64).ravel() & masks[np.minimum(left[todo], 8)]
        h[todo] = mixed((h[todo] ^ word) + np.uint64(0x632BE59BD9B4E019))
        at[todo] += 8
        left[todo] -= 8
        todo = todo[left[todo] > 0]
    return h, start, end
