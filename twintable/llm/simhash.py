"""Near duplicates by SimHash fingerprints, found with keys of a Golay code.

A fingerprint is cut into segments of 22, 21 and 21 bits. The perfect Golay code of length 23 has a
codeword within three bits of any word, so two words that differ in two bits or fewer have a
codeword in common among those within four bits of each (five or six). These codewords' numbers are a
segment's keys.

* Two errors leave one segment of three unharmed: a key is that segment as it is, with a Golay
  key of the next segment (``exact``: 16 keys on average, every pair within two bits is met).
* Five errors leave two segments with at most two each: a key is a Golay key of both (``fuzzy``: 84
  keys on average, every pair within five bits is met, and many beyond it).

Equal fingerprints are one node. Nodes with a key in common meet in a task, sorted by key; it compares
fingerprints and gives out an edge for each linked node, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintable.llm.base import numbered
from twintable.llm.components import components, stars
from twintable.session import durable

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
GENERATOR = 0xAE3  # of the Golay code of length 23, fixed by its definition
#: Shingles hashed at a time.
CHUNK = 1 << 16
#: Groups of a key up to this size are compared pair by pair; larger ones grow tree by tree.
SMALL_GROUP = 64


def _remainder(word: int) -> int:
    for k in range(22, 10, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder by bit of a word; by remainder, all errors of up to four bits (-1: no more)."""
    bits = np.array([_remainder(1 << k) for k in range(23)], np.int32)
    errors: list[list[int]] = [[] for _ in range(2048)]
    for n in range(5):
        for at in combinations(range(23), n):
            errors[int(np.bitwise_xor.reduce(bits[list(at)])) if at else 0].append(sum(1 << k for k in at))
    width = max(map(len, errors))
    return bits, np.array([e + [-1] * (width - len(e)) for e in errors], np.int32)


_golay: tuple[np.ndarray, np.ndarray] | None = None


def golay_keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the numbers of the codewords within four bits; -1 fills rows up."""
    global _golay
    if _golay is None:
        _golay = _tables()
    bits, errors = _golay
    words = words.astype(np.int32)
    remainder = np.zeros(len(words), np.int32)
    for k in range(23):
        remainder ^= np.where(words >> k & 1, bits[k], 0).astype(np.int32)
    error = errors[remainder]
    return np.where(error < 0, -1, (words[:, None] ^ error) >> 11)


def bucket_keys(prints: np.ndarray, fuzzy: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for every key of every fingerprint (uint64)."""
    parts = [(prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    golay = [golay_keys(p).astype(np.int64) for p in parts]
    who, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        if fuzzy:
            key = np.where((golay[i][:, :, None] < 0) | (golay[j][:, None, :] < 0), -1,
                           golay[i][:, :, None] << 12 | golay[j][:, None, :]).reshape(len(prints), -1)
        else:
            key = np.where(golay[j] < 0, -1, parts[i][:, None] << 12 | golay[j])
        rows, columns = np.nonzero(key >= 0)
        who.append(rows)
        keys.append(key[rows, columns] | i << 40)
    return np.concatenate(who), np.concatenate(keys)


def fingerprint(text: str | None, words: int, seeds: Sequence[int]) -> list[int]:
    """SimHash of the word shingles, one 64-bit word for each seed; zero for a text without words."""
    parts = (text or "").encode().lower().split()
    n = max(1, len(parts) - words + 1) if parts else 0
    out = []
    for seed in seeds:
        ones = np.zeros(64, np.int64)
        for at in range(0, n, CHUNK):
            some = parts[at:at + CHUNK + words - 1]
            grams = map(b" ".join, zip(*(some[k:] for k in range(words)), strict=False)) if n > 1 or len(parts) == words else [b" ".join(parts)]
            h = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], np.uint64)
            ones += byte_counts(h)
        bits = ones * 2 > n
        out.append(int(np.packbits(bits, bitorder="little").view(np.int64)[0]))
    return out


_bit_table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def byte_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    raw = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 512:
        return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(raw[:, k], minlength=256) @ _bit_table for k in range(8)])


def fingerprints(docs: DataFrame, words: int, seeds: Sequence[int]) -> DataFrame:
    """rid, key and one long f0, f1, ... for each seed, of a table of rid, key, text."""
    columns = [f"f{k}" for k in range(len(seeds))]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, words, seeds) for t in batch["text"]], np.int64).reshape(-1, len(seeds))
            yield batch[["rid", "key"]].assign(**{c: found[:, k] for k, c in enumerate(columns)})

    return docs.select("rid", "key", "text").mapInPandas(
        work, f"rid long, key long, {', '.join(f'{c} long' for c in columns)}")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int32)


def group_links(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius among rows with an equal key (sorted): they connect all such rows
    that links within their key's group connect."""
    if not len(keys):
        return np.zeros(0, int), np.zeros(0, int)
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(start, len(keys)))
    left, right = [], []
    end = np.repeat(start + size, size)
    small = np.repeat(size <= SMALL_GROUP, size)
    for d in range(1, SMALL_GROUP):
        i = np.flatnonzero(small & (np.arange(len(keys)) + d < end))
        if not len(i):
            break
        i = i[distance(prints[i], prints[i + d]) <= radius]
        left.append(i)
        right.append(i + d)
    for s, n in zip(start[size > SMALL_GROUP], size[size > SMALL_GROUP], strict=True):
        rest = np.arange(s, s + n)
        ready: list[int] = []
        while len(rest):
            if not ready:
                ready, rest = [int(rest[0])], rest[1:]
            here = ready.pop()
            near = distance(prints[rest], prints[here]) <= radius
            found = rest[near]
            left.append(np.full(len(found), here))
            right.append(found)
            ready += found.tolist()
            rest = rest[~near]
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def links(nodes: DataFrame, columns: Sequence[str], radius: int, fuzzy: bool) -> DataFrame:
    """(a, b): links between nodes (node and fingerprint words) that connect all that are within the radius
    and have a key in common."""
    n = len(columns)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                some = batch.iloc[at:at + 2000]
                prints = some[list(columns)].to_numpy(np.int64).reshape(-1, n)
                for k in range(n):
                    who, key = bucket_keys(prints[:, k].view(np.uint64) if n == 1 else np.ascontiguousarray(prints[:, k]).view(np.uint64), fuzzy)
                    yield pd.DataFrame({"key": key | k << 44, "node": some["node"].to_numpy()[who],
                                        **{c: prints[who, i] for i, c in enumerate(columns)}})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        found, size, limit = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, 1 << 16

        def together() -> tuple[np.ndarray, np.ndarray]:
            return stars(*(np.concatenate(x) for x in zip(*found, strict=True)))

        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if batch is not None and (not len(batch) or batch["key"].iloc[0] == batch["key"].iloc[-1]):
                continue
            # all but the last key of a batch are complete
            whole = pd.concat(held) if held else pd.DataFrame()
            done = whole["key"] != batch["key"].iloc[-1] if batch is not None else np.ones(len(whole), bool)
            if len(whole):
                found.append(linked(whole[done]))
                size += len(found[-1][0])
                if size > limit:
                    found = [together()]
                    size, limit = len(found[0][0]), 1 << 16 | 2 * len(found[0][0])
            held = [whole[~done]]
        a, b = together()
        yield pd.DataFrame({"a": a, "b": b})

    def linked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        a, b = group_links(rows["key"].to_numpy(), rows[list(columns)].to_numpy(np.int64).reshape(-1, n), radius)
        node = rows["node"].to_numpy()
        return node[a], node[b]

    wide = ", ".join(f"{c} long" for c in columns)
    keys = nodes.select("node", *columns).mapInPandas(keyed, f"key long, node long, {wide}")
    return keys.repartition("key").sortWithinPartitions("key").mapInPandas(meet, "a long, b long").distinct()


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3,
            seeds: Sequence[int] = (42,), radius: int = 2, fuzzy: bool | None = None) -> DataFrame:
    """``rid``, ``key``, fingerprint words f0... ``root`` (the class, by one of its row numbers)
    and ``component`` (smallest key of the class) of each row.

    Words are parted by ASCII white space after lower-casing A-Z; a text with fewer words than a shingle
    is one shingle, and a null, empty or blank text has fingerprint zero and is linked like any other.
    Repeated rows are rows of one class. Rows with a null key take part; their class has the smallest
    key that is not null, or null if there is none.
    """
    fuzzy = radius > 2 if fuzzy is None else fuzzy
    columns = [f"f{k}" for k in range(len(seeds))]
    prints = durable(fingerprints(numbered(docs, key=key, text=text), words, seeds))
    nodes = prints.groupBy(*columns).agg(F.min("rid").alias("node"), F.min("key").alias("least"))
    nodes = durable(nodes)
    member = components(links(nodes, columns, radius, fuzzy))
    placed = nodes.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    placed = placed.join(least, "root").select(*[F.col(c).alias(f"_{c}") for c in columns], "root", "component")
    return prints.join(placed, [F.col(c) == F.col(f"_{c}") for c in columns]).select(
        "rid", "key", *columns, "root", "component")
