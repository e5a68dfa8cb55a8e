"""Benchmark decontamination: windows of a document as long as a benchmark item, compared by SimHash.

Words are runs of a-z, 0-9 and bytes beyond ASCII after lower-casing; shingles are five words, weighted by
how often they occur. For each item that shares a shingle with a document, the windows of the item's length
around what is shared get a SimHash (prefix sums over the bits make that one difference per window); a document shorter
than the item is compared with it as a whole. An index of
the items' fingerprints, cut into blocks, gives every item within the radius: by the pigeonhole principle one block
differs in at most radius / blocks bits. Candidates are verified by exact weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintable.llm.base import gram_hashes, numbered, word_hashes

WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 20, 4
#: Bytes of benchmark text that are indexed and broadcast at once; more takes further passes.
BLOCK_BYTES = 32 << 20
#: Windows fingerprinted at a time.
CHUNK = 1 << 14

_fold = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return gram_hashes(word_hashes((text or "").encode().translate(_fold))[0], words)


def bits_of(h: np.ndarray) -> np.ndarray:
    """Rows of 64 entries, 1 for a set bit and -1 for others."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def window_prints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of ``size`` shingles."""
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits_of(h), axis=0, dtype=np.int32)))
    return np.packbits(sums[size:] - sums[:-size] > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


class Index:
    """Items of a block: their shingles, and fingerprints by length and by block of bits."""

    def __init__(self, keys: list[int], texts: list[str | None], words: int, radius: int, blocks: int) -> None:
        self.radius, self.blocks, self.width = radius, blocks, 64 // blocks
        self.items = [(k, h) for k, h in zip(keys, (shingles(t, words) for t in texts), strict=True) if len(h)]
        every = np.concatenate([h for _, h in self.items]) if self.items else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(self.items)), [len(h) for _, h in self.items])
        order = np.argsort(every, kind="stable")
        self.shingles, self.of = every[order], of[order]
        self.prints = np.array([window_prints(h, len(h))[0] for _, h in self.items], np.uint64)
        self.sizes = np.array([len(h) for _, h in self.items], np.int64)
        reach = radius // blocks
        self.masks = np.array([m for m in range(1 << self.width) if m.bit_count() <= reach], np.uint64)
        self.tables: dict[int, list] = {}
        for size in np.unique(self.sizes).tolist():
            at = np.flatnonzero(self.sizes == size)
            parts = [self.part(self.prints[at], j) for j in range(blocks)]
            self.tables[size] = [(p[o], at[o]) for p, o in ((p, np.argsort(p, kind="stable")) for p in parts)]

    def part(self, prints: np.ndarray, j: int) -> np.ndarray:
        return prints >> np.uint64(j * self.width) & np.uint64((1 << self.width) - 1)

    def within(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, each once."""
        found = []
        for j, (keys, at) in enumerate(self.tables[size]):
            own = self.part(prints, j)
            if len(keys) * 4 < len(self.masks):  # fewer items than probes: compare the block itself
                close = np.bitwise_count(own[:, None] ^ keys[None]) <= self.radius // self.blocks
                window, k = np.nonzero(close)
                found.append(window * len(self.items) + at[k])
                continue
            for mask in self.masks:
                low, high = np.searchsorted(keys, own ^ mask), np.searchsorted(keys, own ^ mask, "right")
                window = np.repeat(np.arange(len(own)), high - low)
                k = np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange(len(window))
                found.append(window * len(self.items) + at[k])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        window, item = pair // max(1, len(self.items)), pair % max(1, len(self.items))
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
        return window[near], item[near]

    def matches(self, text: str | None, words: int, least: float) -> dict[int, tuple[float, int, int]]:
        """By item: best similarity, first word and word behind of the window."""
        h = shingles(text, words)
        if not len(h) or not len(self.shingles):
            return {}
        low = np.searchsorted(self.shingles, h)
        hit = np.flatnonzero(self.shingles[np.minimum(low, len(self.shingles) - 1)] == h)
        if not len(hit):
            return {}
        high = np.searchsorted(self.shingles, h[hit], "right")
        n = high - low[hit]
        item = self.of[np.repeat(low[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        place = np.repeat(hit, n)
        found: dict[int, tuple[float, int, int]] = {}
        for size in np.unique(self.sizes[item]).tolist():
            if len(h) < least * size - 1e-9:
                continue
            mine = self.sizes[item] == size
            at, of = place[mine], item[mine]
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            # similarity s of windows of n and m shingles takes s / (1 + s) * (n + m) in common, each a hit of its own
            cut = np.flatnonzero(of[1:] != of[:-1]) + 1
            if len(h) < size:  # a text shorter than the item is the one window
                need = int(np.ceil(least / (1 + least) * (size + len(h)) - 1e-9))
                for p, i in zip(np.split(at, cut), of[np.append(0, cut)].tolist(), strict=True):
                    if len(np.unique(p)) >= need and (value := similarity(h, self.items[i][1])) >= least:
                        found[i] = (value, 0, len(h) + words - 1)
                continue
            starts = np.zeros(len(h) - size + 1, bool)
            need = int(np.ceil(2 * least / (1 + least) * size - 1e-9))
            for p in np.split(at, cut):
                if len(p) < need:
                    continue
                inside = np.zeros(len(h) + 1, np.int32)
                inside[p + 1] = 1
                inside = np.cumsum(inside)
                starts |= inside[size:] - inside[:-size] >= need
            chosen = np.flatnonzero(starts)
            for k in range(0, len(chosen), CHUNK):
                some = chosen[k:k + CHUNK]
                for part in np.split(some, np.flatnonzero(np.diff(some) > size) + 1):
                    if not len(part):
                        continue
                    prints = window_prints(h[part[0]:part[-1] + size], size)[part - part[0]]
                    for w, i in zip(*(x.tolist() for x in self.within(prints, size)), strict=True):
                        s = int(part[w])
                        value = similarity(h[s:s + size], self.items[i][1])
                        if value >= least and value > found.get(i, (0.0,))[0]:
                            found[i] = (value, s, s + size + words - 1)
        return {self.items[i][0]: v for i, v in found.items()}


def _matcher(index, words: int, least: float):
    """Column function from texts to what the broadcast index finds in them."""

    @F.pandas_udf("item_ids array<long>, similarity double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        found = [index.value.matches(t, words, least) for t in texts]
        return pd.DataFrame({"item_ids": [sorted(m) for m in found],
                             "similarity": [max(v[0] for v in m.values()) if m else None for m in found]})

    return judge


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", words: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS,
                 blocks: int = BLOCKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: rid, key, ``item_ids`` (sorted, of the items that some window resembles) and ``similarity`` (the
    best; null without a match), with the columns of ``keep`` unchanged.

    A text shorter than an item is compared as a whole. Null and empty texts match nothing; neither do items that are null or have fewer words than a shingle.
    Items with a null key are matched under key -1. Repeated items are listed once, and repeated rows are rows of their own. The benchmark is
    indexed a block of bounded bytes at a time; each block is one pass over the documents.
    """
    spark = docs.sparkSession
    own = numbered(docs, key=key, text=text, **{f"kept_{i}": c for i, c in enumerate(keep)})
    items = numbered(benchmark, key=item_key, text=item_text)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // BLOCK_BYTES))
    answers = []
    for p in range(parts):
        block = items.filter(F.pmod(F.xxhash64("rid"), F.lit(parts)) == p).select("key", "text").toPandas()
        index = Index([-1 if pd.isna(k) else int(k) for k in block["key"]], block["text"].tolist(), words, radius, blocks)
        sent = spark.sparkContext.broadcast(index)

        answers.append(_matcher(sent, words, least))
    out = own
    for p, udf in enumerate(answers):
        out = out.withColumn(f"found_{p}", udf("text"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"found_{p}.item_ids") for p in range(parts)]))))
    best = F.array_max(F.array(*[F.col(f"found_{p}.similarity") for p in range(parts)]))
    return out.select("rid", "key", *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)],
                      ids.alias("item_ids"), best.alias("similarity"))
