"""Suffix sorting by induction with queues on disk, and exact removal of repeated byte strings.

``sort_suffixes`` sorts the suffixes of a text of integers:

1. suffixes that start a valley (smaller than both neighbours' suffixes) are sorted, by sorting the
   substrings between valleys by induction, naming them, and sorting the text of names the same way;
2. all others follow by two induction passes: each pass takes positions off a priority queue in
   order and puts the position before each back, keyed by its symbol.

Keys only grow (or only fall) within a pass, so the queue is a row of first-in first-out buckets by symbol.
It holds blocks of (position, common prefix with the entry before) and moves blocks to an unlinked temporary
file of the task when they take more than ``MEMORY``; such files end with the task, hold nothing
that another task reads, and are made again if the task is.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from twintable.llm import repeats

#: Bytes that a queue or an output holds in memory.
MEMORY = 64 << 20
#: Texts of names with more symbols than this are sorted by doubling instead of induction.
SYMBOLS = 1024
#: Batches up to this length are worked off entry by entry.
FEW = 24


class BlockStore:
    """Arrays of int64, in memory or, beyond the limit, in a temporary file of this task."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held, self.file, self.end = limit, 0, None, 0

    def put(self, block: np.ndarray):
        if self.held + block.nbytes <= self.limit:
            self.held += block.nbytes
            return block
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        block.tofile(self.file)
        self.end += block.nbytes
        return self.end - block.nbytes, len(block)

    def get(self, stored) -> np.ndarray:
        if isinstance(stored, np.ndarray):
            self.held -= stored.nbytes
            return stored
        self.file.seek(stored[0])
        return np.fromfile(self.file, np.int64, stored[1])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class InducingQueue:
    """Positions by symbol; those of a symbol in the order in which they came."""

    def __init__(self, rising: bool, limit: int = MEMORY) -> None:
        self.sign, self.store = 1 if rising else -1, BlockStore(limit)
        self.blocks: dict[int, list] = {}
        self.single: dict[int, list[int]] = {}
        self.symbols: list[int] = []

    def _note(self, symbol: int) -> None:
        if symbol not in self.blocks and symbol not in self.single:
            heapq.heappush(self.symbols, self.sign * symbol)

    def push(self, symbol: int, position: int) -> None:
        self._note(symbol)
        self.single.setdefault(symbol, []).append(position)

    def push_block(self, symbol: int, block: np.ndarray) -> None:
        self._note(symbol)
        if symbol in self.single:  # keep the order
            self.blocks.setdefault(symbol, []).append(self.store.put(np.array(self.single.pop(symbol), np.int64)))
        self.blocks.setdefault(symbol, []).append(self.store.put(block))

    def first(self) -> int | None:
        return self.sign * self.symbols[0] if self.symbols else None

    def pop(self) -> list[int] | np.ndarray:
        """All positions now held for the first symbol."""
        symbol = self.sign * heapq.heappop(self.symbols)
        single = self.single.pop(symbol, [])
        if symbol not in self.blocks:
            return single
        parts = [self.store.get(b) for b in self.blocks.pop(symbol)]
        if single:
            parts.append(np.array(single, np.int64))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]


def rising_suffixes(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one's; the last is."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # last place of each stretch of one symbol
    up = text[change] < text[change + 1]
    size = np.diff(np.concatenate(([-1], change)))
    return np.concatenate((np.repeat(up, size), np.ones(n - (change[-1] + 1 if len(change) else 0), bool)))


def induce(text: np.ndarray, rises: np.ndarray, seeds: np.ndarray) -> tuple[list, list, BlockStore]:
    """Falling and rising suffixes in order, as stored blocks by symbol, from the valleys in the order given."""
    store = BlockStore(MEMORY)
    falling: dict[int, list] = {}
    order_f: list[int] = []
    rising: dict[int, list] = {}

    def before(batch, queue: InducingQueue, want: bool) -> None:
        """Puts the position before each into the queue where its kind is wanted."""
        if len(batch) <= FEW:
            for p in batch:
                if p and rises[p - 1] == want:
                    queue.push(int(text[p - 1]), int(p) - 1)
            return
        q = np.asarray(batch, np.int64) - 1
        q = q[q >= 0]
        q = q[rises[q] == want]
        if len(q):
            symbol = text[q]
            by = np.argsort(symbol, kind="stable")
            q, symbol = q[by], symbol[by]
            cut = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
            for part, s in zip(np.split(q, cut), symbol[np.concatenate(([0], cut))].tolist(), strict=True):
                if len(part) <= 4:
                    for p in part.tolist():
                        queue.push(s, p)
                else:
                    queue.push_block(s, part)

    # valleys by symbol, in the given order
    symbol = text[seeds]
    by = np.argsort(symbol, kind="stable")
    seeds, symbol = seeds[by], symbol[by]
    cut = np.concatenate(([0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, [len(seeds)]))
    valley = [int(symbol[a]) for a in cut[:-1]]
    queue, v = InducingQueue(True), 0
    while queue.symbols or v < len(valley):
        s = queue.first()
        if s is not None and (v == len(valley) or s <= valley[v]):  # falling suffixes come before rising ones
            batch = queue.pop()
            if s not in falling:
                falling[s] = []
                order_f.append(s)
            falling[s].append(store.put(np.asarray(batch, np.int64)))
        else:
            batch = seeds[cut[v]:cut[v + 1]]
            v += 1
        before(batch, queue, False)
    queue = InducingQueue(False)
    v = len(order_f) - 1
    while queue.symbols or v >= 0:
        s = queue.first()
        if s is not None and (v < 0 or s >= order_f[v]):
            batch = queue.pop()
            rising.setdefault(s, []).append(store.put(np.asarray(batch, np.int64)))
            before(batch, queue, True)
        else:
            blocks = falling[order_f[v]]
            for k in range(len(blocks) - 1, -1, -1):
                block = store.get(blocks[k])
                blocks[k] = store.put(block)
                before(block[::-1], queue, True)
            v -= 1
    return falling, rising, store


def in_order(text: np.ndarray, rises: np.ndarray, seeds: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of positions in suffix order, without the last suffix's own place among rising ones."""
    falling, rising, store = induce(text, rises, seeds)
    for s in sorted({*falling, *rising}):
        for b in falling.get(s, []):
            yield store.get(b)
        for b in reversed(rising.get(s, [])):
            yield store.get(b)[::-1]
    store.close()


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes. The text ends with its smallest symbol, which is nowhere else."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    rises = rising_suffixes(text)
    valleys = np.flatnonzero(rises[1:] & ~rises[:-1]) + 1
    # sort the substrings from valley to valley
    rough = np.concatenate(list(in_order(text, rises, valleys)) or [np.zeros(0, np.int64)])
    is_valley = np.zeros(n, bool)
    is_valley[valleys] = True
    rough = rough[is_valley[rough]]
    if not is_valley[n - 1] or n - 1 not in rough[:1]:
        rough = np.concatenate(([n - 1], rough[rough != n - 1]))
    # names: equal substrings have equal names
    ends = np.append(valleys[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[valleys] = ends - valleys + 1
    size = length[rough]
    same = size[1:] == size[:-1]
    same &= size[1:] > 0
    pairs = np.flatnonzero(same)
    offset = 0
    while len(pairs):
        differ = text[rough[pairs] + offset] != text[rough[pairs + 1] + offset]
        same[pairs[differ]] = False
        pairs = pairs[~differ]
        offset += 1
        pairs = pairs[size[pairs] > offset]
    names = np.concatenate(([0], np.cumsum(~same)))
    by_place = np.full(n, -1, np.int64)
    by_place[rough] = names
    reduced = by_place[valleys] if is_valley[n - 1] else np.append(by_place[valleys], 0)
    if names[-1] + 1 < len(rough):
        recur = sort_suffixes if names[-1] < SYMBOLS else sort_names
        sorted_valleys = valleys[recur(reduced)]
    else:
        sorted_valleys = rough
    out = list(in_order(text, rises, sorted_valleys))
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    return np.concatenate(([n - 1], found[found != n - 1]))


def sort_names(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text of many different symbols, by doubling the length that is sorted.

    Buckets of a few entries would make induction crawl there; only suffixes that are not yet told apart are
    sorted again.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    first = np.concatenate(([True], text[order][1:] != text[order][:-1]))
    start = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    done = 1
    while True:
        slots = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(slots):
            return order
        p = order[slots]
        after = p + done
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.argsort(rank[p] * (n + 1) + second + 1, kind="stable")
        p, second = p[by], second[by]
        one = rank[p]
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (second[1:] != second[:-1])))
        order[slots] = p
        first[slots] = new
        rank[p] = slots[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
        done *= 2


def common_windows(text: np.ndarray, order: np.ndarray, window: int, room: np.ndarray) -> np.ndarray:
    """Whether each suffix in order has a window in common with the one before: eight symbols at a time."""
    raw = np.concatenate((text.astype(np.uint8), np.zeros(8, np.uint8)))
    blocks = np.lib.stride_tricks.as_strided(raw, (len(text) + 1, 8), (1, 1))
    good = room[order] >= window
    pairs = np.flatnonzero(good[1:] & good[:-1]) + 1
    steps = list(range(0, window - 7, 8)) + ([window - 8] if window % 8 else [])
    for step in steps:
        a = np.ascontiguousarray(blocks[order[pairs] + step]).view(np.uint64).ravel()
        b = np.ascontiguousarray(blocks[order[pairs - 1] + step]).view(np.uint64).ravel()
        pairs = pairs[a == b]
    out = np.zeros(len(order), bool)
    out[pairs] = True
    return out


def repeated_windows(passages: list[bytes], window: int, ages: np.ndarray | None = None) -> np.ndarray:
    """For all windows of the passages, one passage after the other, which are also elsewhere in them; with ages (of
    all windows), which of them an older one equals."""
    n = np.fromiter(map(len, passages), np.int64, len(passages))
    text = np.frombuffer(b"\0".join([*passages, b"\0"]), np.uint8)
    ends = np.cumsum(n + 1) - 1
    room = np.append(np.repeat(ends, n + 1) - np.arange(ends[-1] + 1), 0)
    parted = text + np.int16(2)
    parted[ends] = 1
    parted[-1] = 0
    order = sort_suffixes(parted)
    same = common_windows(text, order, window, room)
    flags = np.zeros(len(text), bool)
    if ages is None:
        flags[order[same]] = True
        flags[order[np.flatnonzero(same) - 1]] = True
    else:
        rank = np.zeros(len(text), np.int64)
        rank[room >= window] = ages
        ranked = rank[order]
        first = np.flatnonzero(~same)
        oldest = np.repeat(np.minimum.reduceat(ranked, first), np.diff(np.append(first, len(order))))
        flags[order] = ranked > oldest
    return flags[room >= window]


def kind_of(window: int) -> repeats.Kind:
    return repeats.Kind(lambda texts: (np.frombuffer((t or "").encode(), np.uint8) for t in texts), np.uint8, window,
                        max(1, window // 3))


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 200,
                   keep_first: bool = False, with_text: bool = False,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Removes each byte that is covered by a string of ``window`` bytes which starts anywhere else too, or, with
    ``keep_first``, which also starts earlier: in a row with a smaller key (rows with equal keys in input order, null
    keys last) or before it in the same document.

    One row per input row: rid, key, n_bytes, n_removed, n_spans (maximal removed stretches), kept_sha256,
    and with ``with_text`` the text that is left (bytes of a cut
    character are dropped from it); the columns of ``keep`` follow unchanged. Null and empty texts have
    no bytes and nothing to remove. Matches overlap freely, never cross documents, and are judged on the
    input. Repeated rows and null keys are documents of their own.
    """
    import hashlib

    kind = kind_of(window)
    batches, total = repeats.prepared(docs, key, text, keep)

    def decide(shard: repeats.Shard) -> tuple[np.ndarray, np.ndarray | None]:
        if keep_first:
            first, ages = repeats.first_places(shard)
            return repeated_windows(shard.texts, window, ages), first
        twice = np.bincount(shard.passage, minlength=len(shard.texts)) > 1
        return repeated_windows(shard.texts, window) | np.repeat(twice, shard.windows), None

    def finish(value: str | None, spans: np.ndarray) -> tuple:
        raw = np.frombuffer((value or "").encode(), np.uint8)
        keep = repeats.keep_mask(len(raw), spans)
        left = raw[keep].tobytes() if len(spans) else raw.tobytes()
        starts = int((~keep[1:] & keep[:-1]).sum() + (not keep[0])) if len(keep) else 0
        return (len(raw), int(len(raw) - keep.sum()), starts, hashlib.sha256(left).hexdigest(),
                (value if value is None else left.decode(errors="ignore")) if with_text else None)

    spans = repeats.removed_units(batches, decide, kind, total)
    return repeats.apply_spans(batches, spans, finish,
                               "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string", keep)
