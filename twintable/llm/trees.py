"""Removal of repeated word sequences by suffix trees over groups of suffixes with a common prefix.

The suffixes of a shard's passages are parted by their first word; a group that is larger than ``GROUP``
is parted by one word more, and so on, so prefixes are as long as they need to be. The subtree of a group
is built as its sorted suffixes with the depths of common prefixes; its nodes at least ``window`` words
deep are the repeats. Below each topmost such node all suffixes share the window, and all but the
earliest are repeats of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from twintable.llm import repeats
from twintable.llm.base import word_hashes

#: Suffixes of which a subtree is built at once.
GROUP = 50_000
#: Bytes of texts whose words are hashed at once.
TOGETHER = 1 << 18


def words_of(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text. Short texts are hashed together: a call a text takes three times as long."""

    def parted(some: list[bytes]) -> list[np.ndarray]:
        hashes, start, _ = word_hashes(b" ".join(some))
        return np.split(hashes, np.searchsorted(start, np.cumsum([len(x) + 1 for x in some[:-1]])))

    held, size = [], 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= TOGETHER:
            yield from parted(held)
            held, size = [], 0
    if held:
        yield from parted(held)


def prefix_groups(words: np.ndarray, suffixes: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, int]]:
    """Groups of suffixes with a common prefix, and its length; at most GROUP each, unless they share a window."""
    todo = [(suffixes, 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) <= GROUP or depth == window:
            yield group, depth
            continue
        word = words[group + depth]
        order = np.argsort(word, kind="stable")
        group, word = group[order], word[order]
        cut = np.flatnonzero(word[1:] != word[:-1]) + 1
        todo += [(part, depth + 1) for part in np.split(group, cut) if len(part) > 1]


def subtree(words: np.ndarray, group: np.ndarray, depth: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a group in order, and whether each parts from the one before above the window's depth.

    ``words`` are ranks. Below the common prefix, the rest of the window is compared as big-endian bytes.
    """
    if depth == window:
        return group, np.arange(len(group)) == 0
    rest = np.lib.stride_tricks.sliding_window_view(words, window - depth)[group + depth].astype(">u4")
    rest = rest.view(f"S{4 * (window - depth)}").ravel()
    order = np.argsort(rest)
    rest = rest[order]
    return group[order], np.concatenate(([True], rest[1:] != rest[:-1]))


def repeated_windows(words: np.ndarray, suffixes: np.ndarray, age: np.ndarray, window: int) -> np.ndarray:
    """Which of the suffixes begin with a window that an older one begins with too."""
    ranks = np.unique(words, return_inverse=True)[1].astype(np.uint32) + 1
    rank = np.zeros(len(words), np.int64)
    rank[suffixes] = age
    flags = np.zeros(len(words), bool)
    for group, depth in prefix_groups(ranks, suffixes, window):
        order, parts = subtree(ranks, group, depth, window)
        first = np.flatnonzero(parts)  # where a topmost node that is deep enough, or a leaf, begins
        aged = rank[order]
        oldest = np.minimum.reduceat(aged, first)
        flags[order] = aged > np.repeat(oldest, np.diff(np.append(first, len(order))))
    return flags[suffixes]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 20,
                   with_text: bool = False) -> DataFrame:
    """Removes each word covered by a window whose words also start earlier: in a row with a smaller key, or
    earlier in the same document.

    One row per input row: rid, key, n_words, n_removed, kept_sha256 of the kept words joined by one space, and with
    ``with_text`` those words. Null, empty and blank texts have no words. Rows with equal keys are in input
    order; rows with a null key come last. Words are unchanged and compared by 64-bit hash.
    """
    kind = repeats.Kind(words_of, np.uint64, window, max(1, window // 2))
    batches, total = repeats.prepared(docs, key, text)

    def decide(shard: repeats.Shard) -> tuple[np.ndarray, np.ndarray]:
        n = shard.windows
        words = np.frombuffer(b"".join(shard.texts), np.uint64)
        start = np.cumsum(n + window - 1) - n - window + 1
        suffixes = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        first, ages = repeats.first_places(shard)
        return repeated_windows(words, suffixes, ages, window), first

    def finish(value: str | None, spans: np.ndarray) -> tuple:
        raw = (value or "").encode()
        words = raw.split()
        keep = repeats.keep_mask(len(words), spans)
        left = b" ".join(words) if not len(spans) else b" ".join([words[i] for i in np.flatnonzero(keep)])
        return (len(words), int(len(words) - keep.sum()), hashlib.sha256(left).hexdigest(),
                (value if value is None else left.decode()) if with_text else None)

    spans = repeats.removed_units(batches, decide, kind, total)
    return repeats.apply_spans(batches, spans, finish, "n_words long, n_removed long, kept_sha256 string, kept string")
