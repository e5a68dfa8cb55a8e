"""Near duplicates by exact Jaccard similarity of word shingles: SimHash fingerprints first, then a prefix join, each
link verified on the sets.

Each distinct set has a fingerprint; those within ``RADIUS`` bits are joined by their keys as in ``simhash``, verified,
and joined to classes. Fingerprints miss pairs, so a prefix join finds the rest; it leaves out pairs of one class.

Shingles have one order in all texts: rare ones first (counts over all texts), then by hash. Two sets of similarity
t have a shingle in common among the first size - ceil(t * size) + 1 of each, so these are a text's keys, and
no pair is missed. A shingle that one text alone has is no key. Texts with a key in common meet in a task, which hands on
pairs that sizes and parity bitmaps (a lower bound of the differing shingles) allow; the sets themselves decide.

A group of a key is compared by distance in its order, a range of distances a round, and pairs that earlier rounds
have linked already, by whatever path, are left out: a large group of copies costs about its size, not its square.
Similar texts share many keys and would be met at each, so the first round takes the ``FIRST`` rarest of each only.

A group of texts from one template, too different to be linked, would be handed on by the square of its size: short
bitmaps tell little of long texts. Rounds beyond neighbours compare parity bitmaps as long as the sets ask for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintable.llm import simhash, tally
from twintable.llm.base import gram_hashes, numbered, release_memory, small_side, text_bytes, word_hashes
from twintable.llm.components import components
from twintable.session import durable

#: 64-bit words of a parity bitmap.
BITMAP = 4
#: Bits for each shingle of a longer parity bitmap, 64-bit words that it has at most, and words compared at a time.
SHARPER, LONGEST, GATHERED = 8, 256, 1 << 16
#: Shingles are counted by this many leading bits; what shares them counts as one, which keeps an order.
COUNTED = np.uint64(0xFFFFFFFFFF000000)
#: Differing bits of fingerprints whose texts are compared first.
RADIUS = 2
#: Keys of a text that take part in the first round of the prefix join.
FIRST = 3
#: By how much each round goes further; the first compares neighbours.
REACH = 8

_none = np.zeros(0, np.int64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Rising distinct hashes; a text with fewer words than a shingle is one shingle."""
    units = word_hashes((text or "").encode().lower())[0]
    return np.unique(gram_hashes(units, min(words, len(units)))) if len(units) else np.zeros(0, np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is 1 if it is set in over half of them."""
    return int(np.packbits(simhash.byte_counts(h) * 2 > len(h), bitorder="little").view(np.int64)[0])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def prefix(h: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """Keys of a set of shingles."""
    order = np.lexsort((h, counts))[:len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]
    return h[order[counts[order] > 1]]


def bitmap(h: np.ndarray, words: int = BITMAP) -> bytes:
    """Parity of the number of shingles at each bit."""
    n = np.bincount((h & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits((n & 1).astype(np.uint8)).tobytes()


def long_bitmap(h: np.ndarray) -> bytes:
    """A bitmap whose length is in proportion to the set, a power of two: halves of a longer one fold to a shorter one."""
    return bitmap(h, 1 << (max(BITMAP, min(LONGEST, len(h) * SHARPER // 64)) - 1).bit_length())


def most_differing(i: np.ndarray, j: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Shingles that one of rows i and j has alone, at the threshold."""
    return (size[i] + size[j]) * ((1 - least) / (1 + least)) + 1e-9


def possible(i: np.ndarray, j: np.ndarray, size: np.ndarray, bits: np.ndarray, least: float) -> np.ndarray:
    """Whether the similarity of rows i and j can reach the threshold."""
    a, b = size[i], size[j]
    differing = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
    return (np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9) & (differing <= most_differing(i, j, size, least))


class LongBitmaps:
    """Long bitmaps of rows, end to end."""

    def __init__(self, bitmaps: Sequence[bytes]) -> None:
        self.words = np.array([len(x) // 8 for x in bitmaps], np.int64)
        self.start = np.cumsum(self.words) - self.words
        self.data = np.frombuffer(b"".join(bitmaps), np.uint64)

    def folded(self, rows: np.ndarray, words: int, to: int) -> np.ndarray:
        """Bitmaps of rows that have so many words each, folded to fewer."""
        found = self.data[self.start[rows][:, None] + np.arange(words)]
        return found if to == words else np.bitwise_xor.reduce(found.reshape(len(rows), -1, to), axis=1)

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of rows i and j at the length of the shorter one."""
        out = np.zeros(len(i), np.int64)
        both = self.words[i] * 2 * LONGEST + self.words[j]
        for lengths in np.unique(both).tolist():
            a, b = divmod(lengths, 2 * LONGEST)
            alike, to = np.flatnonzero(both == lengths), min(a, b)
            for at in range(0, len(alike), step := GATHERED // max(a, b)):
                some = alike[at:at + step]
                out[some] = np.bitwise_count(self.folded(i[some], a, to) ^ self.folded(j[some], b, to)).sum(axis=1, dtype=np.int64)
        return out


def pairs_in(keys: np.ndarray, root: np.ndarray, size: np.ndarray, bits: np.ndarray, low: int, high: int, least: float,
             long: Sequence[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Possible pairs of different classes, at distances from ``low`` below ``high`` among rows with an equal key (sorted).

    ``long`` has the rows' long bitmaps, where those are compared too.
    """
    if not len(keys):
        return _none, _none
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    n = np.diff(np.append(start, len(keys)))
    left, right = [_none], [_none]
    closer = None if long is None else LongBitmaps(long)

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        ok = possible(i, j, size, bits, least)
        i, j = i[ok], j[ok]
        if closer is not None and len(i):
            ok = closer.differing(i, j) <= most_differing(i, j, size, least)
            i, j = i[ok], j[ok]
        left.append(i)
        right.append(j)

    if high <= 64:
        end, at = np.repeat(start + n, n), np.arange(len(keys))
        for d in range(low, high):
            at = at[at + d < end[at]]
            if not len(at):
                break
            i = at[root[at] != root[at + d]]
            keep(i, i + d)
    else:
        for s, m in zip(start[n > low].tolist(), n[n > low].tolist(), strict=True):
            own = root[s:s + m]
            found, of, count = np.unique(own, return_inverse=True, return_counts=True)
            small = of != np.argmax(count)
            for k in np.flatnonzero(small).tolist():
                j = np.concatenate((np.arange(max(0, k - high + 1), max(0, k - low + 1)), np.arange(min(m, k + low), min(m, k + high))))
                j = j[(own[j] != own[k]) & (~small[j] | (j > k))]
                keep(np.full(len(j), s + k), s + j)
    return np.concatenate(left), np.concatenate(right)


def _candidates(keys: DataFrame, low: int, high: int, least: float) -> DataFrame:
    """(a, b) of nodes to be verified, from rows of key, node, root, size, bits and, where they are compared too, long."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if batch is not None and (not len(batch) or batch["key"].iloc[0] == batch["key"].iloc[-1]):
                continue
            whole = pd.concat(held) if held else None
            if whole is None or not len(whole):
                continue
            # all but the last key of a batch are complete
            done = (whole["key"] != batch["key"].iloc[-1]).to_numpy() if batch is not None else np.ones(len(whole), bool)
            rows, held = whole[done], [whole[~done]]
            bits = np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(-1, BITMAP)
            i, j = pairs_in(rows["key"].to_numpy(), rows["root"].to_numpy(), rows["size"].to_numpy(), bits, low, high, least,
                            rows["long"].tolist() if "long" in rows else None)
            node = rows["node"].to_numpy()
            yield pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])}).drop_duplicates()

    # dealt by a hash of the key: dealt by the key itself, the exchange would be left to a join by key before it,
    # which adaptive execution may turn into a broadcast join that reads a key's rows in several tasks
    return keys.repartition(F.xxhash64("key")).sortWithinPartitions("key", "node").mapInPandas(meet, "a long, b long").distinct()


def _of_nodes(docs: DataFrame, nodes: DataFrame, make: Callable[[str | None], object], kind: str) -> DataFrame:
    """node and data, made from the text of each of ``nodes`` (a column rid); no other texts are taken up."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            release_memory()
            for at in range(0, len(batch), 256):
                some = batch.iloc[at:at + 256]
                yield pd.DataFrame({"node": some["rid"], "data": [make(t) for t in some["text"]]})

    return durable(docs.join(small_side(durable(nodes)), "rid").select("rid", "text").mapInPandas(made, f"node long, data {kind}"))


def _verified(pairs: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs whose sets are as similar as asked; only texts in a pair are taken up again."""
    named = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    found = _of_nodes(docs, named, lambda t: shingles(t, words).view(np.int64), "array<long>")
    own = lambda c, s: found.select(F.col("node").alias(c), F.col("data").alias(s))
    both = pairs.join(own("a", "x"), "a").join(own("b", "y"), "b").select(
        "a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return both.filter(F.col("both") >= (least - 1e-12) * F.greatest(F.lit(1), F.col("sum") - F.col("both"))).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, words: int, least: float) -> DataFrame | None:
    """(node, root): classes of ``nodes`` (row numbers, one for each distinct set, with its fingerprint f0) that verified
    pairs connect; None without any. ``docs`` has rid and text of all rows."""

    def joined(pairs: DataFrame, member: DataFrame | None) -> DataFrame | None:
        """The classes with those that similar pairs connect."""
        if pairs.isEmpty():
            return member
        edges = durable(_verified(pairs, docs, words, least))
        if edges.isEmpty():
            return member
        if member is not None:
            edges = edges.union(member.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return durable(components(edges))

    alike = simhash.links(nodes.select("node", "f0"), ["f0"], RADIUS, fuzzy=False)
    member = joined(durable(alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()), None)
    total = text_bytes(docs)
    batches, buckets = tally.batched(docs, total), tally.buckets_for(total)

    def ask(rows: pd.DataFrame) -> Iterator[np.ndarray]:
        return (shingles(t, words) & COUNTED for t in rows["text"])

    def keyed(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        wanted = answers["bucket"] < 0
        mine = set(chain.from_iterable(answers.loc[wanted, "nodes"]))
        sets = [shingles(t, words) for t in rows["text"]]
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        counts = tally.answer(every & COUNTED, answers[~wanted]) if len(every) else every
        found, places, nodes, sizes, bits, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [], [], 0
        for rid, h in zip(rows["rid"].tolist(), sets, strict=True):
            c, at = counts[at:at + len(h)], at + len(h)
            keys = prefix(h, c, least) if len(h) and rid in mine else h[:0]
            if len(keys):
                found.append(keys.view(np.int64))
                places.append(np.arange(len(keys)))
                nodes.append(rid)
                sizes.append(len(h))
                bits.append(bitmap(h))
        times = [len(f) for f in found[1:]]
        return pd.DataFrame({"key": np.concatenate(found), "place": np.concatenate(places), "node": np.repeat(np.array(nodes, np.int64), times),
                             "size": np.repeat(np.array(sizes, np.int64), times),
                             "bits": np.repeat(np.array(bits, object), times)})

    asked = tally.totals(tally.ask(batches, ask, buckets)).withColumn("nodes", F.lit(None).cast("array<long>"))
    mine = tally.batched(nodes.select(F.col("node").alias("rid")), total).groupBy("batch").agg(F.collect_list("rid").alias("nodes"))
    known = asked.unionByName(mine.select("batch", F.lit(-1).alias("bucket"), F.lit(b"").alias("counts"), "nodes"))
    keys = durable(batches.groupBy("batch").cogroup(known.groupBy("batch")).applyInPandas(keyed, "key long, place long, node long, size long, bits binary"))
    largest = keys.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    low, high, some, longer = 1, 2, keys.filter(F.col("place") < FIRST), None
    while low < largest:
        live = some.withColumn("root", F.col("node"))
        if member is not None:
            live = some.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = live.groupBy("key").agg(F.count("*").alias("n"), (F.min("root") < F.max("root")).alias("mixed"))
        live = live.join(mixed.filter((F.col("n") > low) & F.col("mixed")).select("key"), "key").select("key", "node", "root", "size", "bits")
        if low > 1:
            if longer is None:  # rows of later rounds are among those of this one
                live = durable(live)
                longer = _of_nodes(docs, live.select(F.col("node").alias("rid")).distinct(), lambda t: long_bitmap(shingles(t, words)), "binary")
            live = live.join(longer.withColumnRenamed("data", "long"), "node").select("key", "node", "root", "size", "bits", "long")
        member = joined(durable(_candidates(live, low, high, least)), member)
        if some is keys:
            low, high = high, high * REACH
        some = keys
    return member


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """``rid``, ``key`` and ``root`` (the class, by one of its row numbers) of each row.

    Rows are of one class if a chain of pairs with a Jaccard similarity of ``least`` or more connects them. Words are parted by
    ASCII white space after lower-casing A-Z. Null, empty and blank texts are one class. Repeated rows are rows
    of one class, and rows with a null key take part.
    """
    own = numbered(docs, key=key, text=text)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests, prints = [], []
            for t in batch["text"]:
                h = shingles(t, words)
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                prints.append(fingerprint(h))
            yield batch[["rid", "key"]].assign(digest=digests, f0=np.array(prints, np.int64))

    prints = durable(own.mapInPandas(digest, "rid long, key long, digest binary, f0 long"))
    nodes = durable(prints.groupBy("digest").agg(F.min("rid").alias("node"), F.min("f0").alias("f0")))
    member = links(own.select("rid", "text"), nodes, words, least)
    placed = nodes.withColumn("root", F.col("node")) if member is None else (
        nodes.join(member, "node", "left").withColumn("root", F.coalesce("root", "node")))
    return prints.join(placed, "digest").select("rid", "key", "root")
