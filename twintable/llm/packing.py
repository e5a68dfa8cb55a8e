"""Packing documents into sequences, in order, by dynamic programming.

The tokens of a task's documents form one stream in input order. Windows of at most ``size`` tokens
are cut from it so that padding plus penalties for cut documents is smallest. Candidates for cuts
are ends of documents (free), ends of sentences, and, in a text without them for long, any
``size / 8`` tokens (dear). The cheapest way to each candidate takes the best of the candidates less than
``size`` tokens before: a monotone queue holds that minimum, as padding is linear in the length.
A window whose length is a power of two needs no padding, which the last window of a task uses: it
is cut into powers of two. Nothing is shuffled: pieces come out where the documents were read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from twintable.llm.base import STORES, trim_memory

SIZE = 4096
END = 2
#: What a cut costs, in tokens of padding: after a sentence, and elsewhere.
SENTENCE, ANYWHERE = 8, 64
#: Tokens that are planned at a time; what is left over starts the next plan.
PLAN = 1 << 20
#: Known chunks of text at most (some 170 bytes each); beyond, those that few calls have met are forgotten, which
#: changes no result.
KNOWN = 1_500_000

#: Bytes of words that are only a-z and letters from U+00C0 to U+00FF (lead byte C3); other leads are not among them.
LETTERS = b"abcdefghijklmnopqrstuvwxyz\xc3" + bytes(sorted({*range(0x80, 0xC0)} - {0x97, 0xB7}))
MARKS = (b".", b",")

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")


class Chunks:
    """Token ids of texts. A text is cut at ASCII white space, which the tokenizer drops anyway, and
    ids of chunks seen before are not made again."""

    def __init__(self, path: str, known: int = KNOWN) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.known = known
        self.tokenizer = Tokenizer.from_file(path)
        # what the byte-level splitter makes of each byte of a two-byte letter
        self.letters = {x: y for b in range(0x80, 0xC0) for x, y in zip(
            bytes((0xC3, b)), ByteLevel(add_prefix_space=False).pre_tokenize_str(bytes((0xC3, b)).decode())[0][0],
            strict=True)}
        self.enders = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.enders[k] = token.endswith("</w>") and token[:-4].rstrip("\"')").endswith((".", "!", "?"))
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int32)
        self.size = np.zeros(1 << 16, np.int32)
        self.met = np.zeros(1 << 16, np.int32)  # calls that had the chunk
        self.used = 0
        for mark in MARKS:
            ids = self.plainly(mark)
            self.store([mark], ids, np.array([len(ids)]))

    def forget(self) -> None:
        """Keeps the chunks that most calls have met, up to half of ``known``."""
        names, met = list(self.number), self.met
        some = np.flatnonzero(met[:len(names)] > 1)
        some = some[np.argsort(-met[some], kind="stable")][:self.known // 2]
        some = some[some >= len(MARKS)]
        ids, size = self.gather(some)
        self.clear()
        self.store([names[k] for k in some.tolist()], ids, size)
        self.met[len(MARKS):len(self.number)] = met[some] // 2

    def store(self, chunks: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        """Takes in new chunks, whose ids follow each other."""
        n, k = len(ids), len(self.number)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while k + len(chunks) > len(self.first):
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
            self.size = np.concatenate((self.size, np.zeros_like(self.size)))
            self.met = np.concatenate((self.met, np.zeros_like(self.met)))
        self.ids[self.used:self.used + n] = ids
        self.size[k:k + len(chunks)] = size
        self.first[k:k + len(chunks)] = self.used + np.cumsum(size) - size
        self.used += n
        self.number.update(zip(chunks, range(k, k + len(chunks)), strict=True))

    def plainly(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known chunks, one after the other, and how many each has."""
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        index = np.repeat((self.first[at] - ends + size).astype(np.int32), size)
        index += np.arange(total, dtype=np.int32)
        return self.ids[index], size

    def learn(self, chunks: set[bytes]) -> None:
        """Ids of new chunks. Plain words, which normalising and splitting leave as they are, go to the
        tokenizer's model by themselves; a word with one mark behind is put together."""
        number = self.number
        odd = {c: c.translate(None, LETTERS) for c in chunks}
        marked = [c for c, other in odd.items() if other in MARKS and c[-1:] == other and len(c) > 1]
        plain = [c for c, other in odd.items() if not other]
        words = [w for w in {*plain, *(c[:-1] for c in marked)} if w not in number]
        if words:
            parts = [[t.id for t in self.tokenizer.model.tokenize(
                w.decode().lower().encode().decode("latin-1").translate(self.letters))] for w in words]
            self.store(words, np.array(list(chain.from_iterable(parts)), np.uint32),
                       np.fromiter(map(len, parts), np.int32, len(parts)))
        if marked:
            pairs = np.array([(number[c[:-1]], number[c[-1:]]) for c in marked], np.int64)
            ids, size = self.gather(pairs.ravel())
            self.store(marked, ids, size.reshape(-1, 2).sum(axis=1))
        for c in odd:
            if c not in number:
                ids = self.plainly(c)
                self.store([c], ids, np.array([len(ids)]))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty.

        Arrow lower-cases A-Z, splits and numbers the distinct chunks; only those are looked up one by one.
        """
        if len(self.number) > self.known:
            self.forget()
        parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
        coded = parts.flatten().dictionary_encode()
        chunks = coded.dictionary.cast(pa.large_binary()).to_pylist()
        at = list(map(self.number.get, chunks))
        if None in at:
            self.learn(set(chunks).difference(self.number))
            at = list(map(self.number.get, chunks))
        at = np.array(at, np.int32)
        self.met[at] += 1
        at = at[coded.indices.to_numpy()] if len(coded) else at
        ids, size = self.gather(at)
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(parts.value_lengths().to_numpy())]
        return np.split(ids, ends[:-1]) if len(ends) else []


@lru_cache(1)
def chunks_of(path: str, known: int) -> Chunks:
    """The store of this Python worker, which its later tasks find filled; other work drops it."""
    return Chunks(path, known)


STORES.append(chunks_of.cache_clear)


def cuts(ends: list[int], ids: np.ndarray, enders: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, in order, and what each costs. 0 is not among them."""
    total = len(ids)
    cost = np.full(total + 1, 255, np.uint8)
    step = max(1, size // 8)
    cost[step::step] = ANYWHERE
    cost[1:][enders[ids]] = SENTENCE
    cost[ends] = 0
    cost[total] = 0
    cost[0] = 255
    at = np.flatnonzero(cost < 255)
    return at, cost[at]


def plan(at: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """Ends of the cheapest windows; the last one is at[-1], and no window is longer than size."""
    n = len(at)
    places, price = [0, *at.tolist()], [0, *cost.tolist()]
    best, back = [0] * (n + 1), [0] * (n + 1)
    where = {0: 0}
    powers = [1 << k for k in range(size.bit_length() - 1)] if size > 1 else []
    powers = [p for p in powers if p >= size // 2]
    queue: deque[int] = deque([0])  # candidates by rising cost of best + place
    value = [0] * (n + 1)
    for j in range(1, n + 1):
        p = places[j]
        while places[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        cheapest = best[i] + size - p + places[i]
        for power in powers:  # no padding at a power of two
            k = where.get(p - power)
            if k is not None and best[k] < cheapest:
                cheapest, i = best[k], k
        best[j], back[j] = cheapest + price[j], i
        where[p] = j
        value[j] = v = best[j] + p
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out, j = [], n
    while j:
        out.append(places[j])
        j = back[j]
    return out[::-1]


def powers_of(length: int) -> list[int]:
    """The powers of two that a length is the sum of, largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class Packer:
    """Takes documents in order and gives pieces; holds at most ``PLAN`` tokens and one document."""

    def __init__(self, chunks: Chunks, size: int, first_sequence: int, with_ids: bool) -> None:
        self.chunks, self.size, self.sequence, self.with_ids = chunks, size, first_sequence, with_ids
        self.docs: list[tuple] = []  # id, tokens of the document, start within it
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: list, texts: list[str | None]) -> None:
        for doc_id, ids in zip(keys, self.chunks.encode(texts), strict=True):
            self.docs.append((doc_id, len(ids) + 1, 0))
            self.parts += [ids, np.array([END], np.uint32)]
            self.held += len(ids) + 1

    def drain(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate(self.parts)
        left = [n - start for _, n, start in self.docs]
        ends = np.cumsum(left)
        at, cost = cuts(ends.tolist(), ids, self.chunks.enders, self.size)
        found = plan(at, cost, self.size)
        if last:  # cut the last window so that it needs no padding
            begin = found[-2] if len(found) > 1 else 0
            found[-1:] = (begin + np.cumsum(powers_of(found[-1] - begin))).tolist()
        else:  # the next documents may fill the last windows better
            found = found[:-2]
        stop = found[-1] if found else 0
        d, begin, doc_begin = 0, 0, 0
        for end in found:
            offset = 0
            while begin < end:
                doc_end = int(ends[d])
                to = min(end, doc_end)
                doc_id, n, start = self.docs[d]
                piece = ids[begin:to]
                yield (doc_id, start + begin - doc_begin, to - begin, zlib.crc32(piece.astype("<u4").tobytes()),
                       n, self.sequence, offset, piece.astype("<u4").tobytes() if self.with_ids else None)
                offset += to - begin
                begin = to
                if to == doc_end:
                    d, doc_begin = d + 1, doc_end
            self.sequence += 1
        if d < len(self.docs):
            doc_id, n, start = self.docs[d]
            self.docs = [(doc_id, n, start + stop - doc_begin), *self.docs[d + 1:]]
        else:
            self.docs = []
        self.parts, self.held = [ids[stop:]], len(ids) - stop


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE,
         tokenizer: str | None = None, with_ids: bool = False, known: int = KNOWN) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence.

    A null text counts as empty and leaves its end id alone. Null or repeated ids are kept as they
    are: each row is a document of its own. A text of any length is cut into as many sequences as it
    needs. An empty table gives no rows. ``ids`` (little-endian 32-bit) is null without ``with_ids``.
    Sequence numbers are unique, and those of a task follow each other. A Python worker keeps the ids of ``known``
    chunks of text; fewer take less memory and more time.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    own = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    names = [x.split()[0] for x in PIECES.split(", ")]

    def frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        some = list(rows)
        for i in range(0, len(some), 50_000):
            frame = pd.DataFrame(some[i:i + 50_000], columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        packer = Packer(chunks_of(path, known), size, TaskContext.get().partitionId() << 32, with_ids)
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                packer.add(batch.column(0)[i:i + 1000].to_pylist(), batch.column(1)[i:i + 1000].to_pylist())
                if packer.held >= PLAN:
                    for f in frames(packer.drain(False)):
                        yield pa.RecordBatch.from_pandas(f, schema=schema, preserve_index=False)
        for f in frames(packer.drain(True)):
            yield pa.RecordBatch.from_pandas(f, schema=schema, preserve_index=False)

    return own.mapInArrow(work, PIECES)
