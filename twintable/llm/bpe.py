"""Byte-level BPE of whole texts: distinct words are merged once, by a fold of higher-order functions.

1. Texts are split by the pattern in Spark. Tasks number the distinct words of some megabytes of text (a batch) by falling
   frequency and keep the texts as those numbers, in a table with a bucket a group of batches.
2. The distinct words of all batches are merged: neighbours of lowest rank first, ranks from literal arrays in the plan.
   A word is folded once, however many batches have it; groups of more than ``PLACES`` batches are parted.
3. The ids go back to each batch, packed by the task that made them, and are put in the place of the numbers.

Decoding takes each id's bytes from a literal array and concatenates them.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintable.llm.base import small_batches, text_bytes, trim_memory
from twintable.session import scratch_folder

#: Bits of an id.
ID_BITS = 20
#: Bytes of a word that is folded; longer ones are merged with a heap.
LONG = 64
#: Bytes of split text in a batch, in Arrow (each word takes four more), and of text that a bucket holds.
BATCH_BYTES = 64 << 20
BUCKET_BYTES = 32 << 20
#: Bits of a word's place in its batch, and of a batch's number in its task.
PLACE_BITS, NUMBER_BITS = 26, 12
#: Words that are turned to ids at a time.
TEXT_WORDS = 1 << 20
#: Words of batches whose ids are packed at once.
PACKED_WORDS = 1 << 20
#: Batches that one row of a word stands for.
PLACES = 4096
#: Letters and numbers that were assigned after Unicode 13, as code points in hex: fixed values. Java's classes may lack them.
NEW_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC "
    "A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 "
    "10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 "
    "1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F "
    "13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 "
    "1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE "
    "2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF")
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"


def java_pattern(pattern: str) -> str:
    r"""A pattern of the rank files for Java: \s is Unicode white space there, and \p{L} and \p{N} hold newer characters."""

    def added(ranges: str) -> str:
        some = [r.split("-") for r in ranges.split()]
        each = "".join("-".join(rf"\x{{{x}}}" for x in r) for r in some)
        return rf"[\x{{{some[0][0]}}}-\x{{{some[-1][-1]}}}&&[{each}]]"

    letter, number, space = rf"\p{{L}}{added(NEW_LETTERS)}", rf"\p{{N}}{added(NEW_NUMBERS)}", r"\p{IsWhite_Space}"
    return "|".join(_part(p, letter, number, space) for p in pattern.split("|"))


def _part(part: str, letter: str, number: str, space: str) -> str:
    if "[^" in part:
        return part.replace(r"\s", space).replace(r"\p{L}", letter).replace(r"\p{N}", number)
    return part.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\S", f"[^{space}]").replace(r"\s", space)


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _tables(path: str) -> tuple[list[int], list[int], list[int], list[int | None]]:
    """Merges of two neighbouring ids as a hash table without collisions: a shift for each group of pairs, and
    ``pair << ID_BITS | rank`` at the slot that it leads to. Then the ids of the 256 bytes, and what two bytes merge to.

    Groups are placed one after the other, large ones first, at the first shift that finds their slots free.
    """
    ranks = ranks_of(path)
    pairs = np.array([(ranks[t[:i]] << ID_BITS | ranks[t[i:]]) << ID_BITS | rank for t, rank in ranks.items()
                      for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks] or [-1], np.int64)
    key = pairs >> ID_BITS
    shifts, size = len(pairs) // 3 + 1, len(pairs) * 3 // 2 + 1
    while len({*zip((key % shifts).tolist(), (key % size).tolist(), strict=True)}) < len(key):
        size += 1  # two of one group on one slot would stay together at every shift
    group, base = key % shifts, key % size
    order = np.argsort(group, kind="stable")
    shift, slots = [0] * shifts, [-1] * size
    for some in sorted(np.split(order, np.flatnonzero(np.diff(group[order])) + 1), key=len, reverse=True):
        at, d = base[some].tolist(), 0
        while any(slots[(b + d) % size] >= 0 for b in at):
            d += 1
        shift[int(group[some[0]])] = d
        for b, p in zip(at, pairs[some].tolist(), strict=True):
            slots[(b + d) % size] = p
    every = range(256)
    return shift, slots, [ranks[bytes((b,))] for b in every], [ranks.get(bytes((a, b))) for a in every for b in every]


def constant(values: list, kind: str) -> Column:
    """A literal array, as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(word: Column, path: str) -> Column:
    """Ids of the bytes of a word of 1 to ``LONG`` bytes.

    A fold over its length: each step merges the neighbours of lowest rank, the leftmost of equal ones, and looks up what the new
    part makes with those beside it, in the literal table of ranks. ``ranks`` has an entry between any two parts, and
    an empty one before the first and after the last.
    """
    shift, slots, single, double = _tables(path)

    def ids(given: Column) -> Column:
        text = given["text"]  # a character a byte
        n = F.length(text)

        def rank(a: Column, b: Column) -> Column:
            """What two ids merge to; null if nothing, or if one is null."""
            key = a.cast("long") * (1 << ID_BITS) + b
            slot = (key % len(slots) + F.get(given["shift"], (key % len(shift)).cast("int"))) % len(slots)
            return let(F.get(given["slots"], slot.cast("int")), lambda s: F.when(
                F.shiftright(s, ID_BITS) == key, s.bitwiseAND((1 << ID_BITS) - 1).cast("int")))

        def step(state: Column, _: Column) -> Column:
            parts, ranks = state["parts"], state["ranks"]

            def merge(low: Column, p: Column) -> Column:
                """``p``: place of the first of the two."""
                return F.struct(
                    F.concat(F.slice(parts, F.lit(1), p - 1), F.array(low), F.slice(parts, p + 2, F.lit(LONG))).alias("parts"),
                    F.concat(F.slice(ranks, F.lit(1), p - 1),
                             F.array(rank(F.get(parts, p - 2), low), rank(low, F.get(parts, p + 1))),
                             F.slice(ranks, p + 3, F.lit(LONG))).alias("ranks"))

            return let(F.array_min(ranks), lambda low: F.when(low.isNull(), state).otherwise(
                let(F.array_position(ranks, low).cast("int") - 1, lambda p: merge(low, p))))

        codes = F.transform(F.sequence(F.lit(1), n), lambda i: F.ascii(F.substring(text, i, F.lit(1))))
        start = let(codes, lambda c: F.struct(
            F.transform(c, lambda b: F.get(given["single"], b)).alias("parts"),
            F.transform(F.sequence(F.lit(0), n), lambda i: F.get(given["double"], F.get(c, i - 1) * 256 + F.get(c, i))).alias("ranks")))
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["parts"])

    tables = F.struct(F.decode(word, "ISO-8859-1").alias("text"), constant(shift, "int").alias("shift"),
                      constant(slots, "bigint").alias("slots"), constant(single, "int").alias("single"), constant(double, "int").alias("double"))
    return let(tables, ids)


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word of any length: the same merges from a heap of (rank, place)."""
    n = len(word)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    alive = np.ones(n, bool)
    heap = [rank << 40 | i for i in range(n - 1) if (rank := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i = entry & ((1 << 40) - 1)
        if not alive[i]:
            continue
        j = int(after[i])
        if j == n or ranks.get(word[i:after[j]]) != entry >> 40:
            continue  # one of the two has been merged since
        end = int(after[j])
        alive[j], after[i] = False, end
        if end < n:
            before[end] = i
            if (rank := ranks.get(word[i:after[end]])) is not None:
                heapq.heappush(heap, rank << 40 | i)
        p = int(before[i])
        if p >= 0 and (rank := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, rank << 40 | p)
    starts = np.flatnonzero(alive)
    return [ranks[word[a:b]] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)]


#: batch: a number; words by falling frequency; for each text its key and number of words; all
#: texts' words as numbers, first the lowest bytes, then the next, and so on.
CODED = "batch long, words array<string>, longest int, `keys` array<bigint>, counts array<int>, codes binary"


def coded(texts: DataFrame, pattern: str) -> DataFrame:
    """Rows as in ``CODED`` of a table of key, text."""
    parts = texts.select("key", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(java_pattern(pattern)), F.lit(0)).alias("parts"))
    kinds = {"batch": pa.int64(), "words": pa.list_(pa.string()), "longest": pa.int32(), "keys": pa.list_(pa.int64()),
             "counts": pa.list_(pa.int32()), "codes": pa.binary()}

    def emit(rows: list[pa.RecordBatch], batch: int) -> pa.RecordBatch:
        lists = pa.chunked_array([r.column(1) for r in rows]).combine_chunks()
        found = lists.flatten().dictionary_encode()
        order = np.argsort(-np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        codes = number[found.indices.to_numpy()]
        words = found.dictionary.take(pa.array(order))
        longest = pc.max(pc.binary_length(words)).as_py() or 0
        keys = pa.chunked_array([r.column(0) for r in rows]).combine_chunks().cast(pa.int64())
        counts = pc.list_value_length(lists).cast(pa.int32())
        planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([
            pa.array([batch], pa.int64()), one(words.cast(pa.string())), pa.array([longest], pa.int32()), one(keys), one(counts),
            pa.array([planes], pa.binary())], schema=pa.schema(list(kinds.items())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        held, size, number = [], 0, TaskContext.get().partitionId() << NUMBER_BITS
        for batch in batches:
            # about even slices, so that a batch stays near its size
            step = max(1, batch.num_rows // max(1, batch.nbytes // (BATCH_BYTES // 4)))
            for i in range(0, batch.num_rows, step):
                held.append(batch.slice(i, step))
                size += held[-1].nbytes
                if size >= BATCH_BYTES:
                    yield emit(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield emit(held, number)
        held = batch = None
        trim_memory()  # the worker lives on while Spark merges

    return parts.mapInArrow(work, CODED)


def _bucketed(rows: DataFrame, total: int) -> DataFrame:
    """The rows, written in buckets by batch, so that a join by batch moves the other side only."""
    spark, name = rows.sparkSession, f"twintable_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    rows.write.bucketBy(buckets, "batch").option("path", f"{scratch_folder(spark)}/coded").option("compression", "zstd").saveAsTable(name)
    table = spark.table(name).select("*")
    table.count()
    spark.sql(f"DROP TABLE {name}")  # the files stay where they are
    return table


def word_ids(words: DataFrame, longest: int, path: str) -> DataFrame:
    """Adds ``ids`` to rows with a ``word``."""
    whole = F.octet_length("word")
    short = words.filter(whole <= LONG).withColumn("ids", folded(F.encode("word", "UTF-8"), path))
    if longest <= LONG:
        return short

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for batch in batches:
            ids = [[ranks[w]] if w in ranks else merged_long(w, ranks) for w in batch.column("word").cast(pa.binary()).to_pylist()]
            yield batch.append_column("ids", pa.array(ids, pa.list_(pa.int32())))

    return short.union(words.filter(whole > LONG).mapInArrow(work, short.schema))


def _planes(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pack_answers(places: np.ndarray, length: np.ndarray, ids: np.ndarray) -> bytes:
    """Some words of a batch: rising places, number of ids and all ids, the first bytes of all numbers first, compressed."""
    parts = [_planes(x) for x in (np.diff(places, prepend=0), length, ids)]
    return b"".join((np.array([len(x) for x in parts], "<i4").tobytes(), *parts))


def unpack_answers(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = 12 + np.cumsum(np.frombuffer(data[:12], "<i4"))
    steps, length, ids = (_unplanes(data[a:b]) for a, b in zip((12, *ends[:-1]), ends, strict=True))
    return np.cumsum(steps), length, ids


def packed(answers: DataFrame) -> DataFrame:
    """(batch, answer): a row for each batch that some words of a task are from, of a table of places and ids of words."""

    def emit(held: list[tuple[pa.Array, pa.Array]]) -> pa.RecordBatch:
        places, ids = (pa.concat_arrays(x) for x in zip(*held, strict=True))
        at, values = places.flatten().to_numpy(), ids.flatten().to_numpy()
        n = pc.list_value_length(ids).to_numpy()
        start = np.cumsum(n) - n
        order = np.argsort(at, kind="stable")
        at, word = at[order], np.repeat(np.arange(len(n)), pc.list_value_length(places).to_numpy())[order]
        batch, place = at >> PLACE_BITS, at & ((1 << PLACE_BITS) - 1)
        cuts = np.flatnonzero(np.diff(batch, prepend=-1))
        out = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
            length = n[word[a:b]]
            index = np.repeat(start[word[a:b]] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
            out.append(pack_answers(place[a:b], length, values[index]))
        return pa.RecordBatch.from_arrays([pa.array(batch[cuts], pa.int64()), pa.array(out, pa.binary())], ["batch", "answer"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        held, size = [], 0
        for rows in batches:
            if rows.num_rows:
                held.append((rows.column("places"), rows.column("ids")))
                size += len(held[-1][0].flatten())
            if size >= PACKED_WORDS:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    return answers.select("places", "ids").mapInArrow(work, "batch long, answer binary")


def encode(docs: DataFrame, *, key: str = "doc_id", text: str = "text", ranks: str | None = None,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(key, ids) of every row: each match of the pattern is encoded by itself, without special tokens.

    ``ranks`` is the path of a rank file, which must hold the 256 single bytes. Null texts count as empty and have no ids. A match of any
    length is encoded whole. Null and repeated keys, and repeated rows, are rows of their own. An empty table gives no rows. Other
    columns are left behind.
    """
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    small_batches(docs.sparkSession)
    table = _bucketed(coded(own, pattern), text_bytes(own))
    size = table.agg(F.count("*").alias("n"), F.max("longest").alias("longest")).first()
    words = table.select("batch", F.posexplode("words").alias("place", "word"))
    share = F.pmod(F.xxhash64("batch"), F.lit(-(-size["n"] // PLACES) or 1))
    distinct = words.groupBy("word", share.alias("share")).agg(F.collect_list(
        F.call_function("shiftleft", F.col("batch"), F.lit(PLACE_BITS)).bitwiseOR(F.col("place").cast("long"))).alias("places"))
    answers = packed(word_ids(distinct.select("word", "places"), size["longest"] or 0, path)).groupBy("batch").agg(
        F.collect_list("answer").alias("answers"))
    both = table.select("batch", "keys", "counts", "codes").join(answers, "batch", "left").select("keys", "counts", "codes", "answers")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                keys, counts = row.column(0).flatten(), row.column(1).flatten().to_numpy()
                codes = np.ascontiguousarray(np.frombuffer(row.column(2)[0].as_py(), np.uint8).reshape(4, -1).T).view("<u4").ravel()
                found = [unpack_answers(x) for x in row.column(3).flatten().to_pylist()] or [(np.zeros(0, np.int64),) * 3]
                places, each, values = (np.concatenate(x) for x in zip(*found, strict=True))
                length, start = np.empty_like(each), np.empty_like(each)
                length[places], start[places] = each, np.cumsum(each) - each
                ends = np.cumsum(counts)
                at = 0
                while at < len(counts):  # some texts at a time
                    first = ends[at] - counts[at]
                    to = max(at + 1, int(np.searchsorted(ends, first + TEXT_WORDS, "right")))
                    part = codes[first:ends[to - 1]]
                    n = length[part]
                    upto = np.cumsum(n)
                    ids = values[np.repeat(start[part] - upto + n, n) + np.arange(int(n.sum()))] if len(part) else values[:0]
                    offsets = np.concatenate(([0], upto))[np.concatenate(([0], ends[at:to] - first))]
                    yield pa.RecordBatch.from_arrays(
                        [keys[at:to], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))],
                        schema=pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()))]))
                    at = to

    return both.mapInArrow(work, "key long, ids array<int>")


def decoded(ids: Column, ranks: str | None = None) -> Column:
    """Bytes of an array of ids."""
    pieces = ranks_of(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts: list[str | None] = [None] * (max(pieces.values()) + 1)
    for piece, rank in pieces.items():
        texts[rank] = piece.hex()
    return F.unhex(F.array_join(let(constant(texts, "string"), lambda t: F.transform(ids, lambda i: F.get(t, i))), ""))
