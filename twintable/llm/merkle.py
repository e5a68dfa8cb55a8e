"""Merkle manifest of a table: a tree for each group of rows, and one over the groups' roots.

Places of leaves come from bitmaps, not from a sort. Each group's ids are kept as 64-bit words, of which only
those with a bit are held; partial words of tasks merge by OR. Running sums of their popcounts, in a directory of
three levels so that no window spans a group, say how many ids come before a word, and the bits below an
id's own say how many within it. An equi-join on (group, word) asks that for every row.

Levels are reduced by slot arrays: the leaves with places in one stretch of 3 ** ``levels`` are put at
their slots of an array, and ``levels`` levels are hashed there at once. Their tops are the leaves of the next
round, so rounds are few. Proofs go down the same way: a stretch gets the siblings above it once, not once a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintable.session import durable

FAN = 3
#: Levels that a task hashes at once.
LEVELS = 8
#: Equal rows that a task deals out.
STRETCH = 1 << 13
#: Hex digits of a digest.
DIGITS = 64
#: Ids of a word, and words of one entry of the directory's next level, as powers of two.
WORD_BITS, STEP_BITS = 6, 20
#: The word of rows without an id, before all others.
NO_ID = -(1 << 58)

UP = "group string, block long, size long, node binary, children binary"


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def levels_of(size: int) -> int:
    """Levels above ``size`` leaves."""
    n = 0
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


def tower(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes and ``levels`` levels above them."""
    found = [nodes]
    for _ in range(levels):
        nodes = [digest(b"".join(nodes[i:i + FAN])) for i in range(0, len(nodes), FAN)]
        found.append(nodes)
    return found


def siblings(nodes: list[bytes], i: int) -> bytes:
    """The others of a node's run, left to right."""
    first = i - i % FAN
    return b"".join(nodes[first:i]) + b"".join(nodes[i + 1:first + FAN])


def paths(levels: list[list[bytes]], above: bytes) -> list[bytes]:
    """For each node of the lowest level the siblings from there to the top, and those above the top."""
    found = [above] * len(levels[-1])
    for nodes in reversed(levels[:-1]):
        found = [siblings(nodes, i) + found[i // FAN] for i in range(len(nodes))]
    return found


def fold(node: bytes, place: int, size: int, path: bytes) -> tuple[bytes, bytes]:
    """What a node comes to at the top of a tree of ``size`` leaves, and the rest of the path."""
    at = 0
    while size > 1:
        k = place % FAN
        members = min(FAN, size - place + k)
        others = path[at:at + DIGITS * (members - 1)]
        node = digest(others[:DIGITS * k] + node + others[DIGITS * k:])
        at += len(others)
        place, size = place // FAN, -(-size // FAN)
    return node, path[at:]


def field(column: Column) -> Column:
    """``-`` for a null, else the UTF-8 bytes of the value as text, their number and a colon first."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def numbered_in_order(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``number`` (from 0, in the order of a column): a range sort and one count a partition."""
    held = durable(rows.sort(order)).withColumn("_m", F.monotonically_increasing_id())
    counts = sorted(held.groupBy(F.shiftright("_m", 33).alias("p")).count().collect())
    starts = np.cumsum([0, *[n for _, n in counts]])
    offsets = rows.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(counts, starts, strict=False)], "p long, start long")
    return held.join(F.broadcast(offsets), F.shiftright("_m", 33) == F.col("p")).withColumn(
        "number", F.col("start") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "p", "start")


def directory(leaves: DataFrame) -> DataFrame:
    """(group, word, bits, n, repeats, base, size): the ids of each group as words, and the rows before each word.

    ``repeats`` lists the bits of ids that several rows have, with the number of rows beyond the first.
    """
    words = durable(leaves.groupBy("group", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count("*").alias("n")))
    repeated = words.filter(F.col("n") > F.bit_count("bits")).select("group", "word")
    if repeated.isEmpty():
        words = words.withColumn("repeats", F.lit(None).cast("array<struct<bit:int,more:bigint>>"))
    else:
        ids = leaves.join(repeated, ["group", "word"], "left_semi").groupBy("group", "word", "bit").count().filter("count > 1")
        lists = ids.groupBy("group", "word").agg(F.collect_list(F.struct("bit", (F.col("count") - 1).alias("more"))).alias("repeats"))
        words = words.join(lists, ["group", "word"], "left")
    words = words.withColumn("low", F.shiftright("word", STEP_BITS)).withColumn("high", F.shiftright("word", 2 * STEP_BITS))

    def before(by: list[str], order: str) -> Column:
        window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    lows = words.groupBy("group", "high", "low").agg(F.sum("n").alias("n"))
    highs = lows.groupBy("group", "high").agg(F.sum("n").alias("n")).select(
        "group", "high", before(["group"], "high").alias("base"), F.sum("n").over(Window.partitionBy("group")).alias("size"))
    lows = lows.join(highs, ["group", "high"]).select(
        "group", "low", (F.col("base") + before(["group", "high"], "low")).alias("low_base"), "size")
    within = words.withColumn("base", before(["group", "low"], "word")).drop("high")
    return durable(within.join(lows, ["group", "low"]).select(
        "group", "word", "bits", "n", "repeats", (F.col("base") + F.col("low_base")).alias("base"), "size"))


def places(leaves: DataFrame, words: DataFrame) -> DataFrame:
    """(group, size, place, id, leaf, altered) of every row; rows with one id follow the order of their leaves."""
    own = F.expr("base + bit_count(bits & ~shiftleft(-1L, bit)) + coalesce(aggregate(filter(repeats, r -> r.bit < bit), 0L, (s, r) -> s + r.more), 0L)")
    again = F.coalesce(F.expr("exists(repeats, r -> r.bit = bit)"), F.lit(False))
    ranked = leaves.join(words.drop("n"), ["group", "word"]).select(
        "group", "size", own.alias("place"), "id", "leaf", "altered", again.alias("again"))
    columns = ["group", "size", "place", "id", "leaf", "altered"]
    single = ranked.filter(~F.col("again")).select(*columns)
    if words.filter("repeats IS NOT NULL").isEmpty():
        return single
    # equal leaves count as one here; buckets by leaf keep windows short however many rows an id has
    cells = durable(ranked.filter("again").groupBy(*columns).agg(F.count("*").alias("n")).withColumn(
        "bucket", F.substring(F.hex("leaf"), 1, 4)))
    earlier = Window.partitionBy("group", "place", "bucket").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    buckets = cells.groupBy("group", "place", "bucket").agg(F.sum("n").alias("n"))
    lower = Window.partitionBy("group", "place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("group", "place", "bucket", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("start"))
    runs = cells.withColumn("own", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(buckets, ["group", "place", "bucket"])
    # a leaf that very many rows have is dealt out in parts
    parts = runs.withColumn("part", F.explode(F.expr(f"sequence(0L, n - 1, {STRETCH}L)"))).repartition("group", "place", "leaf", "part")
    many = parts.withColumn("k", F.explode(F.expr(f"sequence(part, least(n, part + {STRETCH}L) - 1)"))).withColumn(
        "place", F.col("place") + F.col("start") + F.col("own") + F.col("k"))
    return single.union(many.select(*columns))


def _slots(rows: pd.DataFrame, first: int) -> np.ndarray:
    """The order that puts rows at their slots from a place on; each slot has exactly one."""
    slot = rows["place"].to_numpy() - first
    order = np.full(len(rows), -1, np.int64)
    order[slot] = np.arange(len(rows))
    if (order < 0).any():
        raise RuntimeError("a slot of the tree has no row, or several: the table changed between two reads")
    return order


def _block(levels: int) -> Column:
    """The stretch of a place."""
    return F.expr(f"place div {FAN**levels}L")


def _packed(nodes: Iterator[bytes]) -> bytes:
    return b"".join(nodes)


def _hexes(packed: bytes) -> list[bytes]:
    text = packed.hex().encode()
    return [text[i:i + DIGITS] for i in range(0, len(text), DIGITS)]


def _left(size: int, done: int, levels: int) -> int:
    """Levels of the next round."""
    return min(levels, max(0, levels_of(size) - done))


def _lowest(placed: DataFrame, levels: int) -> DataFrame:
    """One row for each stretch of leaves: their ids, leaves and altered leaves by slot, and the node above them."""
    schema = UP.replace("children binary", "children binary, ids binary, known binary, altered binary")

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, size = key[1], int(rows["size"].iloc[0])
        rows = rows.iloc[_slots(rows, block * FAN**levels)]
        packed = _packed(rows["leaf"])
        top = tower(_hexes(packed), _left(size, 0, levels))[-1]
        return pd.DataFrame({
            "group": [key[0]], "block": [block], "size": [size], "node": [bytes.fromhex(top[0].decode())],
            "children": [packed], "ids": [rows["id"].to_numpy().tobytes()], "known": [rows["known"].to_numpy().tobytes()],
            "altered": [_packed(b if a is None else a for a, b in zip(rows["altered"], rows["leaf"], strict=True))]})

    whole = placed.withColumn("known", F.col("id").isNotNull()).withColumn("id", F.coalesce("id", F.lit(0))).withColumn("block", _block(levels))
    return durable(whole.groupBy("group", "block").applyInPandas(reduce, schema))


def _reducer(done: int, levels: int):
    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, size = key[1], int(rows["size"].iloc[0])
        packed = _packed(rows["node"].iloc[_slots(rows, block * FAN**levels)])
        top = tower(_hexes(packed), _left(size, done, levels))[-1]
        return pd.DataFrame({"group": [key[0]], "block": [block], "size": [size],
                             "node": [bytes.fromhex(top[0].decode())], "children": [packed]})

    return reduce


def _higher(nodes: DataFrame, rounds: int, first: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the rounds (as ``UP``) above nodes of (group, place, size, node), and the tops; ``first``: rounds before."""
    tables: list[DataFrame] = []
    for r in range(rounds):
        grouped = nodes.withColumn("block", _block(levels)).groupBy("group", "block")
        tables.append(durable(grouped.applyInPandas(_reducer(levels * (r + first), levels), UP)))
        nodes = tables[-1].select("group", F.col("block").alias("place"), "size", "node")
    return tables, nodes


def _spreader(done: int, levels: int):
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = paths(tower(_hexes(row.children), _left(row.size, done, levels)), row.path)
                yield pd.DataFrame({"group": row.group, "place": np.arange(len(found)) + row.block * FAN**levels, "path": found})

    return spread


def _descend(tables: list[DataFrame], above: DataFrame, first: int, levels: int) -> DataFrame:
    """(group, place, path) of the lowest nodes of some rounds, from (group, place, path) of their tops."""
    for r in reversed(range(len(tables))):
        table = tables[r].withColumn("place", F.col("block")).drop("node")
        above = table.join(above, ["group", "place"]).select("group", "block", "size", "children", "path").mapInPandas(
            _spreader(levels * (r + first), levels), "group string, place long, path binary")
    return above


def _rounds(size: int, levels: int) -> int:
    """Rounds that reduce ``size`` leaves; a lone one takes a round too."""
    return max(1, -(-levels_of(size) // levels))


def manifest(docs: DataFrame, *, key: str = "doc_id", group: str = "source",
             fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             altered: dict[str, Column] | None = None, when: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """A proof for every row: key, group, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of its ``fields`` (see ``field``). Leaves of a group ascend by key; every three neighbours
    become the hash of their digests as hex text until one is left, the subroot. Subroots, ordered by group
    (null first, else by UTF-8 bytes), become the root likewise. ``altered`` says what some fields hold by the time of
    checking, in rows for which ``when`` holds: ``folded_root`` is folded from that leaf and the siblings
    of the original table, and ``verified`` says whether it is the root. The proof is the siblings in the order of folding.

    Null keys come first in their group; rows with one key follow the order of their leaves, and equal rows take
    places next to each other. Null fields are told from empty ones. A lone leaf is its subroot, with an
    empty proof if no other group is there. An empty table gives no rows. Other columns play no part.
    """
    names = list(dict.fromkeys([key, group, *fields]))
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    col = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    original = leaf([col[c] for c in fields])
    changed = F.lit(None).cast("binary")
    if altered:
        columns = {c: col[c] for c in fields} | {c: f(col) if callable(f) else f for c, f in altered.items()}
        changed = leaf([columns[c] for c in fields])
        if when is not None:
            changed = F.when(when(col) if callable(when) else when, changed)
    ident = col[key].cast("long")
    leaves = durable(own.select(
        F.coalesce(F.concat(F.lit("1"), col[group].cast("string")), F.lit("0")).alias("group"), ident.alias("id"),
        original.alias("leaf"), changed.alias("altered"))).withColumn(
        "word", F.coalesce(F.shiftright("id", WORD_BITS), F.lit(NO_ID))).withColumn(
        "bit", F.coalesce(F.col("id").bitwiseAND((1 << WORD_BITS) - 1), F.lit(0)).cast("int"))
    low = _lowest(places(leaves, directory(leaves)), levels)
    most = low.agg(F.max("size")).first()[0]
    tables, tops = _higher(low.select("group", F.col("block").alias("place"), "size", "node"), _rounds(most or 0, levels) - 1, 1, levels)

    groups = numbered_in_order(tops.select("group", "size", "node"), "group")
    count = groups.count()
    over = groups.select(F.lit("").alias("group"), F.col("number").alias("place"), F.lit(count).cast("long").alias("size"), "node")
    higher, top = _higher(over, _rounds(count, levels), 0, levels)
    found = top.first()
    root_value = bytes(found["node"]) if found else b""
    ways = _descend(higher, top.select("group", "place", F.lit(b"").alias("path")), 0, levels)
    known = durable(groups.join(ways.select(F.col("place").alias("number"), "path"), "number").select(
        "group", "number", F.col("node").alias("subroot"), "path"))
    starts = _descend(tables, known.select("group", F.lit(0).cast("long").alias("place"), "path"), 1, levels)
    ready = low.withColumn("place", F.col("block")).join(starts, ["group", "place"]).join(
        known.select("group", "number", "subroot"), "group").select(
        "group", "block", "size", "children", "ids", "known", "altered", "path", "number", "subroot")

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root_text = root_value.hex().encode()
        for batch in batches:
            for row in batch.itertuples(index=False):
                nodes = _hexes(row.children)
                now = _hexes(row.altered)
                ways = paths(tower(nodes, _left(row.size, 0, levels)), row.path)
                folded = []
                for i, (node, path) in enumerate(zip(now, ways, strict=True)):
                    at, rest = fold(node, row.block * FAN**levels + i, row.size, path)
                    folded.append(fold(at, row.number, count, rest)[0])
                ids = pd.array(np.frombuffer(row.ids, np.int64), "Int64")
                ids[~np.frombuffer(row.known, bool)] = pd.NA
                yield pd.DataFrame({
                    "key": ids, "group": None if row.group == "0" else row.group[1:],
                    "leaf": [x.decode() for x in nodes], "subroot": row.subroot.hex(), "root": root_text.decode(),
                    "proof_sha256": [hashlib.sha256(p).hexdigest() for p in ways],
                    "folded_root": [x.decode() for x in folded], "verified": [x == root_text for x in folded]})

    return ready.mapInPandas(prove, "key long, group string, leaf string, subroot string, root string, "
                                    "proof_sha256 string, folded_root string, verified boolean")
