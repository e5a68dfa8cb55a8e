"""Approximate nearest neighbours by multi-index hashing of learned, rotated binary codes.

Vectors are scaled to length one, centred and rotated so that their signs keep as much as they can (iterative
quantisation); the signs are the code, cut into bytes. Rotation and radius are learned on a bounded sample. The index
is built over all rows, a chunk of a partition at a time: for each byte position the rows by byte. A query probes
all bytes that differ from its own in at most radius / (number of bytes) bits, which by the pigeonhole
principle finds every code within the radius; those are ranked by the exact cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twintable.llm.base import numbered

#: Rows that rotation and radius are learned on, on average.
SAMPLE = 10_000
#: Share of true neighbours within the sample that the radius must hold.
RECALL = 0.98
#: Rows of an index chunk, and bytes of query vectors that are broadcast at once.
CHUNK, BLOCK_BYTES = 50_000, 64 << 20
#: Bits of a code at most.
BITS = 64

_bits = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_apart = _bits[np.arange(256)[:, None] ^ np.arange(256)[None]]


@dataclass(frozen=True)
class Codes:
    """mean and rotation (dimension x bits); radius in bits."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of bytes."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.packbits((unit - self.mean) @ self.rotation > 0, axis=1, bitorder="little")


def usable(values: list, dimension: int | None = None) -> np.ndarray:
    """Which vectors take part: not null, not zero, finite throughout, of the dimension if one is given."""
    def good(v) -> bool:
        if v is None or not len(v) or dimension is not None and len(v) != dimension:
            return False
        a = np.array([np.nan if x is None else x for x in v], np.float64)
        return bool(np.isfinite(a).all() and a.any())
    return np.array([good(v) for v in values], bool)


def learn(sample: np.ndarray, k: int, rounds: int = 30) -> Codes:
    """Rotation by iterative quantisation, then the smallest radius that holds enough true neighbours."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    dimension = unit.shape[1]
    bits = max(8, min(BITS, dimension // 8 * 8))
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    if axes.shape[1] < bits:  # fewer dimensions than bits
        axes = np.concatenate((axes, np.zeros((dimension, bits - axes.shape[1]))), axis=1)
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))[0]
    projected = centred @ axes
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(projected.T @ np.where(projected @ rotation > 0, 1.0, -1.0))
        rotation = u @ vt
    codes = Codes(mean, axes @ rotation, bits)
    code = codes.of(sample)
    some = np.arange(0, len(sample), max(1, len(sample) // 300))
    near = []
    for q in some:
        cosine = unit @ unit[q]
        cosine[q] = -2
        best = np.argsort(-cosine, kind="stable")[:min(k, len(sample) - 1)]
        near.append(_bits[code[best] ^ code[q]].sum(axis=1))
    near = np.concatenate(near) if near else np.zeros(0)
    radius = int(np.quantile(near, RECALL, method="higher")) if len(near) else bits
    return Codes(mean, axes @ rotation, radius)


def probe(index: list, code: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """Rows with a code within the radius, by probing the byte tables."""
    own = radius // code.shape[1]
    mark = np.zeros(len(code), bool)
    for j, (order, start) in enumerate(index):
        for byte in np.flatnonzero(_apart[query[j]] <= own):
            mark[order[start[byte]:start[byte + 1]]] = True
    found = np.flatnonzero(mark)
    return found[_bits[code[found] ^ query].sum(axis=1, dtype=np.int32) <= radius]


def byte_tables(code: np.ndarray) -> list:
    out = []
    for j in range(code.shape[1]):
        order = np.argsort(code[:, j], kind="stable")
        out.append((order, np.searchsorted(code[order, j], np.arange(257))))
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest others found for each row whose key is divisible by ``every``.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a
    null key or vectors of another length than most of the sample. Rows with equal keys are rows of
    their own, and only the query's own row is left out of its result. Where a radius holds fewer than k rows, all
    rows are ranked for that query. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    own = numbered(vectors, key=key, vector=vector).select("rid", F.col("key").cast("long").alias("key"),
                                                          F.col("vector").cast("array<double>").alias("vector"))
    own = own.filter("key IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    schema = "query_rid long, query_id long, vec_id long, score double"
    total = own.count()
    # a share by hash: each task sends its own few rows, never a full sample
    share = F.pmod(F.xxhash64("key", "rid"), F.lit(1 << 40)) / float(1 << 40)
    sample = own.filter(share * F.lit(float(total)) < SAMPLE).select("vector").toPandas()["vector"].tolist()
    sample = [v for v, good in zip(sample, usable(sample), strict=True) if good]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = [len(v) for v in sample]
    dimension = max(sorted(set(sizes)), key=sizes.count)
    codes = learn(np.array([v for v in sample if len(v) == dimension], np.float64), k)
    asked = own.filter(F.pmod("key", F.lit(every)) == 0)
    blocks = max(1, -(-asked.count() * dimension * 8 // BLOCK_BYTES))

    def pass_over(queries: pd.DataFrame, radius: int) -> DataFrame:
        good = usable(queries["vector"].tolist(), dimension)
        queries = queries[good]
        q = np.array(queries["vector"].tolist(), np.float64).reshape(-1, dimension)
        sent = spark.sparkContext.broadcast((queries["rid"].to_numpy(), queries["key"].to_numpy(), q, codes.of(q) if len(q) else q, codes))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rids, keys, q, q_code, codes = sent.value
            kept = [(np.zeros(0, np.int64), np.zeros(0)) for _ in rids]
            held: list[pd.DataFrame] = []

            def take(rows: pd.DataFrame) -> None:
                rows = rows[usable(rows["vector"].tolist(), dimension)]
                if not len(rows):
                    return
                x = np.array(rows["vector"].tolist(), np.float64)
                norm, rid, key = np.sqrt((x * x).sum(axis=1)), rows["rid"].to_numpy(), rows["key"].to_numpy()
                code = codes.of(x)
                index = byte_tables(code)
                for i in range(len(rids)):
                    found = probe(index, code, q_code[i], radius)
                    found = found[rid[found] != rids[i]]
                    if len(found) > 4 * k:  # a first, rough ranking; rounding cannot move what it drops
                        rough = x[found] @ q[i] / norm[found]
                        found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * np.sqrt((q[i] * q[i]).sum())]
                    score = (x[found] * q[i]).sum(axis=1) / (norm[found] * np.sqrt((q[i] * q[i]).sum()))
                    ids = np.concatenate((kept[i][0], key[found]))
                    scores = np.concatenate((kept[i][1], score))
                    at = best(ids, scores, k)
                    kept[i] = ids[at], scores[at]

            for batch in batches:
                held.append(batch)
                if sum(map(len, held)) >= CHUNK:
                    take(pd.concat(held))
                    held = []
            if held:
                take(pd.concat(held))
            n = [len(a) for a, _ in kept]
            yield pd.DataFrame({"query_rid": np.repeat(rids, n), "query_id": np.repeat(keys, n),
                                "vec_id": np.concatenate([a for a, _ in kept]) if kept else [],
                                "score": np.concatenate([b for _, b in kept]) if kept else []})

        ranked = Window.partitionBy("query_rid", "query_id").orderBy(F.desc("score"), "vec_id")
        return (own.mapInPandas(work, schema).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k))

    results = []
    for block in range(blocks):
        queries = asked.filter(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == block).toPandas()
        if not len(queries):
            continue
        found = pass_over(queries, codes.radius)
        if codes.radius < BITS and total > k:
            full = found.groupBy("query_rid").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_rid").toPandas()["query_rid"]
            thin = queries[~queries["rid"].isin(full)]
            if len(thin):
                found = found.filter(~F.col("query_rid").isin(thin["rid"].tolist())) if len(thin) < 1000 else found.join(
                    spark.createDataFrame(thin[["rid"]]).withColumnRenamed("rid", "query_rid"), "query_rid", "left_anti")
                found = found.unionByName(pass_over(thin, BITS * 2))
        results.append(found)
    out = results[0] if results else spark.createDataFrame([], schema + ", rank int")
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
