import math
from collections import defaultdict

import numpy as np

from twintable.llm import queries, whitening

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, index long, key string, x int, `values` double, component int"


def check(found, rows, most=32):
    """Against numpy, in whole numbers where they are exact."""
    kept = [(k, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for k, v in rows]
    x = np.array([v for _, v in kept], dtype=object)
    n, s = len(kept), x.sum(axis=0)
    centred = np.array((n * x - s).tolist(), float) / n
    v = centred.T @ centred / n
    e = np.sort(np.linalg.eigvalsh(v))[::-1][:most]
    k = min(most, x.shape[1])
    assert len(found) == n * k
    by = defaultdict(list)
    for r in found:
        by[r.vec_id, r.component].append(r)
    deviations = defaultdict(list)
    for (key, _), d in zip(kept, ((n * x - s) ** 2).sum(axis=1), strict=True):
        deviations[key].append(int(d))
    for (key, c), same in by.items():
        assert sorted(r.deviation for r in same) == sorted(deviations[key]) and 1 <= c <= k
    assert {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1
    assert found[0].identity_error <= 1e-8
    for c in range(1, k + 1):
        share = {r.explained for r in found if r.component == c}
        assert len(share) == 1 and math.isclose(share.pop(), e[c - 1] / np.trace(v), rel_tol=1e-6)
    # a component is an eigenvector: projections have the eigenvalue's spread and are what V maps them to
    keys = [key for key, _ in kept]
    if len(set(keys)) == n:
        w = np.array([[by[key, c][0].whitened for c in range(1, k + 1)] for key in keys])
        vectors = np.linalg.pinv(centred) @ w * np.sqrt(e)
        assert np.allclose(np.linalg.norm(vectors, axis=0), 1, atol=1e-7)
        assert np.allclose(v @ vectors, vectors * e, atol=1e-7 * e[0])
        assert np.allclose(centred @ vectors / np.sqrt(e), w, atol=1e-7)


def run(spark, rows, monkeypatch):
    table = spark.createDataFrame([(k, v, 1, "k", 2, 3.0, 4) for k, v in rows], SCHEMA)
    monkeypatch.setattr(queries, "read", lambda *_: table)
    return queries.op11_whitening(spark, "").collect()


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check(queries.op11_whitening(spark, FOLDER).collect(), rows)


def test_odd_vectors_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 2)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    numbers = np.random.default_rng(5).normal(size=(60, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(numbers)]
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf"), 1.0, 1.0, 1.0, 1.0]),
           (105, [1.0, 2.0]), (106, [0.0] * 6), (107, [float("-inf")] * 5), (None, None)]
    check(run(spark, rows + odd, monkeypatch), rows)
    twice = [*rows, (3, rows[3][1]), (None, [9.0] * 5), (None, [-9.0, 1.0, 1.0, 1.0, 0.0])]
    check(run(spark, twice, monkeypatch), twice)


def test_nothing_varies(spark, monkeypatch):
    assert run(spark, [(1, None)], monkeypatch) == []
    found = run(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])], monkeypatch)
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(found)] == [
        (i, c, 2, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = sorted(run(spark, [(i, [float(i), float(i)]) for i in range(4)], monkeypatch))
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-9
