import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from twintable.llm import decontaminate, licenses, neighbours, ngrams, queries, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(
        [(10**6, "a b a b a b c"), (10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, "one"), (10**6 + 4, "one two"), (10**6 + 4, "one two"),
         (None, "a b a\tb"), (10**6 + 5, "\n\n \n"), (10**6 + 6, "word " * 40_000), (None, None),
         (10**6 + 7, "first line\nReleased under the  MIT license!\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy "
          "of this software and associated documentation files (the Software), to deal in the Software without restriction.\n")],
        "doc_id long, text string")
    return table.union(odd).selectExpr("doc_id", "text", "1 AS rid", "2 AS batch", "'k' AS key", "3 AS found_0", "4 AS hits")


def test_backoff_scores(docs):
    rows = docs.collect()
    expected = sorted((str(r.doc_id), n, s) for r, (n, s) in zip(rows, ngrams.brute_force([r.text for r in rows]), strict=True))
    found = ngrams.score(docs).collect()
    got = sorted((str(r.key), r.n_words, r.log_score) for r in found)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9, abs_tol=1e-9)
    assert all((r.mean_score is None) == (r.n_words == 0) for r in found)


def test_backoff_counts_from_one_or_more(spark):
    texts = ["a b c d", "a b c e", "x", "", None, "a b c d", " \t\n", "b c " * 400]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS rid", "2 AS batch")
    for least in (1, 2, 3):
        found = {r.key: r for r in ngrams.score(docs, least=least).collect()}
        for i, (n, s) in enumerate(ngrams.brute_force(texts, least)):
            assert found[i].n_words == n and math.isclose(found[i].log_score, s, rel_tol=1e-9, abs_tol=1e-9)
    every = 4 + 4 + 1 + 4 + 800
    one = next(r for r in ngrams.score(docs).collect() if r.key == 1)
    # c(a) / N, c(ab) / c(a), c(abc) / c(ab), c(bce) / c(bc): what occurs once counts as once
    assert math.isclose(one.log_score, math.log(3 / every * 1 * 1 * 1 / 403))
    assert ngrams.score(docs.limit(0)).count() == 0


def test_benchmark_windows(spark, docs):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text")
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "one two"), (None, "word word word word word word"), (903, "word " * 6), (903, "word " * 6)],
                                "item_id long, text string")
    items = items.union(odd)
    text = {r.item_id: decontaminate.shingles(r.text) for r in items.collect() if r.item_id is not None}
    found = decontaminate.contaminated(docs, items).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    hits = 0
    for r in found:
        if r.key is None or len(texts[r.key]) > 1:
            continue
        h, expected = decontaminate.shingles(texts[r.key][0]), set()
        for item, g in text.items():
            n = len(g)
            if n and any(decontaminate.similarity(h[i:i + n], g) >= 0.8 for i in np.flatnonzero(np.convolve(np.isin(h, g), np.ones(n), "valid") >= 1)) if n and len(h) >= n else False:
                expected.add(item)
        if r.key == 10**6 + 6:
            assert set(r.item_ids) == expected | {-1} and 903 in expected
        else:
            assert set(r.item_ids) == expected and r.item_ids == sorted(r.item_ids)
        hits += len(expected)
    assert hits >= 3 and len(found) == docs.count()
    assert not any(r.item_ids for r in decontaminate.contaminated(docs, items.limit(0)).collect())
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 12)) for _ in range(200)]
    for radius, blocks in ((20, 4), (7, 4), (15, 8)):
        index = decontaminate.Index(list(range(200)), texts, 5, radius, blocks)
        prints = index.prints.copy()
        for _ in range(radius):
            prints ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
        got = set(zip(*(x.tolist() for x in index.within(prints, 8)), strict=True))
        close = np.bitwise_count(prints[:, None] ^ index.prints[None]) <= radius
        assert got == set(zip(*(x.tolist() for x in np.nonzero(close)), strict=True))


def test_a_benchmark_in_blocks(docs, spark, monkeypatch):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    whole = sorted(map(str, decontaminate.contaminated(docs, items).select("key", "item_ids", "similarity").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2500)
    assert sorted(map(str, decontaminate.contaminated(docs, items).select("key", "item_ids", "similarity").collect())) == whole


def test_licences(docs):
    grams = {n: set(licenses.bigrams_of(t)) for n, t in licenses.TEMPLATES.items()}

    def plain(text):
        import re
        units = set(text.split("\n")) | set(re.split("\n[ \t\r]*\n", text)) if text is not None else set()
        hits = []
        for u in units:
            g = set(licenses.bigrams_of(u))
            scores = [(2.0 * len(g & t) / (len(g) + len(t)), n) for n, t in grams.items()]
            top = max(s for s, _ in scores)
            if g and top >= 0.8:
                hits.append((-top, min(n for s, n in scores if s == top)))
        return (min(hits)[1], -min(hits)[0], len(hits)) if hits else (None, None, 0)

    expected = sorted(str((r.doc_id, *plain(r.text))) for r in docs.collect())
    found = licenses.scan(docs)
    assert sorted(str(tuple(r)) for r in found.collect()) == expected
    assert found.filter("license IS NOT NULL").count() >= 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Generate" not in plan
    assert licenses.scan(docs.limit(0)).count() == 0


def nearest(ids, x, every, k):
    n = np.sqrt((x * x).sum(axis=1))
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1) / (n * n[i])
        rest = np.delete(np.arange(len(ids)), i)
        yield i, [(int(ids[j]), float(s[j])) for j in rest[np.lexsort((ids[rest], -s[rest]))][:k]]


def test_neighbours_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = defaultdict(list)
    for r in queries.op6_neighbours(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    rows = table.toPandas()
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), np.float64)
    hit = n = 0
    for i, best in nearest(ids, x, 50, 5):
        got = found.pop(int(ids[i]))
        assert [r for r, _, _ in got] == [1, 2, 3, 4, 5]
        hit += len({v for v, _ in best} & {v for _, v, _ in got})
        n += 5
        for (_, v, s) in got:
            j = int(np.flatnonzero(ids == v)[0])
            assert math.isclose(s, float(x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])), rel_tol=1e-12)
    assert not found and hit / n >= 0.9


def test_neighbours_odd_rows(spark):
    v = lambda *a: [float(x) for x in a]
    rows = [(0, v(1, 0, 0)), (1, None), (2, []), (3, v(0, 0, 0)), (4, [1.0, None, 0.0]), (5, v(math.nan, 1, 0)), (6, v(math.inf, 1, 0)),
            (7, v(1, 1)), (8, v(2, 0, 0)), (9, v(1, 0, 0)), (9, v(1, 0, 0)), (None, v(1, 0, 0)), (50, v(0, 1, 0)), (51, v(0, 2, 0.1))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rid", "2 AS query_rid")
    found = neighbours.search(table, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(0, 8), (0, 9), (0, 9), (50, 51), (50, 0), (50, 8)]
    assert [r.score for r in found[:3]] == [1.0, 1.0, 1.0]
    few = neighbours.search(table.filter("vec_id IN (0, 8)"), k=3).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 8)]
    assert neighbours.search(table.limit(0)).count() == 0
    assert neighbours.search(table.filter("vec_id = 1")).count() == 0


def test_many_equal_vectors(spark):
    table = spark.range(400).selectExpr("id AS vec_id", "array(1F, 2F, 3F, cast(id % 400 > 390 AS FLOAT)) AS embedding")
    found = neighbours.search(table.repartition(5), k=5).collect()
    for q in range(0, 400, 50):
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [i for i in range(7) if i != q][:5]


def test_archives_round_trip(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30k")  # records across splits
    try:
        table = spark.read.parquet(f"{FOLDER}/pages.parquet")
        big = "x" * 1500 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nX-Key: 9\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1"
        odd = [(10**6, "u", big), (10**6 + 1, "u\r\nX-Key: 7", big), (10**6 + 2, None, ""), (10**6 + 3, "http://é", None), (None, "u", "é" * 800),
               (None, "u", "é" * 800), (5 * 10**6, "u", "WARC/1.1"), (5 * 10**6, "u", "WARC/1.1\r\nContent-Length: 0\r\n\r\n"),
               (6 * 10**6, "v", "y" * 2000), (6 * 10**6, "v", "y" * 2000), (7, "w", "long " * 60_000)]
        table = table.union(spark.createDataFrame(odd, "page_id long, url string, html string")).selectExpr("*", "1 AS rid", "2 AS digest", "3 AS key")
        rows = table.collect()
        folder = warc.archive(table)
        found, digests = warc.read(spark, folder).collect(), warc.read_digests(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    groups, expected = defaultdict(list), []
    for r in rows:
        groups[(r.html or "").encode()].append(r.page_id)
    for payload, ids in groups.items():
        digest, first = hashlib.sha1(payload).hexdigest(), True
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            own = len(payload) < 1000 or len(ids) == 1 or i == top and first
            first = first and i != top
            expected.append((i, len(payload), digest, "response" if own else "revisit", None if own else top))
    assert sorted(map(str, expected)) == sorted(str((r.key, r.length, r.digest, r.type, r.refers_to)) for r in found)
    for r in found:
        assert r.type == "revisit" or hashlib.sha1(r.payload).hexdigest() == r.digest
    assert sorted((str(r.key), r.own_bytes, r.own_sha1, r.type) for r in digests) == sorted(
        (str(r.key), len(r.payload), hashlib.sha1(r.payload).hexdigest(), r.type) for r in found)
    nothing = warc.archive(table.limit(0))
    assert warc.read(spark, nothing).count() == warc.read_digests(spark, nothing).count() == 0


@pytest.mark.parametrize("chain", [[(0, 10), (10, 30), (15, 17), (17, 30), (20, 99), (30, 40), (40, 50)],
                                   [(0, 50), (10, 20), (20, 30), (30, 50), (50, 60), (55, 60), (60, 61)],
                                   [(0, 7)], [(5, 9), (9, 12)], [(i, i + 2) for i in range(40)]])
def test_chains_from_the_start(spark, chain):
    jump, at, expected = dict(chain), 0, set()
    while at in jump:
        expected.add(at)
        at = jump[at]
    rows = [("a", o, n) for o, n in chain] + [("b", 0, 4), ("b", 4, 9), ("b", 5, 6)]
    found = warc.reached(spark.createDataFrame(rows, "file string, offset long, next long")).collect()
    assert {r.offset for r in found if r.file == "a"} == expected and len(found) == len(expected) + 2
