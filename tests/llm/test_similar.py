import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from twintable.llm import components, similar
from twintable.session import durable


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def shared(rng, base, n):
    """A text whose first words are those of the base, up to n shingles in common of as many as the base has."""
    return " ".join(base[:n + 4] + words(rng, len(base) - n - 4))


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect()}


def test_both_sides_of_the_similarity(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(60):  # 90 shingles each: 80 in common are 0.8, 79 are 0.782
        for n in (80, 79):
            base = words(rng, 94)
            texts += [" ".join(base), shared(rng, base, n)]
            assert (similar.jaccard(*(similar.shingles(t, 5) for t in texts[-2:])) >= 0.8) == (n == 80)
    assert set(range(len(texts))) - kept(spark, texts) == set(range(1, len(texts), 4))


def test_templated_documents_stay(spark):
    rng = random.Random(2)
    base = words(rng, 204)  # 142 of 200 shingles in common: 0.55
    texts = [shared(rng, base, 142) for _ in range(1000)]
    assert 0.54 < similar.jaccard(*(similar.shingles(t, 5) for t in texts[:2])) < 0.56
    assert kept(spark, texts) == set(range(1000))


def test_classes_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "ONE", "one two", "one two"]
    for _ in range(12):
        base = words(rng, rng.choice((6, 30, 120, 400)))
        for _ in range(rng.choice((1, 5, 40, 90))):  # groups larger than a round reaches
            some = list(base)
            for _ in range(rng.randrange(1 + len(base) // 20)):
                some[rng.randrange(len(some))] = rng.choice(("x", "y", f"z{rng.randrange(99)}"))
            texts.append(" ".join(some))
    rng.shuffle(texts)
    sets = [similar.shingles(t, 5) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar.jaccard(sets[i], sets[j]) >= 0.8 or not len(sets[i]) and not len(sets[j]):
                parent[root(i)] = root(j)
    expected, found = defaultdict(set), defaultdict(set)
    for i in range(len(texts)):
        expected[root(i)].add(i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in similar.classes(docs).collect():
        found[r.root].add(r.key)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_far_distances_are_compared():
    n = 700
    keys, size, bits = np.zeros(n, np.int64), np.full(n, 9), np.zeros((n, similar.BITMAP), np.uint64)
    root = np.where(np.isin(np.arange(n), (3, 650)), np.arange(n), 0)
    met = set()
    for low, high in ((1, 2), (2, 16), (16, 128), (128, 1024)):
        met |= set(map(tuple, np.sort(np.transpose(similar.pairs_in(keys, root, size, bits, low, high, 0.8)), axis=1).tolist()))
    assert met == {(i, j) for i in range(n) for j in range(i + 1, n) if root[i] != root[j]}


def test_long_bitmaps_bound_the_differing_shingles():
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 1 << 63, n, np.uint64)
    common = draw(60_000)
    sets = [np.unique(np.concatenate((common[:n], draw(more)))) for n in (0, 30, 480, 500, 520, 7000, 60_000) for more in (1, 25, 60)]
    long = similar.LongBitmaps([similar.long_bitmap(h) for h in sets])
    assert len(set(long.words.tolist())) > 4 and long.words.max() == similar.LONGEST
    i, j = np.nonzero(np.ones((len(sets), len(sets)), bool))
    found = long.differing(i, j)
    for a, b, n in zip(i.tolist(), j.tolist(), found.tolist(), strict=True):
        differing = len(np.setxor1d(sets[a], sets[b], assume_unique=True))
        assert n <= differing and (n - differing) % 2 == 0
        if 440 < len(sets[a]) < 600 and 440 < len(sets[b]) < 600:
            assert n >= 0.85 * differing


def test_a_template_is_not_handed_on_by_its_square(spark, monkeypatch):
    """Texts of one template with a similarity of about 0.74: what is verified grows no faster than they do."""
    rng = random.Random(7)
    base = words(rng, 404)
    asked, candidates = [], similar._candidates

    def counted(keys, low, *a):
        found = durable(candidates(keys, low, *a))
        asked.append((low, found.count()))
        return found

    monkeypatch.setattr(similar, "_candidates", counted)
    for n in (60, 240):
        texts = []
        for _ in range(n):
            some = list(base)
            for at in rng.sample(range(20, 384), 6):
                some[at] = words(rng, 1)[0]
            texts.append(" ".join(some))
        sets = [similar.shingles(t, 5) for t in texts]
        linked = sum(similar.jaccard(sets[i], sets[j]) >= 0.8 for i in range(n) for j in range(i))
        asked.clear()
        similar.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        far = [found for low, found in asked if low > 1]
        assert len(far) > 1 and sum(far) <= linked + n, (n, linked, asked)


def test_a_key_meets_in_one_task_after_a_join(spark):
    """Whatever adaptive execution makes of the join that picks the keys, all rows of a key meet."""
    rows = spark.range(0, 30_000, 1, 8).selectExpr("id % 10000 AS key", "id AS node", "id AS root", "100L AS size", "cast(repeat('a', 32) AS binary) AS bits")
    keys = durable(rows)
    picked = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1 AND key < 50").select("key")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        pairs = similar._candidates(keys.join(picked, "key").select("key", "node", "root", "size", "bits"), 1, 2, 0.8)
        assert "REPARTITION_BY_COL" in pairs._jdf.queryExecution().executedPlan().toString()  # not left to the join
        found = {tuple(r) for r in pairs.collect()}
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert found == {(k + at, k + at + 10_000) for k in range(50) for at in (0, 10_000)}


def test_fingerprints_are_compared_first(spark, monkeypatch):
    """Texts with fingerprints two bits apart are linked before the prefix join, which need not meet them again."""
    rng = random.Random(4)
    base = words(rng, 3000)
    texts = [" ".join([*base[:i], "changed", *base[i + 1:]]) for i in range(0, 3000, 100)]
    prints = [similar.fingerprint(similar.shingles(t, 5)) for t in texts]
    near = {i for i in range(30) for j in range(30) if i != j and (prints[i] ^ prints[j] & (1 << 64) - 1).bit_count() <= similar.RADIUS}
    asked, candidates = [], similar._candidates
    monkeypatch.setattr(similar, "_candidates", lambda keys, *a: asked.append(keys.select("root").distinct().count()) or candidates(keys, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert similar.classes(docs).select("root").distinct().count() == 1
    assert near and asked[0] < 30


def test_a_small_graph_is_one_task_and_a_large_one_is_not(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 50), (100, 60), (7, 7)]
    table = spark.createDataFrame(edges, "a long, b long")
    few = {tuple(r) for r in components.components(table).collect()}
    monkeypatch.setattr(components, "SMALL_GRAPH", 0)
    assert few == {tuple(r) for r in components.components(table).collect()}
    assert len(few) == 43 and (100, 50) in few
