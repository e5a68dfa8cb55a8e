import hashlib
from collections import Counter

import pytest

import corpus_pipeline as cp
from twintable.llm import decontaminate

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage, on the table with odd rows."""
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    words = table.filter("lang = 'en' AND n_chars > 2000").orderBy("doc_id").first().text.split()
    near = words[:200]
    rows = [(10**6, " ".join(near), "en", "x", 1), (10**6 + 1, " ".join([*near[:100], "changed", *near[101:]]), "en", "x", 1),
            (10**6 + 2, " ".join(near), None, None, None), (10**6 + 3, None, "en", "x", 0), (10**6 + 4, "", "en", "x", 0),
            (10**6 + 5, "12 34", "en", "x", 5), (10**6 + 6, "A leak: " + item + " and what follows it.", "en", "x", 1), (None, "Lonely words of no document id.", "en", "x", 1)]
    docs = table.union(spark.createDataFrame(rows, table.schema))
    out, folder = [docs.collect()], tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert dict(docs.dtypes) == {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
        out.append(docs.collect())
    return out


def jaccard(a, b):
    x, y = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_language_keeps_all_texts_with_letters(stages):
    kept = {r.doc_id for r in stages[1]}
    assert {r.doc_id for r in stages[0]} - kept == {10**6 + 3, 10**6 + 4, 10**6 + 5}


def test_one_document_of_each_group_stays(stages):
    before, kept = stages[1], {r.doc_id for r in stages[2]}
    assert 10**6 + 1 not in kept and 10**6 + 2 not in kept
    texts = {}
    for r in before:
        texts.setdefault(r.text, []).append(r.doc_id)
    for ids in texts.values():
        assert sum(i in kept for i in ids) <= 1
    gone = [r for r in before if r.doc_id not in kept]
    others = [r for r in before if r.doc_id in kept]
    rest = {r.doc_id: r.text for r in before}
    for r in gone:  # each has a much like it, kept or itself gone
        assert any(jaccard(r.text, rest[k]) > 0.5 for k in rest if k != r.doc_id)
    for i, a in enumerate(others):
        assert all(jaccard(a.text, b.text) < 0.9 for b in others[:i])


def test_passages_stay_once(stages):
    left = Counter()
    for r in stages[3]:
        raw = r.text.encode()
        for w in {raw[i:i + 200] for i in range(len(raw) - 199)}:
            left[hashlib.md5(w).digest()] += 1
    cut = {r.doc_id: r.text for r in stages[3]}
    for r in stages[2]:
        if r.doc_id in cut and cut[r.doc_id] == r.text:
            assert r.n_chars == next(x.n_chars for x in stages[3] if x.doc_id == r.doc_id)
        elif r.doc_id in cut:
            assert len(cut[r.doc_id]) < len(r.text)
    assert sum(n > 1 for n in left.values()) < 0.01 * len(left)


def test_leaks_go_and_clean_documents_stay(stages, spark):
    items = [decontaminate.shingles(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in stages[4]}
    assert 10**6 + 6 not in kept and None in kept
    for r in stages[3]:
        h = decontaminate.shingles(r.text)
        like = any(decontaminate.similarity(h[i:i + len(g)], g) >= 0.8 for g in items for i in range(len(h) - len(g) + 1) if h[i] in g or h[i + len(g) - 1] in g)
        assert (r.doc_id in kept) != like


def test_packing_takes_all_that_is_left(stages):
    assert {r.doc_id for r in stages[5]} == {r.doc_id for r in stages[4]}
    assert all(sum(p.length for p in stages[5] if p.doc_id == r.doc_id) == r.doc_tokens for r in stages[5][:50])


def test_run_is_its_stages(spark, stages):
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES][0] == "language identification"
    assert cp.run(spark, FOLDER).count() > 0
