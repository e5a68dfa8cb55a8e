import random

import corpus_pipeline as cp
from twintable.llm import decontaminate

FOLDER = "/root/testdata/sf0.001"


def test_documents_shorter_than_an_item(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    shingles = {i: decontaminate.shingles(t) for i, t in items.items()}
    texts = []
    for text in [*items.values()][:20]:
        words = text.split()
        texts += [" ".join(words[:-n]) for n in range(1, len(words) - 4)] + [" ".join(words[n:]) for n in range(1, 9)]
        texts += [" ".join([*words[:k], "changed", *words[k + 1:-2]]) for k in range(0, len(words) - 2, 5)]
    random.Random(1).shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.key: r for r in decontaminate.contaminated(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    short = set()
    for i, text in enumerate(texts):
        h = decontaminate.shingles(text)
        values = {k: decontaminate.similarity(h, g) for k, g in shingles.items() if len(h) < len(g)}
        like = {k for k, v in values.items() if v >= 0.8}
        assert {k for k in found[i].item_ids if k in values} == like
        if like:
            short.add(i)
            assert found[i].similarity >= max(values.values())
    assert 20 <= len(short) < len(texts)
    kept = {r.doc_id for r in cp.drop_benchmark_leaks(spark, docs, FOLDER).collect()}
    assert not kept & short


def test_a_passage_without_its_last_words_is_a_leak():
    text = " ".join(f"w{k}" for k in range(36))
    index = decontaminate.Index([7], [text], 5, 20, 4)
    assert index.matches(" ".join(text.split()[:-2]), 5, 0.8) == {7: (30 / 32, 0, 34)}
    assert index.matches(" ".join(text.split()[:30]), 5, 0.8) == {7: (26 / 32, 0, 30)}
    assert index.matches(" ".join(text.split()[:29]), 5, 0.8) == {}
