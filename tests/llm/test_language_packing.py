import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twintable.llm import base, language, packing, queries

FOLDER = "/root/testdata/sf0.001"
ODD = "K İ ß ẞ É× ÷a é don't IT'S <|endoftext|> a.b,c... 12 —.  x y\u0085z \x1cq 你好 . , .. ÀÖ."


@pytest.fixture(scope="module")
def odd_rows(spark):
    return spark.createDataFrame(
        [(1, "Plain words, here. And more words!", "en", "x"), (1, "Plain words, here. And more words!", "en", "x"), (2, None, "en", "y"),
         (3, "", None, "y"), (None, "un deux trois", "fr", None), (4, "12 34 ...", "en", "z"), (5, "mot " * 30_000, "fr", "z"),
         (6, ODD, None, None)], "doc_id long, text string, lang string, rid string")


def test_tokens_are_those_of_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.Chunks(path)
    texts = [ODD, "", " ", "Étre À l'été, ça. où? «non»", "ends.", "a.", ".", "Ouèque.\nÈre, naïve ÿ ð þ"]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_windows_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        at = np.unique(rng.integers(1, 60, 25))
        at = np.unique(np.concatenate((at, np.arange(8, at[-1], 8), [at[-1]])))
        cost = rng.choice([0, 3, 9], len(at))
        size, price = 16, dict(zip(at.tolist(), cost.tolist(), strict=True))

        def total(ends):
            before, out = 0, 0
            for e in ends:
                n = e - before
                assert 0 < n <= size
                out += (0 if n in (8, 16) else size - n) + price[e]
                before = e
            return out

        best = {0: 0}
        for p in at.tolist():
            ways = [best[q] + (0 if p - q in (8, 16) else size - p + q) + price[p] for q in best if 0 < p - q <= size]
            best[p] = min(ways)
        assert total(packing.plan(at, cost, size)) == best[int(at[-1])]


def check_pieces(rows, docs, size):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))]
        n = sum(r.length for r in parts)
        assert 0 < n <= size
        padding += 0 if n & (n - 1) == 0 else size - n
    for doc_id, text in docs.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(by_doc.pop(doc_id), key=lambda r: r.start)
        assert sum(r.length for r in parts) == len(ids) == parts[0].doc_tokens
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
    assert not by_doc
    return padding


def test_few_known_chunks():
    """A store that forgets gives the same ids, keeps what comes again and is dropped by other work."""
    path = public_tokenizers.path("word_bpe_49k.json")
    large, small = packing.Chunks(path), packing.Chunks(path, known=400)
    for k in range(12):
        texts = [f"the of and, word{k * 40 + i}. Zürich{i}{k}" for i in range(40)] + [None, ""]
        assert [x.tolist() for x in small.encode(texts)] == [x.tolist() for x in large.encode(texts)]
        assert len(small.number) < 400 + 4 * len(texts)
    small.forget()
    assert small.known == 400 and len(small.number) <= 200 + len(packing.MARKS)
    assert {b"the", b"of", b"and,", b".", b","} <= set(small.number)
    store = packing.chunks_of(path, 400)
    assert packing.chunks_of(path, 400) is store
    base.release_memory()
    assert packing.chunks_of(path, 400) is not store


def test_packing_round_trip(spark):
    rows = queries.op3_packing(spark, FOLDER).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    padding = check_pieces(rows, docs, 4096)
    assert padding <= 0.02 * sum(r.length for r in rows)


def test_packing_odd_rows(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(packing, "PLAN", 500)
    rows = packing.pack(odd_rows.filter("doc_id <> 1 OR doc_id IS NULL").coalesce(1), size=64, with_ids=True).collect()
    docs = {r.doc_id: r.text for r in odd_rows.collect() if r.doc_id != 1}
    check_pieces(rows, docs, 64)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    twice = packing.pack(odd_rows.filter("doc_id = 1")).collect()
    assert sum(r.start == 0 for r in twice) == 2
    assert packing.pack(odd_rows.limit(0)).count() == 0


def test_language_accuracy_on_the_held_out_fold(spark):
    found = queries.op8_language(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("d"), "lang")
    held = found.join(truth, F.col("doc_id") == F.col("d")).filter("held_out AND lang IS NOT NULL").toPandas()
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.97
    assert ((held.score >= 0) & (held.score <= 1)).all()
    assert found.count() == truth.count()


def test_language_odd_rows(spark, odd_rows):
    model = language.fit(odd_rows)
    rows = {r.d: r for r in language.predict(odd_rows, model, keep={"d": "doc_id"}).collect() if r.d != 1}
    assert rows[5].lang_pred == "fr" and rows[None].lang_pred in ("en", "fr")
    assert [rows[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and rows[2].score == 0
    nothing = language.fit(odd_rows.filter("lang = 'none'"))
    assert {r.lang_pred for r in language.predict(odd_rows, nothing, keep={"d": "doc_id"}).collect()} == {"und"}
    assert language.predict(odd_rows.limit(0), model, keep={"d": "doc_id"}).count() == 0


def test_long_texts_lose_no_ngram(monkeypatch):
    text = "ab cde fghij " * 200 + "x" * 900 + " end"
    whole = np.sort(np.concatenate([language.grams_of(p, 1 << 16) for p in language.pieces(language.letters_of(text))]))
    monkeypatch.setattr(language, "PIECE", 64)
    parts = np.sort(np.concatenate([language.grams_of(p, 1 << 16) for p in language.pieces(language.letters_of(text))]))
    assert np.array_equal(parts, whole)
