import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from twintable.llm import bpe, queries

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, rid long, batch long, key string, word string, ids int"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def expected(rows, library):
    out = []
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((key, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())))
    return sorted(out, key=str)


def odd_rows():
    random.seed(3)
    chars = [chr(c) for c in [*range(0x80), *range(0xA0, 0x600, 7), 0x85, 0x1680, 0x2003, 0x2028, 0x3000, 0x0558, 0x0870, 0x1E4F1, 0x2EBF0, 0x1F600, 0xFF13, 0x10FFFF]]
    mixed = ["".join(random.choice(chars) + random.choice(["", "", " ", "'ll", "'S", "\n\n"]) for _ in range(60)) for _ in range(200)]
    return [(i, t) for i, t in enumerate(mixed)] + [
        (500, None), (501, ""), (502, " "), (503, "\n" * 70), (504, "a" * 5000), (505, "ab" * 33), (506, "é" * 200), (507, "." * 64), (508, "." * 65),
        (509, " one two" * 30_000), (510, "don't we'll I'M <|endoftext|> 12345"), (None, "no key"), (511, "twice"), (511, "twice"), (None, None)]


def test_odd_texts(spark, library, monkeypatch):
    rows = odd_rows()
    table = spark.createDataFrame([(k, t, 1, 2, "k", "w", 3) for k, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(queries, "read", lambda *_: table)
    assert sorted((tuple(r) for r in queries.op13_byte_bpe(spark, "").collect()), key=str) == expected(rows, library)
    monkeypatch.setattr(queries, "read", lambda *_: table.limit(0))
    assert queries.op13_byte_bpe(spark, "").collect() == []
    monkeypatch.setattr(queries, "read", lambda *_: table.filter("text IS NULL"))
    assert {r.n_tokens for r in queries.op13_byte_bpe(spark, "").collect()} == {0}


def test_whole_table(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op13_byte_bpe(spark, FOLDER).collect()), key=str) == expected(rows, library)


def test_long_words(library):
    random.seed(1)
    for word in ["a" * 100, "banana" * 40, "".join(random.choices("etaoin shrdlu", k=3000)), "é\n" * 99]:
        assert bpe.merged_long(word.encode(), bpe.ranks_of(PATH)) == library._core_bpe.encode_single_piece(word.encode())


def test_words_in_many_batches(spark, library, monkeypatch):
    """Small batches, and rows of a word that stand for few of them."""
    monkeypatch.setattr(bpe, "PLACES", 2)
    rows = [(i, f"hot word number {i} again") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.key: list(r.ids) for r in bpe.encode(table).collect()}
    assert found == {k: library.encode_ordinary(t) for k, t in rows}


def test_ids_go_back_packed(spark, monkeypatch):
    """One row a task and batch, with all words of the batch in it; a few bytes a word."""
    random.seed(4)
    n = 3000
    words = [(f"w{i}", [i % 2 << bpe.PLACE_BITS | i // 2], random.choices(range(50_000), k=i % 4 + 1)) for i in range(n)]
    words += [("both", [n, 1 << bpe.PLACE_BITS | n], [7, 1 << 19])]
    random.shuffle(words)
    table = spark.createDataFrame(words, "word string, places array<bigint>, ids array<int>").coalesce(1)
    expected = {at: ids for _, places, ids in words for at in places}
    for together, rows in ((1 << 20, 2), (1, None)):
        monkeypatch.setattr(bpe, "PACKED_WORDS", together)
        answers = bpe.packed(table).collect()
        assert rows is None or len(answers) == rows
        found = {}
        for r in answers:
            places, length, ids = bpe.unpack_answers(r.answer)
            assert (places[1:] > places[:-1]).all()
            parts = [x.tolist() for x in np.split(ids, length.cumsum()[:-1])]
            assert not any((r.batch << bpe.PLACE_BITS | p) in found for p in places.tolist())
            found |= {r.batch << bpe.PLACE_BITS | p: x for p, x in zip(places.tolist(), parts, strict=True)}
        assert found == expected
        assert rows is None or sum(len(r.answer) for r in answers) < 8 * n
