import hashlib
import os
import tempfile
from collections import Counter

import numpy as np
import pytest
import xxhash

from twintable.llm import base, repeats, simhash, suffixes, tally, trees
from twintable.llm.components import components

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The table with odd rows, and with columns named as the operators name their own."""
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(
        [(10**6, "ab" * 300), (10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, "x" * 500), (10**6 + 4, "w " * 100),
         (10**6 + 4, "w " * 100), (None, "The the q " * 30), (None, None), (10**6 + 5, "é" * 150 + "ü" * 150), (10**6 + 6, "One two")],
        "doc_id long, text string")
    return table.union(odd).selectExpr("doc_id", "text", "1 AS rid", "2 AS batch", "'k' AS key", "3 AS kind")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def flags_of(units, window, earlier):
    """Brute force: units under windows that are elsewhere too, or that came before."""
    counts = Counter(u[i:i + window].tobytes() for u in units for i in range(len(u) - window + 1))
    seen, out = set(), []
    for u in units:
        flag = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1):
            w = u[i:i + window].tobytes()
            if w in seen if earlier else counts[w] > 1:
                flag[i:i + window] = True
            seen.add(w)
        out.append(flag)
    return out


def by_age(rows):
    return sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))


@pytest.mark.parametrize("hot", [2, 32])
@pytest.mark.parametrize("first", [False, True])
def test_repeated_bytes(docs, rows, hot, first, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    found = suffixes.remove_repeats(docs, keep_first=first, with_text=True).collect()
    order = by_age(rows)
    units = [np.frombuffer((rows[i][1] or "").encode(), np.uint8) for i in order]
    expected = []
    for i, u, f in zip(order, units, flags_of(units, 200, first), strict=True):
        spans = int((f[1:] & ~f[:-1]).sum() + (f[0] if len(f) else 0))
        expected.append((str(rows[i][0]), len(u), int(f.sum()), spans, hashlib.sha256(u[~f].tobytes()).hexdigest()))
    got = [(str(r.key), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found]
    assert sorted(got) == sorted(expected)


def test_repeated_words(docs, rows):
    found = trees.remove_repeats(docs, with_text=True).collect()
    order, number = by_age(rows), {}
    words = [(rows[i][1] or "").encode().split() for i in order]
    units = [np.array([number.setdefault(w, len(number)) for w in x], np.int64) for x in words]
    expected = [(str(rows[i][0]), len(x), int(f.sum()), hashlib.sha256(b" ".join(w for w, g in zip(x, f, strict=True) if not g)).hexdigest())
                for i, x, f in zip(order, words, flags_of(units, 20, True), strict=True)]
    assert sorted((str(r.key), r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(expected)


def test_long_texts_of_one_stretch(spark):
    """Megabytes of one byte, and of a short period, across joined runs; each word but the first repeats."""
    texts = ["a" * 2_000_000, "xy" * 300_000, "b" * 150, "z " * 200_000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.key: r for r in suffixes.remove_repeats(table, window=200).collect()}
    assert [(found[i].n_bytes, found[i].n_removed, found[i].n_spans) for i in range(4)] == [
        (2_000_000, 2_000_000, 1), (600_000, 600_000, 1), (150, 0, 0), (400_000, 400_000, 1)]
    kept = {r.key: r for r in suffixes.remove_repeats(table, window=200, keep_first=True, with_text=True).collect()}
    assert [len(kept[i].kept) for i in range(4)] == [1, 2, 150, 2]
    words = {r.key: (r.n_words, r.n_removed) for r in trees.remove_repeats(table, window=20).collect()}
    assert words == {0: (1, 0), 1: (1, 0), 2: (1, 0), 3: (200_000, 199_999)}


def test_words_of_texts_are_hashed_together(monkeypatch):
    texts = ["a b", None, "", " \t", "c", "a b c ä", "x" * 30, "b", "", "e\vf\xa0g "]
    plain = [base.word_hashes((t or "").encode())[0].tolist() for t in texts]
    calls = []
    monkeypatch.setattr(trees, "word_hashes", lambda data: calls.append(len(data)) or base.word_hashes(data))
    for together in (1, 8, 1 << 18):
        monkeypatch.setattr(trees, "TOGETHER", together)
        assert [x.tolist() for x in trees.words_of(texts)] == plain
        assert [x.tolist() for x in trees.words_of([])] == []
    assert calls[-1] > 30  # all of them in one call


def test_texts_become_units_once_a_pass(spark, tmp_path):
    """A pass each for minimizers (two where no exchange is reused), hot windows and passages."""
    folder = str(tmp_path)

    def units(texts):
        for text in texts:
            with tempfile.NamedTemporaryFile(dir=folder, delete=False):
                yield np.frombuffer(text.encode(), np.uint8)

    n = 2 * repeats.HOT
    table = spark.createDataFrame([(i, "abcdefghijklmnop") for i in range(n)], "doc_id long, text string").coalesce(1)
    batches, total = repeats.prepared(table, "doc_id", "text")
    found = repeats.passages(batches, repeats.Kind(units, np.uint8, 10, 3), total).collect()
    assert sum(len(r.places) // 32 for r in found) >= n
    assert len(os.listdir(folder)) <= 4 * n


def test_no_rows(docs):
    empty = docs.limit(0)
    assert suffixes.remove_repeats(empty).count() == 0
    assert trees.remove_repeats(empty).count() == 0
    assert simhash.classes(empty).count() == 0


def test_stretches_of_flagged_windows():
    windows = np.array([4, 30, 1])
    flags = np.zeros(35, bool)
    assert [x.tolist() for x in repeats.covered(flags, windows, 5)] == [[], [], []]
    flags[[0, 3, 4, 9, 15, 34]] = True
    assert [x.tolist() for x in repeats.covered(flags, windows, 5)] == [[0, 1, 1, 2], [0, 0, 11, 0], [8, 10, 16, 5]]
    place = np.array([[7, 1, 0, 100], [8, 2, 0, 0]])
    shard = repeats.Shard([b""], np.array([3]), np.array([0, 0]), np.array([5, 6]), place)
    batch, spans = repeats.spans_of(shard, np.zeros(3, bool), place[:1], 5)
    assert batch.tolist() == [6] and spans.tolist() == [[8, 0, 7]]
    batch, spans = repeats.spans_of(shard, np.zeros(3, bool), None, 5)
    assert len(batch) == len(spans) == 0


def test_large_groups_share_prefixes(monkeypatch):
    monkeypatch.setattr(trees, "GROUP", 4)
    rng = np.random.default_rng(5)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    at = np.arange(400 - 5)
    flags = trees.repeated_windows(words, at, at, 6)
    seen = set()
    assert len(flags) == len(at)
    for i in at:
        w = words[i:i + 6].tobytes()
        assert flags[i] == (w in seen)
        seen.add(w)


@pytest.mark.parametrize("symbols", [2, 1024])
@pytest.mark.parametrize("memory", [2000, 64 << 20])
def test_suffix_order(symbols, memory, monkeypatch):
    monkeypatch.setattr(suffixes, "SYMBOLS", symbols)
    monkeypatch.setattr(suffixes, "MEMORY", memory)
    rng = np.random.default_rng(1)
    texts = [np.append(rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 50))), 0) for _ in range(150)]
    texts += [np.append(np.tile(rng.integers(1, 4, 7), 60), 0), np.append(rng.integers(1, 30, 3000), 0)]
    for t in texts:
        whole = t.tolist()
        assert suffixes.sort_suffixes(t).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])


def test_hashes_tell_units_apart():
    rng = np.random.default_rng(0)
    units = rng.integers(0, 5, 400).astype(np.uint64)
    for k in (1, 2, 3, 6, 7, 24, 200):
        h, known = base.gram_hashes(units, k), {}
        assert all(known.setdefault(units[i:i + k].tobytes(), h[i]) == h[i] for i in range(401 - k))
        assert len(set(known.values())) == len(known) and len(h) == 401 - k
    text = "a  bc\tdefghijkl\nmnopqrstuvwxyzabcdefgh é \x0b x".encode()
    h, start, end = base.word_hashes(text)
    assert [text[i:j] for i, j in zip(start, end, strict=True)] == text.split() and len(set(h.tolist())) == len(h)
    assert base.word_hashes(b"bc")[0][0] == h[1]


def test_golay_keys_meet_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, 1500).astype(np.uint64)
    for fuzzy, radius in ((False, 2), (True, 5)):
        other = prints.copy()
        for _ in range(radius):
            other ^= np.uint64(1) << rng.integers(0, 64, len(prints)).astype(np.uint64)
        sides = []
        for p in (prints, other):
            keys = [set() for _ in p]
            for who, key in zip(*simhash.bucket_keys(p, fuzzy), strict=True):
                keys[who].add(key)
            sides.append(keys)
        assert all(a & b for a, b in zip(*sides, strict=True))


def test_large_groups_become_forests():
    rng = np.random.default_rng(4)
    prints = np.zeros((3000, 1), np.int64)
    prints[:, 0] = [(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 40, (3000, 2))]
    a, b = simhash.group_links(np.zeros(3000, np.int64), prints, 2)
    assert len(a) < 3000
    label = list(range(3000))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        label[root(x)] = root(y)
    assert len({root(x) for x in range(3000)}) == 1


def plain_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    grams = [b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    out = 0
    for bit in range(64):
        out |= (sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) * 2 > len(grams)) << bit
    return out


def test_simhash_classes(docs, rows):
    found = simhash.classes(docs).collect()
    prints = [plain_fingerprint(t, 3) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (k, _), x in zip(rows, label, strict=True):
        least[x] = min((v for v in (least.get(x), k) if v is not None), default=None)
    expected = sorted((str(k), p, str(least[x])) for (k, _), p, x in zip(rows, prints, label, strict=True))
    assert sorted((str(r.key), r.f0 % 2**64, str(r.component)) for r in found) == expected


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


def test_hashes_are_packed_near_their_entropy():
    """Steps of 42 bits take less than six bytes each, and come back as they were."""
    rng = np.random.default_rng(6)
    values = np.unique(rng.integers(0, 1 << 64, 1 << 22, np.uint64))
    some = values[:100_000]
    assert len(tally.packed(some)) < 5.7 * len(some)
    for v in (some, values[:1], values[:0], np.array([0, 1, 2**64 - 1], np.uint64)):
        assert (tally.unpacked(tally.packed(v)) == v).all()
