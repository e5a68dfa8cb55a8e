import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from twintable.llm import merkle, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word long, place string, size int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    values = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root of some nodes, and for each the (siblings before, siblings after) of every level."""
    ways = [[] for _ in nodes]
    of = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_of = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i:i + 3]
            for k in range(len(run)):
                for j in of[i + k]:
                    ways[j].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(sha("".join(run)))
            up_of.append([j for members in of[i:i + 3] for j in members])
        nodes, of = up, up_of
    return nodes[0], ways


def brute_force(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        below[s] = climb([leaf(r, r["text"]) for r in groups[s]])
    root, tops = climb([below[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, way in zip(groups[s], below[s][1], strict=True):
            cut = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            node = leaf(r, r["text"].replace("\n", "") if cut else r["text"])
            for before, after in way + top:
                node = sha(before + node + after)
            proof = sha("".join(before + after for before, after in way + top))
            out.append((r["doc_id"], leaf(r, r["text"]), below[s][0], root, proof, node, node == root))
    return out


def found_of(spark, table, monkeypatch):
    monkeypatch.setattr(queries, "read", lambda *_: table)
    return [tuple(r) for r in queries.op12_merkle_manifest(spark, "").collect()]


def rows_of(count):
    odd = [
        dict(doc_id=None, text="a\nb", lang=None, source=None, n_chars=1), dict(doc_id=None, text=None, lang="", source="", n_chars=None),
        dict(doc_id=None, text="x", lang="en", source="web", n_chars=2), dict(doc_id=-5, text="minus\n", lang="en", source="web", n_chars=3),
        dict(doc_id=-(2**63), text="least", lang="en", source="web", n_chars=3), dict(doc_id=2**63 - 1, text="most", lang="en", source="web", n_chars=3),
        dict(doc_id=7, text="same\n", lang="en", source="web", n_chars=3), dict(doc_id=7, text="same\n", lang="en", source="web", n_chars=3),
        dict(doc_id=7, text="other", lang="en", source="web", n_chars=3), dict(doc_id=70, text="", lang="de", source="é", n_chars=0),
        dict(doc_id=71, text="ab\n" * 300_000, lang="de", source="Z", n_chars=0), dict(doc_id=63, text="w\n", lang="de", source="web", n_chars=0),
        dict(doc_id=64, text="w", lang="de", source="web", n_chars=0), dict(doc_id=None, text="x", lang="en", source="web", n_chars=2)]
    many = [dict(doc_id=(i * 7919) % 100_003, text=f"text\n{i}", lang="en", source=("web", "web", f"s{i % 5}")[i % 3], n_chars=i) for i in range(count)]
    return odd + many


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "p", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("levels", [3, 8])
def test_manifest(spark, monkeypatch, levels):
    """Short stretches make several rounds; the rows are the same."""
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **k: whole(*a, levels=levels, **k))
    rows = rows_of(300)
    table = frame(spark, rows).repartition(3, "text")
    assert Counter(found_of(spark, table, monkeypatch)) == Counter(brute_force(rows))


def test_many_groups_and_one_id(spark, monkeypatch):
    rows = [dict(doc_id=1, text=f"t\n{i % 40}", lang=None, source="hot", n_chars=1) for i in range(400)]
    rows += [dict(doc_id=i, text="t", lang=None, source=f"s{i}", n_chars=1) for i in range(100)]
    assert Counter(found_of(spark, frame(spark, rows), monkeypatch)) == Counter(brute_force(rows))


def test_lone_leaf_and_empty_table(spark, monkeypatch):
    rows = rows_of(0)[:1]
    found = found_of(spark, frame(spark, rows), monkeypatch)
    assert found == brute_force(rows) and found[0][4] == sha("") and found[0][6]
    assert found_of(spark, frame(spark, rows).limit(0), monkeypatch) == []


def test_whole_table(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = Counter(tuple(r) for r in queries.op12_merkle_manifest(spark, FOLDER).collect())
    expected = brute_force([r.asDict() for r in table.collect()])
    assert found == Counter(expected)
    assert {r[6] for r in expected} == {True, False}
