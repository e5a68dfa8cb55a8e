import hashlib

import pytest

from twintable.llm import warc


@pytest.mark.parametrize("split", ["30k", "128m"])
def test_urls_with_the_magic_text_and_long_ones(spark, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        urls = ["http://a/" + "x" * 70_000, "WARC/1.1", "http://b/WARC/1.1/WARC/1.1", "http://b/WARC%2F1.1", "http://b/WARC%252F1.1?WARC/1.1",
                "http://c/\u0145X-Key: 7", "http://d/\u00e9" * 40_000, "plain", None]
        rows = [(i, u, f"page {i} " * 300) for i, u in enumerate(urls)] + [(100 + i, f"u{i}", "z WARC/1.1 z" * 9) for i in range(30)]
        table = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
        folder = warc.archive(table)
        found, digests = warc.read(spark, folder).collect(), warc.read_digests(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.key: (r.url, r.payload.decode()) for r in found} == {i: (u, p) for i, u, p in rows} and len(found) == len(rows)
    assert sorted((r.key, r.digest) for r in digests) == sorted((i, hashlib.sha1(p.encode()).hexdigest()) for i, _, p in rows)


def test_a_broken_chain_is_an_error(spark, tmp_path):
    record = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "whole").write_bytes(record.encode() * 3)
    assert warc.read(spark, str(tmp_path)).count() == 3
    (tmp_path / "cut").write_bytes((record + "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + record).encode())
    for reader in (warc.read, warc.read_digests):
        with pytest.raises(ValueError, match="cut"):
            reader(spark, str(tmp_path)).collect()
