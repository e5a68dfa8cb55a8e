"""A sample of the registered queries against their SQL; ``tools/check.py`` runs all of them."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = ["k_anonymity", "two_sample_ks", "emails", "repair_cities", "fill_backward", "check_rules"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check import table

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    df = entry.queries()[name](spark, FOLDER)
    rel = con.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in rel.description], rel.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
