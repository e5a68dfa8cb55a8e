import json

import pytest

from twintable.sources import files
from twintable.sources.store import DatasetStore


def test_csv_keeps_leading_zeros_with_a_schema(spark, tmp_path):
    df = spark.createDataFrame([("02101", 'say "hi", all'), ("99999", None)], "zip string, note string")
    path = str(tmp_path / "sub" / "t.csv")
    files.write_table(df, path)
    back = files.read_table(spark, path, "zip string, note string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_json_lines_and_record_arrays(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    whole, lines = tmp_path / "r.json", tmp_path / "r.jsonl"
    whole.write_text(json.dumps(rows, indent=1))
    lines.write_text("\n".join(map(json.dumps, rows)))
    for path in (whole, lines):
        assert files.read_table(spark, str(path), "a int, b string").count() == 2


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        files.read_table(spark, "x.pickle")


def test_store(spark, tmp_path):
    store = DatasetStore(spark, str(tmp_path / "store"))
    key = store.save(spark.range(5).toDF("n"), "five")
    assert store.ids() == [key] and store.load(key).count() == 5
    assert store.delete(key) and not store.exists(key)
    with pytest.raises(KeyError):
        store.load(key)
    with pytest.raises(ValueError):
        store.load("../elsewhere")


def test_table_info_and_rows(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    files.write_table(spark.range(10).toDF("n"), path)
    info = files.table_info(spark.read.parquet(path)).first()
    assert info["rows"] == 10 and info["columns"] == 1 and info["bytes"] > 0
    assert files.row_source(spark, 7).count() == 7
