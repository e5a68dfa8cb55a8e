"""Readers, writers, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import load
from twintable.operators import columns
from twintable.plans import infer
from twintable.session import scratch_folder
from twintable.sources import files
from twintable.sources.store import DatasetStore

CUSTOMER_SCHEMA = (
    "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
)


def _round_trip(spark, d, extension, schema=None, **options):
    path = f"{scratch_folder(spark)}/customer{extension}"
    files.write_table(load(spark, d, "customer"), path)
    return files.read_table(spark, path, schema=schema, **options)


def read_csv(spark, d):
    return _round_trip(spark, d, ".csv", CUSTOMER_SCHEMA)


def read_json(spark, d):
    return _round_trip(spark, d, ".jsonl", CUSTOMER_SCHEMA)


def read_json_records(spark, d):
    """Lines that each hold one array of records."""
    path = f"{scratch_folder(spark)}/customer.json"
    arrays = load(spark, d, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 100)).agg(
        F.to_json(F.collect_list(F.struct("*"))).alias("value")
    ).select("value")
    arrays.write.text(path)
    return files.read_table(
        spark, path, schema=CUSTOMER_SCHEMA, record_array=False
    )


def read_parquet(spark, d):
    return files.read_table(spark, f"{d}/customer.parquet")


def write_parquet(spark, d):
    return _round_trip(spark, d, ".parquet")


def dataset_store(spark, d):
    store = DatasetStore(spark, scratch_folder(spark))
    store.save(load(spark, d, "supplier"), "suppliers")
    gone = store.save(load(spark, d, "nation"))
    store.delete(gone)
    kept = store.load("suppliers")
    return kept.withColumn("datasets", F.lit(len(store.ids())))


def table_info(spark, d):
    return files.table_info(load(spark, d, "lineitem")).select("files", "rows", "columns")


def row_source(spark, d):
    n = load(spark, d, "orders").count()
    return files.row_source(spark, n)


def keep_existing(spark, d):
    return columns.keep_existing(
        load(spark, d, "lineitem"), ["l_shipdate", "missing", "l_orderkey", "l_linenumber"]
    )


def restore_order(spark, d):
    shuffled = load(spark, d, "supplier").select(
        F.lower("s_name").alias("extra"), "s_acctbal", "s_nationkey", "s_name", "s_suppkey"
    )
    out = columns.restore_order(shuffled, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    return out.withColumn("order_kept", F.lit(",".join(out.columns)))


def select_by_type(spark, d):
    df = load(spark, d, "orders")
    metadata = infer.route_types(df)
    wanted = infer.columns_of_type(metadata, "categorical") + infer.columns_of_pipeline(
        metadata, "temporal"
    )
    return columns.keep_existing(df, ["o_orderkey", *wanted])


def find_columns(spark, d):
    """Columns found by name token, with their non-missing counts."""
    df = load(spark, d, "customer").selectExpr(
        "c_custkey AS record_id", "c_name AS customerName", "c_acctbal AS paid", "c_nationkey AS home_country_code",
        "c_mktsegment AS `Sl No`",
    )
    found = {
        token: columns.find_columns(df.columns, token)
        for token in ("id", "name", "country", "sl no")
    }
    aggs = [F.count(f"`{c}`").alias(f"{t}|{c}") for t, cs in found.items() for c in cs]
    structs = [
        F.struct(F.lit(t).alias("token"), F.lit(c).alias("column"), F.col(f"`{t}|{c}`").alias("n"))
        for t, cs in found.items() for c in cs
    ]
    return columns.rows_from_wide(df.agg(*aggs), structs)


FIND_SQL = """
SELECT token, c AS "column", (SELECT count(*) FROM customer) AS n FROM (VALUES
 ('id', 'record_id'), ('name', 'customerName'), ('country', 'home_country_code'), ('sl no', 'Sl No')) t(token, c)"""

QUERIES = {
    "read_csv": (read_csv, "SELECT * FROM customer"),
    "read_json": (read_json, "SELECT * FROM customer"),
    "read_json_records": (read_json_records, "SELECT * FROM customer"),
    "read_parquet": (read_parquet, "SELECT * FROM customer"),
    "write_parquet": (write_parquet, "SELECT * FROM customer"),
    "dataset_store": (dataset_store, "SELECT *, 1 AS datasets FROM supplier"),
    "table_info": (table_info, "SELECT 1::BIGINT AS files, count(*) AS rows, 11::BIGINT AS columns FROM lineitem"),
    "row_source": (row_source, "SELECT unnest(range((SELECT count(*) FROM orders))) AS row_id"),
    "keep_existing": (keep_existing, "SELECT l_shipdate, l_orderkey, l_linenumber FROM lineitem"),
    "restore_order": (restore_order, "SELECT *, lower(s_name) AS extra, 's_suppkey,s_name,s_nationkey,s_acctbal,extra' AS order_kept FROM supplier"),
    "select_by_type": (select_by_type, "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders"),
    "find_columns": (find_columns, FIND_SQL),
}
