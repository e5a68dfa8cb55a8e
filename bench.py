"""Headline timings; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from catalog import all_queries  # noqa: E402
from twintable.plans import fidelity, risk  # noqa: E402
from twintable.plans.fabricate.table import Options, fabricate  # noqa: E402
from twintable.session import local_session  # noqa: E402

CATALOG = [
    "profile_numeric", "profile_text", "profile_categorical", "analyze_table", "pii_detections",
    "infer_types", "route_types", "two_sample_ks", "quantile_table", "correlation_matrix",
    "numeric_fidelity", "text_fidelity", "quality_report", "k_anonymity", "reidentification_risk",
    "data_leakage", "privacy_report", "fill_forward", "remove_outliers_iqr", "best_fit",
    "profile_table", "repair_all", "enforce_relationships", "check_rules",
]


def drain(df) -> None:
    """Compute all rows without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    people = spark.read.parquet(f"{folder}/customer.parquet").selectExpr(
        "c_custkey + 1 AS record_id", "'Ann' AS first_name", "'Lee' AS last_name",
        "CAST(18 + c_custkey % 60 AS INT) AS age", "c_acctbal AS balance", "c_mktsegment AS segment",
        "CASE WHEN c_custkey % 2 = 0 THEN 'India' ELSE 'USA' END AS country",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Mumbai' ELSE 'Austin' END AS city",
        "'a' || c_custkey || '@example.com' AS email",
        "TIMESTAMP '2023-01-01 00:00:00' + make_dt_interval(CAST(c_custkey % 400 AS INT)) AS signup_date",
        "'some words about customer ' || c_custkey || ' and what was bought' AS remark",
    )
    small = orders.limit(20_000).select("o_totalprice", F.col("o_custkey").cast("double").alias("key"), "o_orderkey")
    work = {name: (lambda n: (lambda: drain(all_queries()[n][0](spark, folder))))(name) for name in CATALOG}
    for label, n in (("1k", 1_000), ("10k", 10_000), ("100k", 100_000), ("1m", 1_000_000)):
        work[f"generate_{label}"] = (lambda n: (
            lambda: drain(fabricate(people, n, Options(method="xxhash64")))))(n)
    work["validate_quality_10k"] = lambda: fidelity.quality_report(
        small.filter("o_orderkey % 2 = 0").drop("o_orderkey"),
        small.filter("o_orderkey % 2 = 1").drop("o_orderkey"),
    ).collect()
    work["validate_privacy_10k"] = lambda: risk.privacy_report(
        orders.limit(10_000).select("o_orderstatus", "o_orderpriority"), None,
        ["o_orderstatus", "o_orderpriority"],
    ).collect()
    drain(orders.groupBy("o_orderstatus").count())  # start the executors
    times = {}
    for name, run in work.items():
        if only and not any(name.startswith(p) for p in only):
            continue
        start = time.time()
        run()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
