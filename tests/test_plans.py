"""Plans on small tables: thresholds, invariants, edge frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twintable.plans import clean, detect, fidelity, infer, knowledge as kn, profile, repair, risk
from twintable.plans.fabricate import people
from twintable.plans.fabricate.table import Options, blend, fabricate
from twintable.sources.files import row_source

RNG = np.random.default_rng(8)


def rows_by(df, key="column"):
    return {r[key]: r for r in df.collect()}


# ------------------------------------------------------------ profile, types


def test_profiles_of_edge_frames(spark):
    empty = spark.createDataFrame([], "a double, t string, d timestamp")
    assert rows_by(profile.profile_numeric(empty, ["a"]))["a"]["n"] == 0
    assert rows_by(profile.analyze_table(empty))["t"]["total_count"] == 0
    nothing = spark.createDataFrame([(None, None, None)] * 3, "a double, t string, d timestamp")
    got = rows_by(profile.analyze_table(nothing))
    assert got["a"]["null_count"] == 3 and got["a"]["completeness"] == 0.0
    one = spark.createDataFrame([(7.0, "x", dt.datetime(2024, 1, 1))], "a double, t string, d timestamp")
    p = rows_by(profile.profile_numeric(one, ["a"]))["a"]
    assert p["median"] == 7.0 and p["std"] is None and p["outlier_count"] == 0
    assert rows_by(profile.profile_temporal(one))["d"]["date_range_days"] == 0
    flags = spark.createDataFrame([(0,), (1,), (1,)], "b int")
    assert rows_by(infer.route_types(flags))["b"]["data_type"] == "boolean"


def test_free_text_is_not_temporal(spark):
    texts = ["great service", "May be improved", "will come again", "not in March", "ok"]
    df = spark.createDataFrame([(t,) for t in texts], "comments string")
    assert rows_by(infer.route_types(df))["comments"]["data_type"] != "temporal"


def test_dates_in_text_and_hints(spark):
    df = spark.createDataFrame([(f"{d}/3/2024", str(i)) for i, d in enumerate(range(1, 25))], "seen string, code string")
    got = rows_by(infer.analyze_schema(df, hints={"code": "id"}))
    assert got["seen"]["data_type"] == "temporal" and got["seen"]["date_format"] == "%d/%m/%Y"
    assert got["seen"]["min_ts"] == dt.datetime(2024, 3, 1)
    assert got["code"]["data_type"] == "pii_id" and got["code"]["pipeline"] == "pii"


def test_detection_prefers_the_narrow_format(spark):
    rows = [(f"{i:03d}-45-6789", f"user{i}@example.org", f"Mary Jones{'' if i % 2 else 'on'}", 1e7 + i) for i in range(100, 140)]
    df = spark.createDataFrame(rows, "s string, m string, who string, amount double")
    got = rows_by(detect.primary_types(df))
    assert got["s"]["pii_type"] == "ssn" and got["m"]["pii_type"] == "email"
    assert got["who"]["pii_type"] == "name" and "amount" not in got


# ------------------------------------------------------------------- risk


def test_k_anonymity_pass_and_fail(spark):
    good = spark.createDataFrame([(25, "a")] * 50 + [(30, "b")] * 50, "age int, zip string")
    assert risk.k_anonymity(good, ["age", "zip"]).first()["satisfied"]
    bad = spark.createDataFrame([(i, str(i)) for i in range(10)], "age int, zip string")
    row = risk.k_anonymity(bad, ["age", "zip"]).first()
    assert not row["satisfied"] and row["groups_below_k"] == 10 and row["min_group_size"] == 1
    with pytest.raises(ValueError):
        risk.k_anonymity(bad, ["nope"])


def test_reidentification_levels(spark):
    low = spark.createDataFrame([("18-30", "M")] * 100, "g string, s string")
    high = spark.createDataFrame([(i, str(i)) for i in range(100)], "age int, zip string")
    assert risk.reidentification_risk(low).first()["risk_level"] == "low"
    assert risk.reidentification_risk(high).first()["risk_level"] == "critical"


def test_missing_keys_leave_groups_but_count_as_rows(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), (None,)], "g string")
    row = risk.uniqueness(df, ["g"]).first()
    assert row["total_records"] == 4 and row["total_unique_combinations"] == 2
    assert risk.reidentification_risk(df, ["g"]).first()["uniqueness_score"] == 0.5


def test_leakage_ignores_rows_with_missing_cells_and_types(spark):
    ref = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    syn = spark.createDataFrame([(1, "a"), (1, "a"), (3, None), (9, "z")], "k long, v string")
    row = risk.data_leakage(ref, syn).first()
    assert row["shared_rows"] == 1 and row["leakage_ratio"] == 0.25 and row["risk_level"] == "critical"


def test_privacy_report_and_summary(spark):
    frame = pd.DataFrame({"age": RNG.integers(20, 40, 300), "zip": RNG.choice(list("abcde"), 300),
                          "gender": RNG.choice(["M", "F"], 300)})
    df = spark.createDataFrame(frame)
    report = risk.privacy_report(df, df)
    got = rows_by(report, "metric")
    assert set(got) == {"k_anonymity", "reidentification_risk", "uniqueness", "data_leakage"}
    assert got["data_leakage"]["risk_level"] == "critical"
    summary = risk.privacy_summary(report).first()
    assert summary["overall_risk"] == "critical" and not summary["passed"]
    texts = [r["recommendation"] for r in risk.recommendations(report).collect()]
    assert risk.ADVICE["critical"] in texts and risk.ADVICE["high"] not in texts


def test_enforced_k_holds(spark):
    df = spark.createDataFrame(pd.DataFrame({"age": RNG.integers(18, 90, 400), "zip": RNG.integers(10000, 10400, 400).astype(str)}))
    safe = risk.enforce_k_anonymity(df, ["age", "zip"], 5, {"age": 20}, {"zip": 3})
    assert safe.count() > 0 and risk.k_anonymity(safe, ["age", "zip"], 5).first()["satisfied"]


# --------------------------------------------------------------- fidelity


def numeric_frame(spark, mean, spread, low=None):
    x = RNG.normal(mean, spread, 1000)
    y = RNG.lognormal(10.5, 0.5, 1000) if low is None else RNG.uniform(0, 100000, 1000)
    return spark.createDataFrame(pd.DataFrame({"age": x, "income": y}))


def test_good_and_poor_stand_ins(spark):
    ref, good, poor = numeric_frame(spark, 35, 10), numeric_frame(spark, 35, 10), numeric_frame(spark, 60, 20, 1)
    a = fidelity.quality_summary(fidelity.quality_report(ref, good)).first()
    b = fidelity.quality_summary(fidelity.quality_report(ref, poor)).first()
    assert a["overall_score"] > 0.85 and a["passed"] and b["overall_score"] < a["overall_score"]
    same = fidelity.quality_report(ref, ref, correlations=True, stage=True)
    assert all(r["value"] == pytest.approx(1.0) for r in same.collect())


def test_text_pii_and_temporal_metrics(spark):
    ref = spark.createDataFrame([("good product",), ("bad service",)] * 20, "t string")
    other = spark.createDataFrame([("zzz",)] * 20, "t string")
    far = {r["metric"]: r["value"] for r in fidelity.text_metrics(ref, other, ["t"]).collect()}
    assert far["vocabulary"] < 0.31
    mails = spark.createDataFrame([("a@x.com",), ("b@x.com",)] * 50, "m string")
    leak = {r["metric"]: r for r in fidelity.pii_metrics(mails, mails, {"m": "email"}).collect()}
    assert leak["format_validity"]["value"] == 1.0 and leak["no_leakage"]["value"] == 0.98
    assert leak["no_leakage"]["passed"] and not leak["diversity"]["passed"]
    days = spark.range(300).select((F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(F.col("id").cast("int"))).alias("d"))
    got = {r["metric"]: r["value"] for r in fidelity.temporal_metrics(days, days.limit(150), ["d"]).collect()}
    assert got["range"] == 1.0 and got["weekday_distribution"] > 0.95
    disjoint = fidelity.temporal_metrics(
        days.filter("month(d) = 1"), days.filter("month(d) = 2"), ["d"])
    month = {r["metric"]: r["value"] for r in disjoint.collect()}["monthly_distribution"]
    assert month == pytest.approx(1 - np.sqrt(np.log(2)))


# -------------------------------------------------------------- fabrication


def person_frame(spark, n=300):
    cities = [("India", "Mumbai"), ("USA", "Austin"), ("UK", "London")]
    rows = [
        (i + 1, f"Ann{i}", "Lee", int(RNG.integers(18, 70)), "Male" if i % 2 else "Female", *cities[i % 3],
         f"a{i}@example.com", dt.datetime(2023, 1, 1) + dt.timedelta(days=i % 90), float(RNG.uniform(20, 900)),
         None if i % 4 == 0 else "said something long about the thing that was bought here")
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "record_id long, first_name string, last_name string, age int, gender string, country string, "
              "city string, email string, signup_date timestamp, purchase_amount double, remark string"
    )


@pytest.fixture(scope="module")
def made(spark):
    ref = person_frame(spark)
    return ref, fabricate(ref, 400, Options(seed=5, keep_nulls=True)).toPandas()


def test_columns_types_and_ids(made):
    ref, out = made
    assert list(out.columns) == ref.columns and len(out) == 400
    assert sorted(out["record_id"]) == list(range(1, 401))
    assert str(out["age"].dtype).startswith("int") and out["age"].between(18, 70).all()
    assert out["purchase_amount"].between(20, 900).all()
    assert 0.1 < out["remark"].isna().mean() < 0.4


def test_rows_agree_across_columns(made):
    _, out = made
    for r in out.itertuples():
        first = "".join(c for c in r.first_name.lower() if c.isalpha())
        last = "".join(c for c in r.last_name.lower() if c.isalpha())
        assert r.email.startswith(f"{first}.{last}")
    pairs = set(zip(out["country"], out["city"]))
    assert all(c in {"Mumbai", "Delhi", "Bengaluru", "Hyderabad", "Chennai"} for k, c in pairs if k == "India")
    assert out["signup_date"].between("2023-01-01", "2023-04-01").all()


def test_same_rows_with_any_partitioning(spark):
    ref = person_frame(spark).select("record_id", "age", "gender", "email", "first_name", "last_name")
    tables = [
        sorted(map(tuple, fabricate(ref, 200, Options(seed=9, partitions=p)).collect())) for p in (1, 7)
    ]
    assert tables[0] == tables[1]


def test_fabrication_does_not_shuffle_or_cross_join(spark):
    ref = person_frame(spark).select("age", "gender", "purchase_amount", "signup_date", "email")
    plan = fabricate(ref, 1000, Options(seed=1))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    top = plan.split("BroadcastExchange")[0]
    assert "hashpartitioning" not in top


def test_correlations_are_kept_on_request(spark):
    x = RNG.normal(0, 1, 800)
    ref = spark.createDataFrame(pd.DataFrame({"a": x, "b": 0.9 * x + 0.2 * RNG.normal(0, 1, 800)}))
    out = fabricate(ref, 2000, Options(keep_correlations=True))
    assert out.agg(F.corr("a", "b")).first()[0] > 0.9


def test_unique_values_stay_unique(spark):
    rows = row_source(spark, 60).withColumn("mail", F.concat(F.lit("a"), (F.col("row_id") % 12).cast("string"), F.lit("@x.org")))
    out = people.make_unique(rows, "mail")
    assert out.select("mail").distinct().count() == 60
    assert blend(rows, rows).filter("origin = 'real'").count() == 60


# --------------------------------------------------- repair, cleaning, rules


def test_integer_repair(spark):
    df = spark.createDataFrame([(0, 1.0, "30.5"), (1, 2.0, None), (2, 3.0, "x"), (3, None, "40")], "row_id long, `Sl No` double, Age string")
    out = repair.repair_integers(df).orderBy("row_id").collect()
    assert [r["Sl No"] for r in out] == [1, 2, 3, 2]
    assert [r["Age"] for r in out] == [30, 35, 35, 40]


def test_derived_columns_in_order(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    rules = [repair.DerivedColumn("d", ["c"], lambda c: c * 10), repair.DerivedColumn("c", ["a", "b"], lambda a, b: a + b),
             repair.DerivedColumn("z", ["missing"], lambda m: m)]
    assert repair.apply_derived(df, rules).first().asDict() == {"a": 1, "b": 2, "c": 3, "d": 30}


def test_cleaning_strategies(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 400.0)], "t int, v double")
    assert clean.handle_missing_values(df, "drop").count() == 2
    assert clean.handle_missing_values(df, "fill", 0, ["v"]).filter("v = 0").count() == 2
    assert clean.handle_missing_values(df, "forward", columns=["v"], order_by=["t"]).filter("v = 1").count() == 3
    with pytest.raises(ValueError):
        clean.handle_missing_values(df, "forward")
    with pytest.raises(ValueError):
        clean.handle_missing_values(df, "magic")
    errors = clean.validate_data_types(df, {"t": "int", "v": "string", "x": "int"}).collect()
    assert [e["error"] for e in errors] == ["Column v: expected string, got double", "Missing column: x"]


def test_knowledge(spark):
    df = spark.createDataFrame([(i, float(i), "a" if i % 3 else "q") for i in range(30)], "id long, v double, c string")
    know = kn.Knowledge.from_dict({
        "constraints": {"v": [{"type": "range", "parameters": {"min": 5, "max": 20}}],
                        "c": [{"type": "category", "parameters": {"categories": ["a", "b"]}}]},
        "terminology": {"c_kinds": ["a", "b"]}, "relationships": {"c": ["v"]},
    })
    fixed, report = kn.enforce_constraints(df, know.constraints, "id")
    changed = {(r["column"], r["constraint"]): r["modified"] for r in report.collect()}
    assert changed == {("v", "range"): 14, ("c", "category"): 10}
    assert fixed.filter("v < 5 OR v > 20 OR c NOT IN ('a', 'b')").count() == 0
    assert know.terms("c", "kinds") == ["a", "b"] and know.related_to("c") == ["v"]
    assert kn.enforce_relationships(df, know.relationships).groupBy("c").agg(F.countDistinct("v").alias("n")).filter("n > 1").count() == 0
    rules = [kn.Rule("r1", "v >= 0"), kn.Rule("r2", "v < 10", when="c = 'q'")]
    got = rows_by(kn.check_rules(df, rules), "rule_id")
    assert got["r1"]["passed"] and got["r2"]["violations"] == 6


def test_dates_do_not_shift_with_the_session_time_zone(spark):
    ref = spark.range(200).select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 60).cast("int"))).alias("day")
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        low, high = fabricate(ref, 300, Options(seed=2)).agg(F.min("day"), F.max("day")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert low >= dt.datetime(2024, 1, 1) and high < dt.datetime(2024, 2, 29) and low.hour == 0
