import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import anomaly, evaluation, metrics, quality
from ticketlake.plans import jobs

DAY0 = dt.date(2024, 1, 1)


def daily(spark, values, key=None):
    return spark.createDataFrame([(key, DAY0 + dt.timedelta(d), float(v)) for d, v in values], "category string, created_date date, count double")


def spike_rows(df):
    return df.orderBy("date").collect()


@pytest.mark.parametrize("n,flagged", [(11, True), (9, False), (14, True)])
def test_single_outlier_scores_root_of_n_minus_one(spark, n, flagged):
    df = daily(spark, [(i, 10) for i in range(n - 1)] + [(n - 1, 100)])
    last = spike_rows(anomaly.volume_spikes(df))[-1]
    assert last["zscore"] == pytest.approx(math.sqrt(n - 1)) and last["is_anomaly"] is flagged


def test_constant_series_has_no_score(spark):
    rows = spike_rows(anomaly.volume_spikes(daily(spark, [(i, 5) for i in range(20)])))
    assert all(r["rolling_std"] is None and r["zscore"] is None and not r["is_anomaly"] for r in rows)
    assert [r["rolling_mean"] is None for r in rows] == [True] * 6 + [False] * 14
    with pytest.warns(UserWarning):
        short = anomaly.volume_spikes(daily(spark, [(i, i) for i in range(5)]), window=4)
    assert [r["rolling_mean"] is None for r in spike_rows(short)] == [True, True, False, False, False]


def test_densify_fills_each_key_on_its_own(spark):
    df = daily(spark, [(0, 3), (1, 4), (4, 6)], "a").unionByName(daily(spark, [(1, 9)], None))
    df = df.unionByName(spark.createDataFrame([("a", None, 7.0)], df.schema))
    got = anomaly.densify(df, "category", "created_date", "count").orderBy("category", "date").collect()
    assert [(r["category"], r["value"]) for r in got] == [(None, 9.0), ("a", 3.0), ("a", 4.0), ("a", 0.0), ("a", 0.0), ("a", 6.0)]


def test_densify_rejects_duplicate_days(spark):
    with pytest.raises(Exception, match="duplicate day"):
        anomaly.densify(daily(spark, [(0, 1), (0, 2)]), None, "created_date", "count").collect()


def test_failure_rate_flags(spark):
    df = spark.createDataFrame([(DAY0, 0.10), (DAY0 + dt.timedelta(2), 0.09)], "created_date date, failure_rate double")
    got = anomaly.retrieval_failure(df).orderBy("date").collect()
    assert [(r["failure_rate"], r["is_anomaly"]) for r in got] == [(0.10, True), (0.0, False), (0.09, False)]
    assert anomaly.retrieval_failure(df.limit(0)).collect() == []


def tickets(spark):
    rows = [
        ("2024-01-01T10:00:00Z", "a", "happy", [], None), ("2024-01-01T23:59:59Z", None, "upset", None, True),
        ("bad", "a", None, ["k"], False), ("2024-01-03", "b", "calm", [], False),
    ]
    return spark.createDataFrame(
        rows, "created_at string, category string, customer_sentiment string, kb_articles_helpful array<string>, "
        "auto_suggestion_accepted boolean"
    )


def test_daily_tables_and_scan(spark, tmp_path):
    tables = jobs.daily_metrics(tickets(spark))
    total = {str(r["created_date"]): r["count"] for r in tables["daily_total"].collect()}
    assert total == {"2024-01-01": 2, "None": 1, "2024-01-03": 1}
    rates = {str(r["created_date"]): (r["success"], r["failure"], r["failure_rate"]) for r in tables["retrieval_daily"].collect()}
    assert rates == {"2024-01-01": (1, 1, 0.5), "None": (1, 0, 0.0), "2024-01-03": (0, 1, 1.0)}
    scan = jobs.daily_scan(spark, tickets(spark), str(tmp_path / "m"), str(tmp_path / "report"))
    counts = {r["scan"]: r["n"] for r in scan.groupBy("scan").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"volume_spikes": 3, "category_spikes": 3, "sentiment_shift": 3, "retrieval_failure": 3}
    report = spark.read.json(str(tmp_path / "report"))
    assert report.count() == 12 and dict(report.dtypes)["date"] in ("string", "date")


def test_class_weights(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "y string")
    assert sorted(r["weight"] for r in metrics.class_weights(df, "y").collect()) == pytest.approx([0.6, 1.2, 1.2])
    assert metrics.with_class_weight(df, "y").count() == 4


def test_category_counts_top_breaks_ties_by_name(spark):
    rows = [("train", "b"), ("train", "a"), ("val", " "), ("val", "a"), ("val", "a")]
    got = metrics.category_counts(spark.createDataFrame(rows, "split string, category string"), top=1).collect()
    assert {(r["scope"], r["split"], r["category"], r["n"]) for r in got} == {
        ("split", "train", "a", 1), ("split", "val", "a", 2), ("all_splits", None, "a", 3),
        ("split_total", "train", None, 2), ("split_total", "val", None, 3),
    }


def test_classification_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y string, p string")
    report = {r["label"]: r for r in evaluation.classification_report(df, "y", "p").collect()}
    assert (report["a"]["precision"], report["a"]["recall"], report["a"]["f1"]) == pytest.approx((1, 0.5, 2 / 3))
    assert (report["b"]["precision"], report["b"]["recall"], report["b"]["f1"]) == pytest.approx((0.5, 1, 2 / 3))
    assert report["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert evaluation.f1_weighted(df, "y", "p").first()["f1_weighted"] == pytest.approx(2 / 3)
    dense = {r["actual"]: (r["a"], r["b"]) for r in evaluation.confusion_matrix_dense(df, "y", "p", ["a", "b"]).collect()}
    assert dense == {"a": (1, 1), "b": (0, 1)}


def raw(spark):
    rows = [("1", "2024-01-01", "s", "d", "3", "-1", "x1"), (None, "nope", None, "d", "9", "2", None)]
    return spark.createDataFrame(
        rows, "ticket_id string, created_at string, subject string, description string, satisfaction_score string, "
        "previous_tickets string, resolution_time_hours string"
    )


def test_violations_and_gate(spark, tmp_path):
    got = {(r["ticket_id"], r["field"], r["rule"]) for r in quality.violations(raw(spark)).collect()}
    assert got == {
        ("1", "previous_tickets", "min"), ("1", "resolution_time_hours", "type"), (None, "ticket_id", "required"),
        (None, "created_at", "type"), (None, "subject", "required"), (None, "satisfaction_score", "max"),
    }
    with pytest.raises(quality.QualityError):
        quality.validate_or_raise(raw(spark))
    report = quality.dq_report(quality.typed(raw(spark)))
    row = report.first()
    assert not row["success"] and row["row_count"] == 2 and len(row["checks"]) == 7
    with pytest.raises(quality.QualityError):
        quality.quality_gate(report, str(tmp_path / "dq"))
    assert spark.read.json(str(tmp_path / "dq")).count() == 1
    good = quality.typed(raw(spark)).where("ticket_id = '1'")
    quality.quality_gate(quality.dq_report(good))


def test_missing_required_column_fails(spark):
    checks = {r["check"]: r for r in quality.dq_checks(raw(spark).drop("subject")).collect()}
    assert checks["non_null:subject"]["error"] == "missing_column" and not checks["non_null:subject"]["passed"]


def test_split_profile(spark):
    df = raw(spark).withColumn("split", F.lit("train"))
    got = {(r["metric"], r["name"]): r["value"] for r in quality.split_profile(df).collect()}
    assert got[("n_rows", "")] == 2 and got[("n_cols", "")] == 7 and got[("missing_column", "category")] == 1
    assert got[("null_count", "subject")] == 1 and ("null_count", "description") not in got
