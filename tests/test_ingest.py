"""Records as delivered: days as written, rejected lines, kinds of values, compacted daily counts, report documents."""

import json

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import metrics, quality
from ticketlake.plans import jobs
from ticketlake.sources import tables, tickets
from ticketlake.streaming import daily

RECORDS = [
    {"ticket_id": "1", "created_at": "2024-01-28T23:30:00-05:00", "subject": 5, "description": "d", "tags": "none", "previous_tickets": 3},
    {"ticket_id": "2", "created_at": "nope", "subject": "x", "description": "d", "tags": ["a"], "satisfaction_score": "9"},
    {"ticket_id": "3", "created_at": "2024-01-28", "subject": "x", "description": "d", "tags": ["a", 3], "agent_actions": []},
]


def lines(tmp_path):
    path = tmp_path / "t.json"
    path.write_text("\n".join(map(json.dumps, RECORDS)) + '\n{"ticket_id": "4", "subj\n\n  \n5\n')
    return str(path)


def test_day_is_that_of_the_time_as_written(spark, tmp_path):
    read = tickets.read_tickets(spark, lines(tmp_path))
    assert read.count() == 3 and read.where("ticket_id = '1'").first()["created_at"].day == 29
    days = {str(r["created_date"]): r["count"] for r in metrics.daily_total(metrics.daily_base(read)).collect()}
    assert days == {"2024-01-28": 2, "None": 1}


def test_rejected_lines(spark, tmp_path):
    source = lines(tmp_path)
    rejects = tickets.read_rejects(spark, source)
    assert sorted(r["record"] for r in rejects.collect()) == ["5", '{"ticket_id": "4", "subj']
    assert rejects.count() == 2 and rejects.select("record").count() == 2
    with pytest.raises(quality.QualityError):
        tickets.land_tickets(spark, source, str(tmp_path / "bronze"), "lines")
    landed = tickets.land_tickets(spark, source, str(tmp_path / "bronze"), "lines", rejects=str(tmp_path / "rejects"))
    assert landed.count() == 3 and spark.read.parquet(str(tmp_path / "rejects")).count() == 2


def test_broken_record_of_an_array_spoils_itself_only(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORDS)[:-30])
    read = tickets.read_tickets(spark, str(tmp_path / "a.json"), "array")
    assert [r["ticket_id"] for r in read.orderBy("ticket_id").collect()] == sorted(r["ticket_id"] for r in RECORDS[:-1])
    rejects = tickets.read_rejects(spark, str(tmp_path / "a.json"), "array").collect()
    assert len(rejects) == 1 and rejects[0]["file"].endswith("a.json")


def test_kinds_of_text_and_lists(spark, tmp_path):
    found = {(r["ticket_id"], r["field"], r["rule"]) for r in quality.violations(tickets.read_raw(spark, lines(tmp_path))).collect()}
    assert found == {
        ("1", "subject", "type"), ("1", "tags", "type"), ("2", "created_at", "type"), ("2", "satisfaction_score", "max"), ("3", "tags", "type"),
    }


def test_daily_table_is_compacted(spark, tmp_path):
    rows = [("2024-01-28T23:30:00-05:00", "a"), ("2024-01-28", "a"), ("2024-01-30", "b"), (None, "a"), ("2024-01-30", "b")]
    for n, row in enumerate(rows):
        spark.createDataFrame([row], "created_at string, category string").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    arriving = daily.read_stream(spark, str(tmp_path / "in" / "*"), spark.read.parquet(str(tmp_path / "in" / "p0")).schema, files_per_batch=1)
    table = str(tmp_path / "out")
    daily.start_upserts(daily.daily_counts(arriving), table, str(tmp_path / "state"), compact_every=2).awaitTermination()
    whole = spark.read.parquet(f"{table}/batch=3")
    assert whole.agg(F.sum("count")).first()[0] == 4
    got = {(str(r["created_date"]), r["category"]): r["count"] for r in daily.current_counts(spark, table, compact_every=2).collect()}
    assert got == {("2024-01-28", "a"): 2, ("2024-01-30", "b"): 2, ("None", "a"): 1}


def test_report_documents(spark, tmp_path):
    scan = spark.createDataFrame(
        [("volume_spikes", None, "2024-01-02", 2.0, 1.0, 0.5, float("inf"), False), ("volume_spikes", None, "2024-01-01", 1.0, None, None, None, False)],
        "scan string, key string, date string, value double, rolling_mean double, rolling_std double, zscore double, is_anomaly boolean",
    )
    tables.write_json_report(jobs.scan_report(scan, window=7, z_threshold=2), str(tmp_path / "r"))
    back = {r["section"]: r for r in jobs.read_scan_report(spark, str(tmp_path / "r")).collect()}
    assert back["params"]["params"].asDict() == {"window": 7, "z_threshold": 2.0, "failure_threshold": 0.1}
    assert [(p["date"], p["zscore"]) for p in back["volume_spikes"]["points"]] == [("2024-01-01", None), ("2024-01-02", None)]
