import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check

import __spark_entry__ as entry

SF = os.environ.get("TICKETLAKE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = check.rows_of(columns, cursor.fetchall())
    assert check.rows_of(df.columns, df.collect()) == want


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from ticketlake.streaming import daily

    events = spark.read.parquet(f"{SF}/events.parquet")
    source = str(tmp_path / "in")
    events.repartitionByRange(4, "ts").write.parquet(source)
    arriving = daily.read_stream(spark, source, events.schema, files_per_batch=1).select(
        F.col("ts").alias("created_at"), F.col("event_type").alias("category")
    )
    table = str(tmp_path / "out")
    daily.start_upserts(daily.daily_counts(arriving, lateness="60 days"), table, str(tmp_path / "state")).awaitTermination()
    got = sorted(map(str, daily.current_counts(spark, table).collect()))
    want = events.groupBy(F.to_date("ts").alias("created_date"), F.col("event_type").alias("category")).count()
    assert got == sorted(map(str, want.collect()))
