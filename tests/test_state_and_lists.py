"""Days that close, repeated appends, tables that are not ours, stored projections, retrieval work as both sides grow."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ticketlake.operators import features, projection, retrieval
from ticketlake.sources import tables
from ticketlake.streaming import daily


def test_days_close_and_late_tickets_are_kept(spark, tmp_path):
    batches = [
        [("2024-01-01 10:00:00", "a"), ("2024-01-02 10:00:00", "a")],
        [("2024-01-01 11:00:00", "a"), ("2024-01-05 10:00:00", "b"), (None, "a")],
        [("2024-01-02 12:00:00", "a"), ("2024-01-04 12:00:00", "a"), ("never", "c"), ("2024-01-05 09:00:00", "b")],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "created_at string, category string").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "p0")).schema
    arriving = daily.read_stream(spark, str(tmp_path / "in" / "*"), schema, files_per_batch=1)
    table, late = str(tmp_path / "counts"), str(tmp_path / "late")
    daily.start_closing(arriving, table, late, str(tmp_path / "state"), "1 day").awaitTermination()
    got = {(str(r["created_date"]), r["category"]): (r["count"], r["is_open"]) for r in daily.closing_counts(spark, table).collect()}
    # After the second batch the days before the 4th are closed.
    assert got == {
        ("2024-01-01", "a"): (2, False), ("2024-01-02", "a"): (1, False), ("2024-01-04", "a"): (1, True), ("2024-01-05", "b"): (2, True),
    }
    lost = spark.read.schema("created_at string, category string").parquet(f"{late}/batch=*")
    assert sorted(map(str, (r["created_at"] for r in lost.collect()))) == ["2024-01-02 12:00:00", "None", "never"]
    assert sum(n for n, _ in got.values()) + lost.count() == sum(map(len, batches))
    with pytest.raises(ValueError):
        daily.start_closing(arriving, table, late, str(tmp_path / "other"), "1 day")


def test_compaction_setting_is_stored(spark, tmp_path):
    spark.createDataFrame([("2024-01-01", "a")], "created_at string, category string").write.parquet(str(tmp_path / "in" / "p"))
    arriving = daily.read_stream(spark, str(tmp_path / "in" / "*"), spark.read.parquet(str(tmp_path / "in" / "p")).schema)
    table = str(tmp_path / "out")
    daily.start_upserts(daily.daily_counts(arriving), table, str(tmp_path / "state"), compact_every=3).awaitTermination()
    assert daily.current_counts(spark, table).count() == 1
    with pytest.raises(ValueError):
        daily.current_counts(spark, table, compact_every=100)
    with pytest.raises(ValueError):
        daily.start_upserts(daily.daily_counts(arriving), table, str(tmp_path / "state"))


def test_a_run_is_logged_once(spark, tmp_path):
    path = str(tmp_path / "log")
    run = lambda i, status: spark.createDataFrame([(i, status)], "run_id string, status string")
    for record in (run("a", "finished"), run("b", "failed"), run("a", "finished")):
        tables.append_run(record, path)
    tables.append_run(run("a", "finished").union(run("b", "failed")), path)
    runs, malformed = tables.read_run_log(spark, path)
    assert sorted((r["run_id"], r["status"]) for r in runs.collect()) == [("a", "finished"), ("b", "failed")] and malformed.count() == 0


def test_files_that_are_no_table_are_not_overwritten(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "readme.txt").write_text("keep me")
    with pytest.raises(Exception):  # which error it is depends on what Spark finds there
        tables.ensure_table(spark, str(tmp_path / "notes"), lambda: spark.range(3))
    assert (tmp_path / "notes" / "readme.txt").read_text() == "keep me"
    (tmp_path / "empty").mkdir()
    assert tables.ensure_table(spark, str(tmp_path / "empty"), lambda: spark.range(3)).count() == 3


def sparse_rows(spark, matrix):
    rows = [(i, Vectors.sparse(matrix.shape[1], np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist())) for i, r in enumerate(matrix)]
    return spark.createDataFrame(rows, ["i", "v"]).repartition(3)


@pytest.mark.parametrize("panel_bytes", [1 << 25, 2100 * 8 * 4])
def test_svd_over_blocks_and_panels(spark, tmp_path, panel_bytes):
    """Several blocks of positions, one or several panels, less rows than positions, repeated rows."""
    rng = np.random.default_rng(1)
    matrix = (rng.random((60, 2100)) < 0.03) * rng.random((60, 2100))
    matrix[:, :6] *= np.array([50, 40, 30, 20, 10, 5])
    matrix[50:] = matrix[:10]
    df = sparse_rows(spark, matrix)
    model = projection.fit_svd(df, "v", 10, panel_bytes=panel_bytes)
    v = model.panel(slice(0, 10))
    assert np.abs(v.T @ v - np.eye(10)).max() < 1e-9
    assert np.allclose(model.singular_values, np.linalg.svd(matrix, compute_uv=False)[:10], rtol=1e-2)
    model.save(spark, str(tmp_path / "svd"))
    idx, val = projection.vector_parts("v")
    rows = df.withColumns({"idx": idx, "val": val})
    for m in (model, projection.SvdModel.load(spark, str(tmp_path / "svd"))):
        got = {r["i"]: r["dense"] for r in m.transform(rows).collect()}
        assert np.allclose([got[i] for i in range(60)], matrix @ v)
    # As many components as the rows have dimensions.
    assert len(projection.fit_svd(df, "v", 200).singular_values) == 50


def test_svd_is_repeatable_and_bounded_by_rows(spark):
    rng = np.random.default_rng(2)
    matrix = rng.random((12, 40))
    df = sparse_rows(spark, matrix)
    a, b = (projection.fit_svd(df, "v", 256) for _ in range(2))
    assert len(a.singular_values) == 12 and np.allclose(a.singular_values, b.singular_values)
    assert np.allclose(a.singular_values, np.linalg.svd(matrix, compute_uv=False))
    assert projection.fit_svd(df.limit(0), "v", 5).singular_values == []


def test_vectors_from_positions(spark):
    df = spark.createDataFrame([([1, 5], [0.1, 2 / 3]), ([], [])], "idx array<int>, val array<double>")
    got = [r["v"] for r in df.select(features.to_sparse_vector(9)("idx", "val").alias("v")).collect()]
    assert got == [Vectors.sparse(9, [1, 5], [0.1, 2 / 3]), Vectors.sparse(9, [], [])]


def test_list_work_grows_with_the_lists(spark):
    """Four times the documents and four times the queries: the partial scores grow far less than the sixteenfold pairs."""
    rng = np.random.default_rng(3)

    def vectors(n, id_col, terms):
        rows = []
        for i in range(n):
            # One rare term, which a few documents share, and two frequent ones of little weight.
            idx = [int(rng.integers(2)), 2 + int(rng.integers(2)), 10 + i % terms]
            val = np.array([0.05, 0.05, 1.0])
            rows.append((f"{i:05d}", "c", idx, (val / np.linalg.norm(val)).tolist()))
        return spark.createDataFrame(rows, f"{id_col} string, category string, idx array<int>, val array<double>")

    def work(docs, queries):
        index = vectors(docs, "doc_id", docs // 8).withColumn("doc_row", F.col("doc_id").cast("bigint"))
        asked = vectors(queries, "query_id", docs // 8)
        routed = retrieval._routes(index, asked).select("query_id", "route", "idx", "val")
        lists, tops = retrieval.posting_lists(index, routed)
        read = routed.select(*retrieval._entries("query_id", "route")).join(tops, ["route", "term"])
        found, dear = retrieval._search_lists(index, routed, 5, 0.5)
        assert dear.isEmpty()
        return found.count(), read.count()

    small, large = work(400, 50), work(1600, 200)
    assert large[0] <= 5 * small[0]
