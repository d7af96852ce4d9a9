"""Searches bounded by the index, queries of searches, dense columns, rows that training reads."""

import numpy as np
from pyspark.sql import functions as F

from ticketlake.operators import features, models, projection, retrieval
from ticketlake.plans import bindings


def vectors(spark, n, id_col):
    """Every row has every term, so each list holds the whole category."""
    rng = np.random.default_rng(n)
    rows = [(f"{i:04d}", "c", list(range(8)), (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.random((n, 8)))]
    return spark.createDataFrame(rows, f"{id_col} string, category string, idx array<int>, val array<double>")


def test_lists_read_no_more_than_the_index_holds(spark):
    index = vectors(spark, 60, "doc_id").withColumn("doc_row", F.col("doc_id").cast("bigint"))
    asked = vectors(spark, 40, "query_id")
    routed = retrieval._routes(index, asked).select("query_id", "route", "idx", "val")
    _, dear = retrieval._search_lists(index, routed, 5, 1e9)
    # A query reads up to 480 postings, as many as the index has: forty of them are scanned.
    assert dear.count() >= 39
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.retrieve_topk(index, asked, 5, list_share=1e9).collect()}
    a, b = (np.array([r["val"] for r in df.orderBy(df.columns[0]).collect()]) for df in (asked, index))
    want = np.argsort(-(a @ b.T), axis=1)[:, :5]
    assert got == {(f"{q:04d}", r + 1): f"{d:04d}" for q, row in enumerate(want) for r, d in enumerate(row)}


def test_cells_mix_columns_and_lists(spark, monkeypatch):
    rng = np.random.default_rng(4)
    dense = (rng.random((90, 40)) < np.where(np.arange(40) < 5, 0.9, 0.05)) * rng.random((90, 40)) + np.eye(90, 40) * 0.1
    rows = [(f"{i:03d}", "c", np.flatnonzero(v).tolist(), (v[v > 0] / np.linalg.norm(v)).tolist()) for i, v in enumerate(dense)]
    make = lambda id_col: spark.createDataFrame(rows, f"{id_col} string, category string, idx array<int>, val array<double>")
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    got = key(retrieval.retrieve_topk(make("doc_id"), make("query_id"), 3, list_share=-1e9))
    unit = dense / np.linalg.norm(dense, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    for q, rank, doc, score in got:
        mine = scores[int(q)]
        best = sorted(range(90), key=lambda d, mine=mine: (-mine[d], d))[rank - 1]
        assert int(doc) == best and abs(score - mine[best]) < 2e-9
    assert len(got) == 270


def test_searches_ask_every_fiftieth_row(spark):
    df = spark.createDataFrame([(str(i),) for i in range(0, 201)] + [(None,)], "ticket_id string")
    assert sorted(int(r[0]) for r in bindings.asked_rows(df, "ticket_id").collect()) == [0, 50, 100, 150, 200]


def test_products_with_frequent_and_rare_positions():
    rng = np.random.default_rng(5)
    matrix = (rng.random((5000, 300)) < np.where(np.arange(300) < 20, 0.5, 0.005)) * rng.random((5000, 300))
    row, idx = np.nonzero(matrix)
    basis = rng.random((300, 7))
    assert np.allclose(projection.multiply(row, idx, matrix[row, idx], 5000, basis), matrix @ basis)
    common, dense, rest = projection._dense_columns(row, idx, matrix[row, idx], 5000, 300)
    assert common.tolist() == list(range(20)) and np.array_equal(dense, matrix[:, :20]) and np.array_equal(rest, idx >= 20)


def test_training_rows_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(models, "materialize", lambda df, name: written.append(name) or features.materialize(df, name))
    rows = [(str(i), "ab"[i % 2], f"{'red apple' if i % 2 else 'green pear'} number{i % 5}") for i in range(40)]
    train = spark.createDataFrame(rows, "ticket_id string, category string, description string")
    models.shuffle_sanity(train, train, "category", "ticket_id", models.FeatureBlocks(["description"], [], []), max_iter=3).collect()
    assert written == ["permuted-labels", "training-rows"]
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_vocabulary_counts_only_pairs_that_can_be_in_it(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 200) for _ in range(60)] + ["", None, "w1 w1 w1", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    sent = []
    pairs = features._pair_counts
    monkeypatch.setattr(features, "_pair_counts", lambda s: sent.append(s.value) or pairs(s))
    # Few terms wanted, all terms wanted, ties at the limit, one term.
    for min_df, most in ((2, 12), (1, 5000), (2, 40), (3, 1)):
        want = features.vocabulary(features.with_terms(df, "text"), min_df, most).collect()
        assert features.text_vocabulary(df, "text", min_df, most).collect() == want
    n_words = len({w for t in texts if t for w in t.split() if len(w) > 1})
    assert len(sent[0]) < n_words / 4 and len(sent[1]) == n_words
