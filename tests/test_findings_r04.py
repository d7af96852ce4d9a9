"""Searches that ask for every row, networks at their own size, searches and fits that grow with their input."""

import numpy as np
import pytest

import __spark_entry__ as entry
from ticketlake.operators import features, models, projection, retrieval

DOCUMENTS = [(i, "en fr de".split()[i % 3], f"src{i % 2}", f"red apple number{i % 4}\nblue pear number{i % 5} word{i}") for i in range(24)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables with ids that 50 does not divide."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, lang, src, text, len(text)) for i, lang, src, text in DOCUMENTS], "doc_id bigint, lang string, source string, text string, n_chars bigint")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(24)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i, f"green plum number{i}") for i in range(1, 4)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    turns = [(c, t, ("system", "user", "assistant")[t], f"blue pear number{c}") for c in range(1, 5) for t in range(3)]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def asked_ids():
    return {f"b{i}" for i in range(1, 4)} | {f"c-{c}-{t}" for c in range(1, 5) for t in range(3)}


def test_topk_answers_every_query(spark, tables):
    got = entry.queries()["retrieve_topk"](spark, tables).collect()
    assert {r["query_id"] for r in got} == asked_ids() and len(got) == 5 * len(asked_ids())


def test_contexts_answer_every_query(spark, tables):
    got = entry.queries()["retrieval_context"](spark, tables).collect()
    assert sorted(r["query_id"] for r in got) == sorted(asked_ids()) and all(r["context"] for r in got)


def test_envelopes_answer_every_ticket(spark, tables):
    got = entry.queries()["retrieval_envelope"](spark, tables).collect()
    assert sorted(int(r["ticket_id"]) for r in got) == list(range(24)) and all(r["n_results"] == 5 for r in got)


def test_text_network_has_its_own_size(spark, tables, monkeypatch):
    sizes = []

    def trained(train, label, features, name, svd_dim, hidden, max_iter, seed):
        sizes.append((svd_dim, hidden, max_iter))
        raise InterruptedError

    monkeypatch.setattr(models, "_train_network", trained)
    with pytest.raises(InterruptedError):
        entry.queries()["train_eval_text"](spark, tables)
    assert sizes == [(256, 256, 50)]


def test_searches_shuffle_no_vectors(spark, monkeypatch):
    """Pairs are scored where the documents lie; ties and copies come in the order of ids, over many batches and blocks."""
    monkeypatch.setattr(retrieval, "_exact", None)
    monkeypatch.setattr(retrieval, "_PACKED_ROWS", 4)
    rng = np.random.default_rng(8)
    matrix = np.round((rng.random((60, 12)) < 0.3) * rng.random((60, 12)), 1)
    matrix[20:40] = matrix[3]
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    rows = [(f"{59 - i:02d}", "ab"[i % 2], np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(unit)]
    make = lambda id_col, x: spark.createDataFrame(x, f"{id_col} string, category string, idx array<int>, val array<double>")
    asked = [(q, "none" if q < "05" else c, i, v) for q, c, i, v in rows]
    for sizes in ({}, {"cell_docs": 3, "cell_queries": 5, "cell_terms": 9}):
        got = retrieval.retrieve_topk(make("doc_id", rows).repartition(3), make("query_id", asked), 4, **sizes).collect()
        found = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            found.setdefault(r["query_id"], []).append(r["doc_id"])
        for q, c, _, _ in asked:
            pool = [i for i, r in enumerate(rows) if r[1] == c] or range(60)
            scores = np.round(unit @ unit[59 - int(q)], 9)
            assert found[q] == [rows[i][0] for i in sorted(pool, key=lambda i: (-scores[i], rows[i][0]))[:4]]


@pytest.mark.parametrize("sublinear", [True, False])
def test_vectors_of_some_words_at_a_time(spark, monkeypatch, sublinear):
    texts = ["red apple red apple pie", "", None, "apple apple", "unknown words only", "pie red unknown apple", "x red, Apple! pie"]
    terms, idf = ["apple", "apple pie", "pie", "red", "red apple"], [1.5, 2.0, 3.0, 1.25, 2.5]
    monkeypatch.setattr(features, "_WORDS", 4)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r["i"]: r for r in features.TfidfModel(terms, idf, sublinear).transform(df, "t").collect()}
    vectors = {r["i"]: r["v"] for r in features.TfidfModel(terms, idf, sublinear).transform_vector(df, "t", "v").collect()}
    for i, text in enumerate(texts):
        words = [w for w in (text or "").lower().replace(",", "").replace("!", "").split() if len(w) > 1]
        counts = [(words + [f"{a} {b}" for a, b in zip(words, words[1:])]).count(t) for t in terms]
        want = np.array([w * (1 + np.log(c) if sublinear else c) if c else 0.0 for w, c in zip(idf, counts)])
        want = want / (np.linalg.norm(want) or 1.0)
        assert got[i]["idx"] == np.flatnonzero(want).tolist() and np.allclose(got[i]["val"], want[want > 0])
        assert vectors[i].size == 5 and np.allclose(vectors[i].toArray(), want)


def test_fit_has_no_more_partitions_than_cores(spark, tables, monkeypatch):
    parts = []

    class Fit:
        def fit(self, rows):
            parts.append((rows.rdd.getNumPartitions(), rows.count()))
            raise InterruptedError

    monkeypatch.setattr(models, "_estimator", lambda *a, **o: Fit())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
    try:
        train = spark.createDataFrame([(str(i), "ab"[i % 2], f"red apple number{i}") for i in range(200)], "ticket_id string, category string, description string").repartition(40)
        with pytest.raises(InterruptedError):
            models.train_classifier(train, "category", models.FeatureBlocks(["description"], [], []), weighted=False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert parts == [(min(40, spark.sparkContext.defaultParallelism), 200)]


def test_svd_products_in_small_pieces_are_the_same_sums():
    rng = np.random.default_rng(9)
    keys = np.sort(rng.integers(0, 900, 20_000))
    pieces = list(projection._pieces(keys, 7_000))
    assert [p.start for p in pieces] == [0, *[p.stop for p in pieces[:-1]]] and pieces[-1].stop == len(keys)
    assert {7_000, 14_000} <= {p.start for p in pieces} and max(p.stop - p.start for p in pieces) <= 2 * projection.ENTRIES
    idx, val, basis = rng.integers(0, 300, len(keys)), rng.random(len(keys)), rng.random((300, 7))
    whole = np.zeros((900, 7))
    for at in (slice(0, 7_000), slice(7_000, 14_000), slice(14_000, None)):
        found, sums = projection._row_sums(keys[at], val[at, None] * basis[idx[at]])
        whole[found] += sums
    assert np.array_equal(projection.multiply_rows(keys, idx, val, 900, basis, 7_000), whole)
