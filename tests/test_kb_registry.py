import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import graph, registry, retrieval, summary


def unit(rng, n_terms):
    idx = sorted(rng.sample(range(n_terms), rng.randint(1, 4)))
    val = np.array([rng.choice([0.5, 1.0, 2.0]) for _ in idx])
    return idx, [float(x) for x in val / np.linalg.norm(val)]


def vectors(spark, rows, id_col):
    return spark.createDataFrame(rows, f"{id_col} string, category string, idx array<int>, val array<double>")


@pytest.mark.parametrize("cell_docs,cell_queries,list_share", [(20_000, 2_048, 1e9), (7, 3, 1e9), (7, 3, -1e9), (20_000, 2_048, -1e9)])
def test_topk_matches_brute_force(spark, monkeypatch, cell_docs, cell_queries, list_share):
    """By inverted lists from the first posting on, and by scanning cells."""
    monkeypatch.setattr(retrieval, "_FIRST_POSTINGS", 1)
    rng = random.Random(1)
    docs = [(f"d{i}", "hot" if i % 3 else f"c{i % 4}", *unit(rng, 12)) for i in range(120)]
    docs += [("empty", "hot", [], [])]
    queries = [(f"q{i}", rng.choice(["hot", "c0", "absent", ""]), *unit(rng, 14)) for i in range(25)]
    queries += [("nothing", "hot", [], [])]
    got = retrieval.retrieve_topk(
        vectors(spark, docs, "doc_id"), vectors(spark, queries, "query_id"), 5, cell_docs, cell_queries, list_share=list_share
    ).collect()
    known = {d[1] for d in docs}
    for qid, category, idx, val in queries:
        weights = dict(zip(idx, val))
        pool = [d for d in docs if d[1] == category] if category in known else docs
        scores = {d[0]: sum(weights.get(t, 0.0) * w for t, w in zip(d[2], d[3])) for d in pool}
        best = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:5]
        mine = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == qid)
        assert [m[1] for m in mine] == best
        assert [m[2] for m in mine] == pytest.approx([scores[d] for d in best])
        assert all(-1e-9 <= m[2] <= 1 + 1e-9 for m in mine)


def test_rerank_by_quality_is_optional(spark):
    index = spark.createDataFrame(
        [("a", "p", "c", "s", "r", 0.0), ("b", "p", "c", "s", "r", 1.0)],
        "doc_id string, product string, category string, subcategory string, resolution_code string, quality double",
    )
    hits = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.1, 2)], "query_id string, doc_id string, score double, rank int")
    plain = {r["doc_id"]: r["rank"] for r in retrieval.hit_records(hits, index).collect()}
    again = {r["doc_id"]: r["rank"] for r in retrieval.hit_records(hits, index, rerank_by_quality=True).collect()}
    assert plain == {"a": 1, "b": 2} and again == {"a": 2, "b": 1}


def test_kb_documents_need_an_id(spark):
    schema = (
        "ticket_id string, subject string, product string, category string, subcategory string, tags array<string>, "
        "resolution_code string, kb_articles_helpful array<string>, kb_articles_viewed array<string>, resolution string, "
        "description string, resolution_helpful boolean"
    )
    rows = [("t1", "s", None, "c", None, None, None, None, None, None, "d", None),
            ("", "s", "p", "c", None, None, None, None, None, None, "d", True),
            (None, "s", "p", "c", None, None, None, None, None, None, "d", True)]
    got = retrieval.kb_documents(spark.createDataFrame(rows, schema)).collect()
    assert [(r["doc_id"], r["product"], r["quality"]) for r in got] == [("t1", "", 0.0)]


def test_graph_of_one_and_two_documents(spark):
    schema = "doc_id string, product string, category string, subcategory string, resolution_code string"
    one = spark.createDataFrame([("d1", "p", "c", "", "r")], schema)
    two = spark.createDataFrame([("d1", "p", "c", "", "r"), ("d2", "p", "c", "", "r")], schema)
    assert (graph.graph_nodes(one).count(), graph.graph_edges(one).count()) == (5, 5)
    assert (graph.graph_nodes(two).count(), graph.graph_edges(two).count()) == (6, 8)
    assert graph.graph_nodes(one).where("node = 'SUBCATEGORY::'").count() == 1


def dense_textrank(words, top, damping=0.85, epsilon=1e-4):
    n = len(words)
    sim = np.zeros((n, n))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            common = sum(b.count(w) for w in a)
            norm = np.log(max(len(a), 1)) + np.log(max(len(b), 1))
            sim[i, j] = common / norm if norm > 0 else common
    sim /= sim.sum(axis=1, keepdims=True) + 1e-7
    rank = np.full(n, 1.0 / n)
    while True:
        nxt = (1 - damping) / n * rank.sum() + damping * sim.T @ rank
        done = np.linalg.norm(nxt - rank) <= epsilon
        rank = nxt
        if done:
            break
    return sorted(int(i) for i in np.lexsort((np.arange(n), -np.round(rank, 12)))[:top])


@pytest.mark.parametrize("cells", [2_000_000, 20])
def test_sentence_ranking_matches_dense_matrix(monkeypatch, cells):
    monkeypatch.setattr(summary, "_TABLE_CELLS", cells)
    rng = random.Random(3)
    for _ in range(20):
        words = [[f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 7))] for _ in range(rng.randint(1, 25))]
        got = summary._ranker(6, 0.85, 1e-4)(words)
        assert got == (dense_textrank(words, 6) if len(words) > 6 and any(words) else list(range(min(6, len(words)))))


def test_summary_keeps_text_order(spark):
    text = "Alpha beta gamma. Delta! Beta gamma alpha beta.\n\nNew line here? Alpha again beta. Zeta eta. Theta iota. Beta alpha."
    got = summary.extractive_summary(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t", 3).collect()
    rows = {r["id"]: r for r in got}
    chosen = rows[1]["summary"]
    parts = ["Alpha beta gamma.", "Delta!", "Beta gamma alpha beta.", "New line here?", "Alpha again beta.", "Zeta eta.", "Theta iota.", "Beta alpha."]
    kept = [p for p in parts if p in chosen]
    assert rows[1]["n_sentences"] == 8 and chosen == " ".join(kept) and len(kept) == 3 and "Beta gamma alpha beta." in kept
    assert (rows[2]["n_sentences"], rows[2]["summary"]) == (0, "")


def events(spark, rows):
    return spark.createDataFrame([(i, *r, f"t{i:04d}") for i, r in enumerate(rows)], "seq long, action string, name string, version string, stage string, created_at string")


def fold(rows, archive_any):
    entries = []
    for i, (action, name, version, stage) in enumerate(rows):
        if action == "register":
            entries.append({"name": name, "version": version, "stage": stage, "created_at": f"t{i:04d}"})
            continue
        for e in entries:
            if e["name"] != name:
                continue
            if e["version"] == version:
                e["stage"] = stage
            elif e["stage"] == "Production" and (archive_any or stage == "Production"):
                e["stage"] = "Archived"
    return sorted(tuple(e.values()) for e in entries)


@pytest.mark.parametrize("archive_any", [False, True])
def test_registry_state_matches_replay(spark, archive_any):
    rng = random.Random(5)
    rows = [
        (rng.choice(["register", "promote", "promote"]), rng.choice("ab"), f"v{rng.randint(1, 4)}", rng.choice(["Production", "Staging", "None"]))
        for _ in range(120)
    ]
    got = registry.registry_state(events(spark, rows), archive_any).select("name", "version", "stage", "created_at").collect()
    assert sorted(map(tuple, got)) == fold(rows, archive_any)


def test_promotion_story(spark):
    story = [("register", "m", "v1", "Staging"), ("register", "m", "v2", "Staging"), ("promote", "m", "v1", "Production"),
             ("promote", "m", "v2", "Production")]
    state = {r["version"]: r["stage"] for r in registry.registry_state(events(spark, story)).collect()}
    assert state == {"v1": "Archived", "v2": "Production"}
    story += [("promote", "m", "v1", "Staging"), ("promote", "x", "v9", "Production")]
    assert {r["version"]: r["stage"] for r in registry.registry_state(events(spark, story)).collect()}["v2"] == "Production"
    any_state = registry.registry_state(events(spark, story), archive_on_any_promotion=True)
    assert {r["version"]: r["stage"] for r in any_state.collect()}["v2"] == "Archived"
    assert [tuple(r) for r in registry.registry_pointer(events(spark, story)).collect()] == [("m", "v1")]
    latest = registry.latest_production(registry.registry_state(events(spark, story))).collect()
    assert [(r["name"], r["version"]) for r in latest] == [("m", "v2")]
