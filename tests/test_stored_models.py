"""A stored classifier scores every row as the one in memory does."""

import pytest

from ticketlake.operators import models


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted"])
def test_stored_classifier_scores_the_same(spark, tmp_path, kind):
    words = [["printer", "paper", "jam"], ["login", "password", "reset"], ["invoice", "refund", "charge"]]
    rows = [
        (str(i), ["print", "access", "billing"][i % 3], f"{words[i % 3][i % 2]} {words[i % 3][2]} case {i % 5}", None if i % 7 == 0 else f"p{i % 3}", float(i % 11))
        for i in range(90)
    ]
    df = spark.createDataFrame(rows, "ticket_id string, category string, subject string, product string, previous_tickets double")
    blocks = models.FeatureBlocks(["subject"], ["product"], ["previous_tickets"])
    options = {"trees": 5, "max_depth": 3} if kind == "forest" else {"rounds": 3, "max_depth": 3} if kind == "boosted" else {"max_iter": 10}
    model = models.train_classifier(df, "category", blocks, kind, df if kind == "boosted" else None, **options)
    model.save(spark, str(tmp_path / "model"))
    stored = models.Classifier.load(spark, str(tmp_path / "model"))
    key = lambda m: {r["ticket_id"]: (r["predicted"], round(r["confidence"], 12)) for r in m.score(df).collect()}
    assert (stored.name, stored.classes, stored.features.width) == (model.name, model.classes, model.features.width)
    assert key(stored) == key(model)


def test_stored_networks_score_the_same(spark, tmp_path):
    kinds = ["printer jam", "login reset", "invoice refund"]
    rows = [(str(i), kinds[i % 3].split()[0], f"{kinds[i % 3]} case {i % 5}", f"p{i % 3}", float(i % 11)) for i in range(90)]
    df = spark.createDataFrame(rows, "ticket_id string, category string, subject string, product string, previous_tickets double")
    blocks = models.FeatureBlocks(["subject"], ["product"], ["previous_tickets"])
    networks = [
        models.train_text_network(df, "category", ["subject"], svd_dim=3, hidden=64, max_iter=5),
        models.train_full_network(df, "category", blocks, svd_dim=3, hidden=64, max_iter=5),
    ]
    for n, model in enumerate(networks):
        model.save(spark, str(tmp_path / f"model{n}"))
        stored = models.NetworkClassifier.load(spark, str(tmp_path / f"model{n}"))
        key = lambda m: {r["ticket_id"]: (r["predicted"], round(r["confidence"], 9)) for r in m.score(df).collect()}
        assert (stored.name, stored.classes) == (model.name, model.classes) and key(stored) == key(model)
