import json

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import models, registry, splits
from ticketlake.plans import jobs
from ticketlake.schema import FIELD_TYPES, complete_nullable, complete_typed
from ticketlake.sources import tables, tickets

RECORDS = [
    {"ticket_id": "1", "created_at": "2024-01-28T02:46:19Z", "subject": "é", "description": "d", "satisfaction_score": "5",
     "escalated": "false", "tags": ["a", "b"]},
    {"ticket_id": "2", "created_at": "nope", "subject": "s", "description": "d", "satisfaction_score": "12x"},
]


def test_schema_has_all_fields():
    assert len(FIELD_TYPES) == 60


@pytest.mark.parametrize("layout", ["array", "lines"])
def test_json_layouts(spark, tmp_path, layout):
    path = tmp_path / "t.json"
    body = json.dumps(RECORDS, indent=1) if layout == "array" else "\n".join(json.dumps(r) for r in RECORDS)
    path.write_text(body, encoding="utf-8")
    rows = tickets.read_tickets(spark, str(path), layout).orderBy("ticket_id").collect()
    assert (rows[0]["subject"], rows[0]["satisfaction_score"], rows[0]["escalated"], rows[0]["tags"]) == ("é", 5, False, ["a", "b"])
    assert rows[1]["created_at"] is None and rows[1]["satisfaction_score"] is None
    landed = tickets.land_tickets(spark, str(path), str(tmp_path / "bronze"), layout)
    assert landed.count() == 2 and landed.schema["created_at"].dataType.typeName() == "timestamp"


def test_other_encoding(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_bytes(json.dumps(RECORDS[:1], ensure_ascii=False).encode("latin-1"))
    assert tickets.read_tickets(spark, str(path), "array", "ISO-8859-1").first()["subject"] == "é"


def test_layout_is_checked(spark):
    with pytest.raises(ValueError):
        tickets.read_raw(spark, "x", "guess")


def test_completion_policies(spark):
    df = spark.createDataFrame([("t", None, None)], "subject string, product string, affected_users string")
    typed = complete_typed(df).first()
    assert (typed["subject"], typed["product"], typed["affected_users"], typed["escalated"], typed["category"]) == ("t", "unknown", 0.0, False, "Unknown")
    loose = complete_nullable(df).first()
    assert loose["product"] is None and loose["known_issue"] is False and loose["subcategory"] is None


def test_flatten(spark):
    df = spark.createDataFrame([((1, (2, 3)),)], "a struct<b:int,c:struct<d:int,e:int>>")
    assert tickets.flatten_structs(df).columns == ["a.b", "a.c.d", "a.c.e"]


def test_pick_ticket(spark):
    df = spark.createDataFrame([(str(i), "A " if i % 2 else None) for i in range(6)], "ticket_id string, category string")
    assert tickets.pick_ticket(df, category=" a", index=1)["ticket_id"] == "3"
    assert tickets.pick_ticket(df, category="A")["ticket_id"] in {"1", "3", "5"}
    with pytest.raises(LookupError):
        tickets.pick_ticket(df, category="b")
    with pytest.raises(LookupError):
        tickets.pick_ticket(df, index=6)
    with pytest.raises(IndexError):
        tickets.pick_ticket(df, index=-1)


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in range(12):
        record = registry.run_record(spark, f"r{i}", f"2024-01-{i + 1:02d}", "train", "finished", {"epochs": i}, {"val_f1_weighted": 0.5})
        tables.append_run(record, path)
    (tmp_path / "runs" / "bad.json").write_text('{"run_id": "x", \n\n  \n{"id": "old", "when": "2023"}\n')
    runs, malformed = tables.read_run_log(spark, path)
    assert runs.count() == 13 and [r["value"] for r in malformed.collect()] == ['{"run_id": "x", ']
    summary = registry.run_summary(runs).collect()
    assert summary[0]["run_id"] == "r11" and summary[-1]["run_id"] == "old" and summary[0]["epochs"] == "11"
    assert registry.recent_runs(runs).count() == 10


def test_ensure_table_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.ensure_table(spark, str(tmp_path / "t"), build).count() == 3
    assert len(calls) == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", 1.5), ("test", float("nan")), ("val", float("inf"))], "split string, x double")
    tables.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'val'").count() == 1
    tables.write_json_report(df, str(tmp_path / "j"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(str(x["x"]) for x in lines) == ["1.5", "None", "None"]
    tables.write_csv(df.where("split = 'train'"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["split", "x"]


def toy_tickets(spark, n=240):
    i = F.col("id")
    kind = F.element_at(F.array(F.lit("network"), F.lit("billing"), F.lit("login")), (i % 3 + 1).cast("int"))
    return spark.range(n).select(
        F.concat(F.lit("t"), i).alias("ticket_id"), kind.alias("category"),
        F.when(i % 2 == 0, "x").otherwise("y").alias("subcategory"),
        F.concat(kind, F.lit(" problem "), F.lit("case"), i % 17).alias("subject"),
        F.concat(F.lit("the "), kind, F.lit(" service fails for user "), i).alias("description"),
        F.lit(None).cast("string").alias("error_logs"), F.lit("").alias("stack_trace"),
        F.when(i % 3 == 0, "p0").otherwise("p1").alias("product"), (i % 5).cast("double").alias("affected_users"),
        F.lit("r").alias("resolution_code"), F.lit(None).cast("string").alias("resolution"),
        F.array(F.lit("tag")).alias("tags"), F.lit(None).cast("array<string>").alias("kb_articles_helpful"),
        F.lit(None).cast("array<string>").alias("kb_articles_viewed"), (i % 2 == 0).alias("resolution_helpful"),
        (i % 4 == 0).alias("contains_error_code"),
    )


BLOCKS = models.FeatureBlocks(["subject", "description"], ["product"], ["affected_users"])


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted"])
def test_classifiers_learn(spark, kind):
    rows = jobs.split_tickets(toy_tickets(spark))
    part = {s: rows.where(F.col("split") == s) for s in splits.SPLITS}
    blocks = BLOCKS if kind == "logistic" else models.FeatureBlocks(["subject"], [], [])
    model = models.train_classifier(part["train"], "category", blocks, kind, part["val"], trees=5, rounds=3, max_depth=3)
    assert models.weighted_f1(model, part["test"], "category").first()["f1_weighted"] > 0.9
    scored = models.predictions(model.score(part["test"]), model.name).collect()
    assert all(1 / 3 <= r["confidence"] <= 1 + 1e-9 and r["sentiment"] == "frustrated" and r["top_features"] == [] for r in scored)


def test_networks_learn(spark):
    rows = jobs.split_tickets(toy_tickets(spark))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    text = models.train_text_network(train, "category", ["subject", "description"], svd_dim=4, hidden=64, max_iter=30)
    assert models.weighted_f1(text, test, "category").first()["f1_weighted"] > 0.9
    full = models.train_full_network(train, "category", BLOCKS, svd_dim=5, hidden=64, max_iter=30)
    assert models.weighted_f1(full, test, "category").first()["f1_weighted"] > 0.9


def test_probes(spark):
    rows = jobs.split_tickets(toy_tickets(spark))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    top = {(r["class"], r["term"]) for r in models.token_probe(train, "category", ["subject", "description"]).collect()}
    assert {("network", "network"), ("billing", "billing"), ("login", "login")} <= top
    parts = {r["variant"]: r["f1_weighted"] for r in models.ablation(train, test, "category", BLOCKS).collect()}
    assert parts["text_only"] > parts["without_text"]
    assert models.shuffle_sanity(train, test, "category", "ticket_id", BLOCKS).first()["f1_weighted"] < 0.7


def test_training_run_solve_and_answer(spark, tmp_path):
    log = str(tmp_path / "runs")
    model = jobs.training_run(spark, toy_tickets(spark), "category", log, BLOCKS, max_iter=20)
    runs, _ = tables.read_run_log(spark, log)
    record = registry.run_summary(runs).first()
    assert record["status"] == "finished" and float(record["test_f1_weighted"]) > 0.9
    with pytest.raises(Exception):
        jobs.training_run(spark, toy_tickets(spark), "category", log, BLOCKS, kind="unknown")
    assert tables.read_run_log(spark, log)[0].where("status = 'failed'").count() == 1

    from ticketlake.operators import retrieval

    index, vectoriser = retrieval.build_index(retrieval.kb_documents(toy_tickets(spark)))
    retrieval.write_index(index, str(tmp_path / "kb"))
    index = spark.read.parquet(str(tmp_path / "kb"))
    asked = toy_tickets(spark, 12)
    solved = jobs.solve(model, index, vectoriser, asked, k=4).collect()
    assert len(solved) == 12 and all(len(r["results"]) == 4 and r["results"][0]["category"] == r["category"] for r in solved)
    assert all(r["summary"].startswith("Closest historical case: t") for r in solved)
    hits = jobs.retrieve(index, vectoriser, asked.withColumn("predicted", F.col("category")), 2)
    answers = jobs.synthesize(asked, hits).collect()
    assert len(answers) == 12 and all(r["answer"] for r in answers)


def test_feature_tables(spark, tmp_path):
    fitted = jobs.build_features(toy_tickets(spark), str(tmp_path / "f"), BLOCKS)
    written = spark.read.parquet(str(tmp_path / "f" / "features"))
    assert written.count() == 240 and written.first()["features"].size == fitted.width
    meta = {r["split"]: r for r in spark.read.json(str(tmp_path / "f" / "metadata")).collect()}
    assert sum(r["n_rows"] for r in meta.values()) == 240 and meta["train"]["n_category"] == 3
