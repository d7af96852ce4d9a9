"""End-to-end jobs: daily scan, training run, knowledge-base build, ticket answering."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ticketlake.functions.text import context_block, fingerprint, query_text, solve_summary
from ticketlake.operators import anomaly, features, metrics, models, registry, retrieval, splits
from ticketlake.operators.features import TfidfModel
from ticketlake.operators.summary import extractive_summary, summary_source
from ticketlake.schema import TEXT_COLUMNS
from ticketlake.session import materialize
from ticketlake.sources.tables import append_run, ensure_tables, json_ready, write_json_report

METRIC_TABLES = ["daily_total", "daily_by_category", "daily_sentiment", "retrieval_daily"]


def daily_metrics(tickets: DataFrame) -> dict[str, DataFrame]:
    """The four daily tables from one scan of the tickets: their common base is written once."""
    return metrics.daily_tables(materialize(metrics.daily_base(tickets), "daily-base"))


def daily_scan(spark: SparkSession, tickets: DataFrame, root: str, report: str | None = None, document: str | None = None, **options) -> DataFrame:
    """Build the four metric tables when missing, then run all detectors; write their rows as ``report`` and the nested
    report with its settings as ``document``."""
    tables = ensure_tables(spark, root, lambda: daily_metrics(tickets), METRIC_TABLES)
    scan = anomaly.anomaly_scan(tables, **options)
    if report:
        write_json_report(scan, report)
    if document:
        write_json_report(scan_report(scan, **options), document)
    return scan


REPORT_SCHEMA = (
    "section string, key string, params struct<window:int,z_threshold:double,failure_threshold:double>, "
    "points array<struct<date:string,value:double,rolling_mean:double,rolling_std:double,zscore:double,is_anomaly:boolean>>"
)


def scan_report(
    scan: DataFrame, window: int = anomaly.DEFAULT_WINDOW, z_threshold: float = anomaly.DEFAULT_Z,
    failure_threshold: float = anomaly.DEFAULT_FAILURE_RATE,
) -> DataFrame:
    """The report's documents: one with the settings, and one for each section and series with its days in order.

    A document holds a row for each day of one series, never tickets.
    """
    point = F.struct("date", "value", "rolling_mean", "rolling_std", "zscore", "is_anomaly")
    series = json_ready(scan).groupBy(F.col("scan").alias("section"), "key").agg(F.array_sort(F.collect_list(point)).alias("points"))
    settings = [("params", None, (window, float(z_threshold), float(failure_threshold)), None)]
    return scan.sparkSession.createDataFrame(settings, REPORT_SCHEMA).unionByName(series, allowMissingColumns=True)


def read_scan_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).json(path)


def split_tickets(tickets: DataFrame, seed: int = splits.SPLIT_SEED) -> DataFrame:
    """Tickets with fingerprint and leakage-free split."""
    hashed = tickets.withColumn("text_hash", fingerprint(*[F.col(c) for c in TEXT_COLUMNS]))
    return splits.grouped_split(hashed, "text_hash", seed=seed)


def build_features(
    tickets: DataFrame, root: str, blocks: models.FeatureBlocks, category: str = "category", subcategory: str = "subcategory",
) -> models.FeatureModel:
    """Fit features and label codes on the training split and write features, classes and metadata tables.

    A label of another split that training never saw is an error.
    """
    rows = materialize(split_tickets(tickets), "split-tickets")
    train = rows.where(F.col("split") == "train")
    fitted = models.fit_features(train, blocks)
    coded, sizes = rows, {}
    for target in (category, subcategory):
        classes = features.label_classes(train, target)
        classes.write.mode("overwrite").parquet(f"{root}/classes_{target}")
        coded = features.encode_labels(coded, classes, target, f"y_{target}")
        sizes[target] = classes.count()
    out = fitted.transform(coded).select("ticket_id", "split", "features", f"y_{category}", f"y_{subcategory}")
    out.write.mode("overwrite").partitionBy("split").parquet(f"{root}/features")
    width = F.lit(fitted.width).cast("bigint").alias("n_features")
    features.feature_metadata(rows, "split", category, subcategory).withColumn("n_features", width).write.mode(
        "overwrite"
    ).json(f"{root}/metadata")
    return fitted


def training_run(spark: SparkSession, tickets: DataFrame, label: str, run_log: str, blocks: models.FeatureBlocks, kind: str = "logistic", artifacts: str | None = None, **options):
    """Split, train, evaluate on validation and test, and append one run record; a failure is recorded too.

    With ``artifacts`` the model and both reports are written there, the scores are read back from the reports, and the
    record names the files.
    """
    run_id, when = uuid.uuid4().hex, time.strftime("%Y-%m-%dT%H:%M:%S")
    component = f"train_{kind}"
    rows = split_tickets(tickets)
    part = {s: rows.where(F.col("split") == s) for s in splits.SPLITS}
    try:
        model = models.train_classifier(part["train"], label, blocks, kind, part["val"], **options)
        scores, files = {}, {}
        if artifacts:
            files["model"] = f"{artifacts}/{run_id}/model"
            model.save(spark, files["model"])
        for s in ("val", "test"):
            measured = models.weighted_f1(model, part[s], label)
            if artifacts:
                files[f"{s}_metrics"] = f"{artifacts}/{run_id}/{s}_metrics"
                write_json_report(measured, files[f"{s}_metrics"])
                measured = spark.read.schema(measured.schema).json(files[f"{s}_metrics"])
            scores[f"{s}_f1_weighted"] = measured.first()["f1_weighted"]
    except Exception:
        append_run(registry.run_record(spark, run_id, when, component, "failed", options), run_log)
        raise
    append_run(registry.run_record(spark, run_id, when, component, "finished", options, scores, files), run_log)
    return model


def retrieve(index: DataFrame, vectoriser: TfidfModel, classified: DataFrame, k: int = retrieval.DEFAULT_K) -> DataFrame:
    """Hits with metadata for classified tickets (ticket columns plus ``predicted``)."""
    queries = vectoriser.transform(classified, query_text("predicted")).select(
        F.col("ticket_id").alias("query_id"), F.coalesce("predicted", F.lit("")).alias("category"), "idx", "val"
    )
    return retrieval.hit_records(retrieval.retrieve_topk(index, queries, k), index)


def collect_hits(hits: DataFrame) -> DataFrame:
    """One row per query with its at most k hits in rank order."""
    record = F.struct(
        "rank", "doc_id", "product", "category", "subcategory", "resolution_code", "quality", "score", "preview"
    )
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(record)).alias("results"))


def context_of(hits: DataFrame) -> DataFrame:
    """One row per query: its hits as text blocks in rank order, separated by blank lines."""
    block = F.struct("rank", context_block().alias("block"))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return listed.select("query_id", F.array_join(F.col("blocks.block"), "\n\n").alias("context"))


def retrieve_with_prediction(
    classifier, index: DataFrame, vectoriser: TfidfModel, tickets: DataFrame, k: int = retrieval.DEFAULT_K
) -> DataFrame:
    """(ticket_id, predicted_category, predicted_confidence, results): the answer record of a search for each ticket."""
    scored = classifier.score(tickets)
    hits = collect_hits(retrieve(index, vectoriser, scored, k))
    answers = scored.select("ticket_id", F.col("predicted").alias("predicted_category"), F.col("confidence").alias("predicted_confidence"))
    return answers.join(hits, F.col("ticket_id") == F.col("query_id"), "left").drop("query_id")


def solve(classifier, index: DataFrame, vectoriser: TfidfModel, tickets: DataFrame, k: int = retrieval.DEFAULT_K) -> DataFrame:
    """Classify once, retrieve similar solved tickets and phrase the answer, for a whole table of tickets."""
    scored = classifier.score(tickets)
    answers = models.predictions(scored, classifier.name)
    hits = collect_hits(retrieve(index, vectoriser, scored, k))
    joined = answers.join(hits, F.col("ticket_id") == F.col("query_id"), "left").drop("query_id")
    best: Column = F.get("results", F.lit(0))
    return joined.withColumn("summary", solve_summary(best))


def synthesize(tickets: DataFrame, hits: DataFrame) -> DataFrame:
    """Extractive answer per ticket: the best sentences of its own text and of its retrieved context."""
    joined = tickets.join(context_of(hits), F.col("ticket_id") == F.col("query_id"), "left")
    source = joined.select("ticket_id", summary_source("subject", "description", "context").alias("_source"))
    return extractive_summary(source, "ticket_id", "_source").withColumnRenamed("summary", "answer")
