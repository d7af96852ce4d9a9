"""Run summaries and the model registry as aggregations over their event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.session import materialize

# The metrics and parameters a run summary shows, and the stage names.
SUMMARY_METRICS = ["val_f1_weighted", "test_f1_weighted"]
SUMMARY_PARAMS = [
    "limit_train", "n_estimators", "max_depth", "learning_rate", "epochs", "batch_size", "svd_dim", "hidden",
    "dropout",
]
PRODUCTION = "Production"
ARCHIVED = "Archived"


def run_summary(runs: DataFrame) -> DataFrame:
    """One row per run, newest first; ``metrics`` and ``params`` are maps of strings."""
    run_id = F.coalesce("run_id", "id") if "id" in runs.columns else F.col("run_id")
    return runs.select(
        run_id.alias("run_id"), "when", "component", "status",
        *[F.col("metrics").getItem(m).alias(m) for m in SUMMARY_METRICS],
        *[F.col("params").getItem(p).alias(p) for p in SUMMARY_PARAMS],
    ).orderBy(F.col("when").desc(), "run_id")


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    summary = run_summary(runs).select("when", "component", *SUMMARY_METRICS, "run_id")
    return summary.orderBy(F.col("when").desc(), "run_id").limit(n)


def registry_state(events: DataFrame, archive_on_any_promotion: bool = False) -> DataFrame:
    """Current stage of every registered entry.

    ``events`` has (seq, action, name, version, stage, created_at) with action ``register`` or
    ``promote``. An entry takes the stage of the last promotion of its version after it was registered,
    else the stage it was registered with. An entry left in Production is archived by a later promotion
    of the same model - which can only be of another version - to Production, or to any stage when
    ``archive_on_any_promotion`` is set. So the state needs only the last promotion per version and per
    model, both partial aggregates; no per-model history is replayed. The per-model table is written first,
    so that it is a lookup of known size and the entries of a busy model are not gathered by name.
    """
    promotions = events.where("action = 'promote'")
    entries = events.where("action = 'register'").select(
        "name", "version", "created_at", F.col("seq").alias("_registered"), F.col("stage").alias("_initial")
    )
    own = promotions.groupBy("name", "version").agg(
        F.max("seq").alias("_promoted"), F.max_by("stage", "seq").alias("_stage")
    )
    archiving: Column = F.lit(True) if archive_on_any_promotion else F.col("stage") == PRODUCTION
    last_archiving = materialize(
        promotions.where(archiving).groupBy("name").agg(F.max("seq").alias("_archiving")), "last-archiving"
    )
    promoted_later = F.coalesce(F.col("_promoted") > F.col("_registered"), F.lit(False))
    since = F.when(promoted_later, F.col("_promoted")).otherwise(F.col("_registered"))
    stage = F.when(promoted_later, F.col("_stage")).otherwise(F.col("_initial"))
    archived = (stage == PRODUCTION) & F.coalesce(F.col("_archiving") > since, F.lit(False))
    return (
        entries.join(own, ["name", "version"], "left")
        .join(last_archiving, "name", "left")
        .select("name", "version", "created_at", F.when(archived, ARCHIVED).otherwise(stage).alias("stage"))
    )


def latest_production(state: DataFrame) -> DataFrame:
    """The newest Production entry of each model."""
    return (
        state.where(F.col("stage") == PRODUCTION)
        .groupBy("name")
        .agg(F.max(F.struct("created_at", "version")).alias("e"))
        .select("name", F.col("e.version").alias("version"), F.col("e.created_at").alias("created_at"))
    )


def registry_pointer(events: DataFrame) -> DataFrame:
    """The version last registered or promoted for each model that was registered at all."""
    return (
        events.groupBy("name")
        .agg(F.max_by("version", "seq").alias("version"), F.bool_or(F.col("action") == "register").alias("_known"))
        .where("_known")
        .select("name", "version")
    )


def run_record(spark, run_id: str, when: str, component: str, status: str, params=None, metrics=None, artifacts=None) -> DataFrame:
    """One finished or failed run as a one-row frame with string maps."""
    def as_text(d):
        return {str(k): None if v is None else str(v) for k, v in (d or {}).items()}

    return spark.createDataFrame(
        [(run_id, when, component, status, as_text(params), as_text(metrics), as_text(artifacts))],
        "run_id string, when string, component string, status string, params map<string,string>, "
        "metrics map<string,string>, artifacts map<string,string>",
    )
