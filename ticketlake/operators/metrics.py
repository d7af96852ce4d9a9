"""Daily metrics, category counts and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ticketlake.functions.coerce import wall_clock_day
from ticketlake.functions.tags import retrieval_success, sentiment_class
from ticketlake.functions.text import category_label
from ticketlake.session import materialize


def daily_base(
    tickets: DataFrame,
    created: str | None = None,
    category: str = "category",
    sentiment: str = "customer_sentiment",
    helpful: str = "kb_articles_helpful",
    accepted: str = "auto_suggestion_accepted",
) -> DataFrame:
    """Counts at (day, category, sentiment) grain: the one scan that all four daily tables roll up.

    Partial aggregation reduces every input partition to its distinct keys before the exchange, so a
    category or day that holds most rows costs no more to shuffle than any other.

    The day is that of the creation time as written: ``created_wall`` of ingested tickets, else ``created_at``.
    """
    if created is None:
        created = "created_wall" if "created_wall" in tickets.columns else "created_at"
    return (
        tickets.select(
            wall_clock_day(created).alias("created_date"),
            F.col(category).alias("category"),
            sentiment_class(sentiment).alias("sentiment_norm"),
            retrieval_success(helpful, accepted).alias("success"),
        )
        .groupBy("created_date", "category", "sentiment_norm")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("success").alias("success"))
    )


def daily_total(base: DataFrame) -> DataFrame:
    return base.groupBy("created_date").agg(F.sum("count").alias("count"))


def daily_by_category(base: DataFrame) -> DataFrame:
    return base.groupBy("created_date", "category").agg(F.sum("count").alias("count"))


def daily_sentiment(base: DataFrame) -> DataFrame:
    return base.groupBy("created_date", "sentiment_norm").agg(F.sum("count").alias("count"))


def retrieval_daily(base: DataFrame) -> DataFrame:
    totals = base.groupBy("created_date").agg(F.sum("count").alias("total"), F.sum("success").alias("success"))
    failure = F.col("total") - F.col("success")
    return totals.select(
        "created_date", "total", "success", failure.alias("failure"),
        (failure / F.col("total")).alias("failure_rate"),
    )


def daily_tables(base: DataFrame) -> dict[str, DataFrame]:
    return {
        "daily_total": daily_total(base),
        "daily_by_category": daily_by_category(base),
        "daily_sentiment": daily_sentiment(base),
        "retrieval_daily": retrieval_daily(base),
    }


def category_counts(df: DataFrame, split: str = "split", category: str = "category", top: int | None = None) -> DataFrame:
    """Counts per split and category, per category over all splits, and totals per split.

    Rows are first reduced to (split, category); the grouping sets expand only that small table.
    ``scope`` tells the three levels apart. ``top`` keeps the most frequent categories of each list.
    """
    counted = df.groupBy(F.col(split).alias("split"), category_label(category).alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )
    levels = counted.groupingSets(
        [["split", "category"], ["category"], ["split"]], "split", "category"
    ).agg(
        F.sum("n").alias("n"),
        F.when(F.grouping("category") == 1, "split_total")
        .when(F.grouping("split") == 1, "all_splits")
        .otherwise("split").alias("scope"),
    ).select("scope", "split", "category", "n")
    if top is None:
        return levels
    order = Window.partitionBy("scope", "split").orderBy(F.col("n").desc(), "category")
    return levels.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("rank")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): inverse frequency divided by the mean inverse frequency of the present classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    inverse = 1.0 / F.col("n")
    return counts.select(label, "n", (inverse / F.avg(inverse).over(Window.partitionBy())).alias("weight"))


def with_class_weight(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(F.col(label).alias("_label"), F.col("weight").alias(weight_col))
    weights = materialize(weights, "class-weights")
    return df.join(weights, F.equal_null(F.col(label), F.col("_label"))).drop("_label")


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
