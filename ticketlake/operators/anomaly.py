"""Gap-filled daily series and rolling z-score detectors.

Every series is one window partition, which is safe because the input is already reduced to one row per
key and day: the longest partition is as long as the calendar, whatever the number of tickets.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F

# Scan defaults, and the z-score limit of the failure-rate detector.
DEFAULT_WINDOW = 14
DEFAULT_Z = 3.0
DEFAULT_FAILURE_RATE = 0.10
FAILURE_SOFT_Z = 3.0

_NO_KEY = "_series"


def densify(df: DataFrame, key: str | None, day: str, value: str) -> DataFrame:
    """Insert the missing days between each key's first and last day with value 0.

    Each row looks at the key's next day and emits the gap before it, so no calendar join is needed, a
    null key is an ordinary series, and the exchange by key is the one the rolling window uses again.
    """
    keys = [F.col(key)] if key else [F.lit(0).alias(_NO_KEY)]
    series = df.where(F.col(day).isNotNull()).select(
        *keys, F.col(day).cast("date").alias("_day"), F.col(value).cast("double").alias("_value")
    )
    next_day = F.lead("_day").over(Window.partitionBy(key or _NO_KEY).orderBy("_day"))
    last = F.coalesce(F.date_sub("_next", 1), F.col("_day"))
    days = F.when(
        F.col("_next") == F.col("_day"), F.raise_error(F.lit("duplicate day in series")).cast("array<date>")
    ).otherwise(F.sequence(F.col("_day"), last, F.expr("interval 1 day")))
    return (
        series.withColumn("_next", next_day)
        .select(key or _NO_KEY, "_value", F.col("_day").alias("_first"), F.explode(days).alias("date"))
        .select(
            key or _NO_KEY, "date",
            F.when(F.col("date") == F.col("_first"), F.col("_value")).otherwise(0.0).alias("value"),
        )
    )


def _rolling(key: str, window: int) -> tuple[Column, Column, Column]:
    frame = Window.partitionBy(key).orderBy("date").rowsBetween(1 - window, Window.currentRow)
    enough = F.count("value").over(frame) >= max(3, window // 2)
    mean = F.when(enough, F.avg("value").over(frame))
    std = F.when(enough, F.nullif(F.stddev_pop("value").over(frame), F.lit(0.0)))
    return mean, std, (F.col("value") - mean) / std


def rolling_zscore(series: DataFrame, key: str, window: int = DEFAULT_WINDOW, z_threshold: float = DEFAULT_Z) -> DataFrame:
    """Mean and population deviation of the last ``window`` rows including the current one, and the z-score."""
    if z_threshold >= math.sqrt(max(window - 1, 0)):
        warnings.warn(f"a window of {window} rows can never exceed z={z_threshold}", stacklevel=2)
    mean, std, z = _rolling(key, window)
    return series.select(
        key, "date", "value",
        mean.alias("rolling_mean"), std.alias("rolling_std"), z.alias("zscore"),
        F.coalesce(z > z_threshold, F.lit(False)).alias("is_anomaly"),
    )


def spikes(
    daily: DataFrame, key: str | None = None, day: str = "created_date", value: str = "count",
    window: int = DEFAULT_WINDOW, z_threshold: float = DEFAULT_Z,
) -> DataFrame:
    """Densify and score one series (no key) or one independent series per key."""
    scored = rolling_zscore(densify(daily, key, day, value), key or _NO_KEY, window, z_threshold)
    return scored if key else scored.drop(_NO_KEY)


def volume_spikes(daily_total: DataFrame, **options) -> DataFrame:
    return spikes(daily_total, None, **options)


def category_spikes(daily_by_category: DataFrame, **options) -> DataFrame:
    return spikes(daily_by_category, "category", **options)


def sentiment_shift(daily_sentiment: DataFrame, **options) -> DataFrame:
    return spikes(daily_sentiment, "sentiment_norm", **options)


def retrieval_failure(
    retrieval_daily: DataFrame, window: int = DEFAULT_WINDOW, threshold: float = DEFAULT_FAILURE_RATE
) -> DataFrame:
    """Days whose failure rate reaches the threshold, or spikes against its rolling mean."""
    mean, _, z = _rolling(_NO_KEY, window)
    hard = F.coalesce(F.col("value") >= threshold, F.lit(False))
    soft = F.coalesce(z > FAILURE_SOFT_Z, F.lit(False))
    return densify(retrieval_daily, None, "created_date", "failure_rate").select(
        "date", F.col("value").alias("failure_rate"), mean.alias("rolling_mean"), z.alias("zscore"),
        hard.alias("hard_flag"), soft.alias("soft_flag"), (hard | soft).alias("is_anomaly"),
    )


def anomaly_scan(
    tables: dict[str, DataFrame], window: int = DEFAULT_WINDOW, z_threshold: float = DEFAULT_Z,
    failure_threshold: float = DEFAULT_FAILURE_RATE,
) -> DataFrame:
    """All four detectors as one long table (scan, key, date, value, mean, std, z, flag), every day included."""
    options = {"window": window, "z_threshold": z_threshold}

    def long(scan: str, df: DataFrame, key: Column, value: str = "value") -> DataFrame:
        std = F.col("rolling_std") if "rolling_std" in df.columns else F.lit(None).cast("double")
        return df.select(
            F.lit(scan).alias("scan"), key.cast("string").alias("key"), "date", F.col(value).alias("value"),
            "rolling_mean", std.alias("rolling_std"), "zscore", "is_anomaly",
        )

    failure = retrieval_failure(tables["retrieval_daily"], window, failure_threshold)
    return (
        long("volume_spikes", volume_spikes(tables["daily_total"], **options), F.lit(None))
        .unionByName(long("category_spikes", category_spikes(tables["daily_by_category"], **options), F.col("category")))
        .unionByName(long("sentiment_shift", sentiment_shift(tables["daily_sentiment"], **options), F.col("sentiment_norm")))
        .unionByName(long("retrieval_failure", failure, F.lit(None), "failure_rate"))
    )
