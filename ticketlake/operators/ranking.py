"""Exact ranks and order statistics without a global sort and without one task per hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketlake.functions.coerce import seeded_hash
from ticketlake.session import materialize

_HASH_PREFIX = 4  # hex digits: 65,536 evenly filled buckets, so the offset table has a fixed size


def hash_rank(df: DataFrame, key_cols: list[str], seed: int | str, rank_col: str = "rank") -> DataFrame:
    """1-based rank of each row in seeded-hash order.

    Rows are bucketed by the leading digits of the digest, which spreads any set of distinct keys evenly.
    A row's rank is the size of all earlier buckets (a broadcast table of at most 65,536 rows) plus its
    position in its own bucket. Keys must be distinct.
    """
    hashed = df.withColumn("_digest", seeded_hash(seed, *key_cols)).withColumn(
        "_bucket", F.substring("_digest", 1, _HASH_PREFIX)
    )
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_bucket", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    position = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", *key_cols))
    return (
        hashed.join(F.broadcast(offsets), "_bucket")
        .withColumn(rank_col, F.col("_offset") + position)
        .drop("_bucket", "_digest", "_offset")
    )


def prefix_counts(keyed: DataFrame, done: int, width: int | None) -> DataFrame:
    """Rows per (_group, _prefix, _bucket): key prefixes of ``done`` and of ``width`` characters."""
    bucket: Column = F.col("_key") if width is None else F.substring("_key", 1, width)
    scoped = keyed.select("_group", F.substring("_key", 1, done).alias("_prefix"), bucket.alias("_bucket"))
    return scoped.groupBy("_group", "_prefix", "_bucket").agg(F.count(F.lit(1)).alias("_c"))


def nth_keys(keyed: DataFrame, first: DataFrame, targets: DataFrame, widths: list[int | None]) -> DataFrame:
    """The n-th smallest ``_key`` string of a ``_group``, for each row (_group, _which, _n) of ``targets``.

    Works down the key like a radix selection: count the keys of a group by their prefix, keep the prefix
    in which the n-th key falls, then look only at the keys under it with the next longer prefix. Each
    step shuffles partial counts, so a group that holds most rows is still counted by all tasks; the
    last step (width None) compares whole keys inside the last prefix. The prefixes kept after a step are
    written out: two rows per group, so the next step finds its rows by a lookup of known size. ``first`` is
    ``prefix_counts(keyed, 0, widths[0])``, which callers also use for group sizes.
    """
    found = materialize(targets.select("_group", "_which", "_n", F.lit("").alias("_prefix")), "key-targets")
    counts, done = first, 0
    for width in widths:
        if done:
            wanted = found.select("_group", "_prefix").distinct()
            inside = keyed.withColumn("_prefix", F.substring("_key", 1, done)).join(
                wanted, ["_group", "_prefix"], "left_semi"
            )
            counts = prefix_counts(inside, done, width)
        upto = F.sum("_c").over(
            Window.partitionBy("_group", "_prefix").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        )
        found = materialize(
            found.join(counts.withColumn("_upto", upto), ["_group", "_prefix"])
            .where((F.col("_upto") >= F.col("_n")) & (F.col("_upto") - F.col("_c") < F.col("_n")))
            .select("_group", "_which", (F.col("_n") - F.col("_upto") + F.col("_c")).alias("_n"),
                    F.col("_bucket").alias("_prefix")),
            "key-prefixes",
        )
        done = width or done
    return found.select("_group", "_which", F.col("_prefix").alias("_key"))
