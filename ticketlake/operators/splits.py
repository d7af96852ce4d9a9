"""Train/validation/test splits, training caps, label permutation and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ticketlake.functions.coerce import seeded_hash, unit_interval
from ticketlake.operators.ranking import hash_rank, nth_keys, prefix_counts
from ticketlake.session import materialize

# Split ratios, seeds and names.
RATIOS = (0.70, 0.15, 0.15)
SPLIT_SEED = 42
SECOND_STAGE_SEED = 43
SPLITS = ("train", "val", "test")

# Prefixes of the temporal sort key: day, second, microsecond plus four hash digits, whole key.
_KEY_PREFIXES = [10, 19, 30, None]
# Prefixes of a hex digest: 65,536 even buckets, then 65,536 inside one of them, whole key.
_DIGEST_PREFIXES = [4, 8, None]


def grouped_split(df: DataFrame, group: str, ratios=RATIOS, seed: int = SPLIT_SEED) -> DataFrame:
    """Assign whole groups of equal fingerprints to one split.

    Map-only: the split follows from the seeded hash of the fingerprint, so copies can never be
    separated, no row moves, and a rerun after any failure gives the same answer. The ratios hold in
    expectation over groups; ``grouped_split_exact`` gives exact group counts.
    """
    u = unit_interval(seeded_hash(seed, group))
    return df.withColumn(
        "split",
        F.when(u < F.lit(ratios[0]), "train").when(u < F.lit(ratios[0] + ratios[1]), "val").otherwise("test"),
    )


def grouped_split_exact(df: DataFrame, group: str, ratios=RATIOS, seed: int = SPLIT_SEED) -> DataFrame:
    """As ``grouped_split`` with exact group counts: two seeded draws without replacement.

    Only distinct fingerprints are ranked; the assignment is joined back to the rows.
    """
    first = materialize(hash_rank(df.select(group).distinct(), [group], seed), "ranked-groups")
    n = first.count()
    n_train = int(n * ratios[0])
    rest = ratios[1] + ratios[2]
    n_val = int((n - n_train) * (ratios[1] / rest if rest > 0 else 0.5))
    held_out = hash_rank(first.where(F.col("rank") > n_train).select(group), [group], seed + 1)
    assigned = first.where(F.col("rank") <= n_train).select(group, F.lit("train").alias("split")).unionByName(
        held_out.select(group, F.when(F.col("rank") <= n_val, "val").otherwise("test").alias("split"))
    )
    return df.join(assigned, group)


def stratified_temporal_split(
    df: DataFrame, strata=("category", "subcategory"), created: str = "created_at", id_col: str = "ticket_id",
    ratios=RATIOS,
) -> DataFrame:
    """Per stratum: the oldest 70 % to train, the next 15 % to validation, the rest to test.

    Rows without a time are the oldest; equal times are ordered by the hash of the id, then the id. The
    two cut keys of each stratum are found by counting, so no stratum is ever sorted or held by one
    task, and rows are then compared with the cut keys of their stratum.
    """
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("split ratios must sum to 1")
    time = F.date_format(F.col(created).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    keyed = df.withColumns({
        "_group": F.to_json(F.struct(*[F.col(c) for c in strata]), {"ignoreNullFields": "false"}),
        "_key": F.concat(
            F.coalesce(time, F.lit(" " * 26)), F.substring(F.md5(F.col(id_col).cast("string")), 1, 8),
            F.col(id_col).cast("string"),
        ),
    })
    first = prefix_counts(keyed, 0, _KEY_PREFIXES[0])
    sizes = first.groupBy("_group").agg(F.sum("_c").alias("_size"))
    n_train = F.floor(F.col("_size") * F.lit(float(ratios[0])))
    n_val = F.floor(F.col("_size") * F.lit(float(ratios[1])))
    targets = sizes.select(
        "_group",
        F.inline(F.array(
            F.struct(F.lit("train").alias("_which"), n_train.alias("_n")),
            F.struct(F.lit("val").alias("_which"), (n_train + n_val).alias("_n")),
        )),
    ).where("_n > 0")
    cuts = nth_keys(keyed.select("_group", "_key"), first, targets, _KEY_PREFIXES)
    per_group = materialize(
        cuts.groupBy("_group").agg(
            F.max(F.when(F.col("_which") == "train", F.col("_key"))).alias("_train_cut"),
            F.max(F.when(F.col("_which") == "val", F.col("_key"))).alias("_val_cut"),
        ),
        "split-cuts",
    )
    return (
        keyed.join(per_group, "_group", "left")
        .withColumn(
            "split",
            F.when(F.col("_key") <= F.col("_train_cut"), "train")
            .when(F.col("_key") <= F.col("_val_cut"), "val")
            .otherwise("test"),
        )
        .drop("_group", "_key", "_train_cut", "_val_cut")
    )


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = SPLIT_SEED) -> DataFrame:
    """Exactly the n rows that come first in seeded hash order.

    The n-th smallest key is found by counting prefixes, then a plain filter keeps the rows up to it: no
    row is shuffled, whatever n and the table size.
    """
    keyed = df.withColumn("_key", F.concat_ws("|", seeded_hash(seed, id_col), F.col(id_col).cast("string")))
    keys = keyed.select(F.lit("").alias("_group"), "_key")
    first = prefix_counts(keys, 0, _DIGEST_PREFIXES[0])
    total = first.agg(F.sum("_c")).first()[0] or 0
    if n >= total:
        return df
    if n < 1:
        return df.limit(0)
    target = df.sparkSession.createDataFrame([("", "n", n)], "_group string, _which string, _n bigint")
    cut = nth_keys(keys, first, target, _DIGEST_PREFIXES).first()["_key"]
    return keyed.where(F.col("_key") <= cut).drop("_key")


def head_rows(df: DataFrame, n: int, id_col: str) -> DataFrame:
    """The first n rows in id order."""
    return df.orderBy(id_col).limit(n)


def shuffle_labels(df: DataFrame, id_col: str, label: str, seed: int = SPLIT_SEED, out: str = "shuffled") -> DataFrame:
    """Permute the labels over the rows: the row at rank r of one hash order takes the label at rank r of another."""
    takers = hash_rank(df, [id_col], f"{seed}-to", "_rank")
    givers = hash_rank(df.select(id_col, label), [id_col], f"{seed}-from", "_rank")
    return takers.join(givers.select("_rank", F.col(label).alias(out)), "_rank").drop("_rank")


def leakage_overlap(df: DataFrame, fingerprint: str = "text_hash", split: str = "split") -> DataFrame:
    """Distinct fingerprints per split and shared by each pair of splits, in one pass and without joins."""
    per_hash = df.groupBy(fingerprint).agg(*[
        F.coalesce(F.bool_or(F.col(split) == s), F.lit(False)).alias(s) for s in SPLITS
    ])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    return per_hash.agg(
        *[F.count_if(F.col(s)).alias(f"n_{s}") for s in SPLITS],
        *[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in pairs],
    )
