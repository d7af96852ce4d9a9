"""Corpus pipeline: low quality goes, one document of each near-duplicate group stays, documents that hold benchmark items go,
secrets are masked, and the rest is packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketlake.llm import decontamination, minhash, packing, quality, secret_scan
from ticketlake.llm.common import table
from ticketlake.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.7."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group; rows without id stay, of rows that repeat an id one does."""
    out = minhash.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_copy")).distinct()
    gone = materialize(out, "pipeline-copies")
    rest = docs.join(gone, docs["doc_id"] == gone["_copy"], "left_anti")
    # Rows that repeat an id are one document: the row of smallest text stays. They are few, so only they are ranked.
    again = materialize(rest.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).count().filter("count > 1").drop("count"), "pipeline-repeats")
    if again.isEmpty():
        return rest
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeated = rest.join(again, rest["doc_id"] == again["_again"], "left_semi")
    order = ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    one = repeated.groupBy("doc_id").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in order))).alias("_row"))
    one = one.select(*(F.col("doc_id") if c == "doc_id" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
    return rest.join(again, rest["doc_id"] == again["_again"], "left_anti").select(*columns).unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars brought up to date."""
    return secret_scan.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage), ("dedup", dedup_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage),
    ("packing", packing_stage),
]

# The classifier and the network cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each one's result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
