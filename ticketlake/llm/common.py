"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ticketlake.session import materialize

# Bytes of text that one numpy step holds; its temporaries take some twenty times as much.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with fixed names and types, whatever other columns the table has; a null text is empty."""
    return df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    )


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, id_col: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest hashes of their ids. Rows that cannot be among them are left out before they
    are ordered, so the driver gets little more than ``limit`` rows, however many partitions there are."""
    spot = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    total = df.count()
    if total > limit:
        df = df.filter(spot <= int((limit + 8 * limit**0.5 + 64) / total * (1 << 30)))
    return df.orderBy(spot, id_col).limit(limit)


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``limit``; a larger row is a range of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(batch: pa.RecordBatch, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about ``limit`` bytes of text."""
    for a, b in slices(np.diff(text_buffer(batch.column("text"))[1]), limit):
        yield batch.slice(a, b - a)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a non-null string column, and where each row starts (one more entry than rows)."""
    wide = column.cast(pa.large_string())
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def batches(schema: pa.Schema, rows: Iterable[tuple], size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def spanning(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """At most one link less than nodes that connects what the links connect."""
    parent: dict[int, int] = {}

    def top(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    kept = []
    for p, q in zip(i.tolist(), j.tolist()):
        a, b = top(p), top(q)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((p, q))
    return np.array(kept, np.int64).reshape(-1, 2).T


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the links (a, b): one row (id, component) for each linked id, component its smallest id.

    Alternates the large-star and small-star steps, which end after a number of rounds that grows with the logarithm
    of the longest path. Each round is grouped by node with partial minima, so a node that holds a third of all links
    is pre-aggregated, and is written to the shared folder; the driver sees one row of counts.
    """
    spark = edges.sparkSession
    links = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name
    )
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # After the large step every link points from a node to a smaller one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        links = materialize(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .filter("u <> v").distinct(),
            name,
        )
    # The links are stars now; the centre is linked with itself.
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
