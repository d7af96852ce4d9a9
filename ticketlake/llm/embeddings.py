"""Near-duplicate vectors: exact cosine links by PCA-ordered tiled comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketlake.llm.common import bounded_sample, components, spanning
from ticketlake.session import materialize

# Vectors that the principal axes are fitted on. They only order the work: any axes give the same links.
SAMPLE = 4096
#: Mean number of vectors in a tile, and rows of a tile that are compared at a time.
TILE, STRIP = 2048, 64
STEPS = (8, 16, 32)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; scaled by their largest part first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def principal_axes(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """For each vector length in the sample, an orthogonal matrix whose columns fall in explained variance."""
    axes = {}
    for d in {len(v) for v in sample}:
        x = unit(np.array([v for v in sample if len(v) == d], np.float64))
        axes[d] = np.linalg.eigh(np.cov(x, rowvar=False).reshape(d, d))[1][:, ::-1].copy() if len(x) > 1 else np.eye(d)
    return axes


def _rotate(axes: dict[int, np.ndarray], width: float):
    schema = pa.schema([
        ("id", pa.int64()), ("weight", pa.int64()), ("label", pa.string()), ("d", pa.int32()), ("cell", pa.int64()),
        ("plain", pa.binary()), ("turned", pa.binary()),
    ])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lengths = np.diff(np.asarray(batch.column("vector").offsets))
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                plain = unit(_matrix(part.column("vector")))
                turned = plain @ axes[d] if d in axes else plain
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("weight"), part.column("label"), pa.array(np.full(len(part), d, np.int32)),
                    pa.array(np.floor(turned[:, 0] / width).astype(np.int64)),
                    pa.array([v.tobytes() for v in plain], pa.binary()), pa.array([v.tobytes() for v in turned], pa.binary()),
                ], schema=schema)

    return run, "id bigint, weight bigint, label string, d int, cell bigint, plain binary, turned binary"


def linked_pairs(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of two tiles whose cosine is at least ``least``, strip by strip.

    ``x`` and ``y`` are rotated rows, ``px`` and ``py`` the unrotated ones. The leading dimensions are summed first; by
    Cauchy-Schwarz the rest adds at most the product of the suffix norms, and a pair that cannot reach the limit any
    more is not looked at further. What remains is decided on the unrotated vectors.
    """
    d = x.shape[1]
    stops = [s for s in STEPS if s < d]
    rest = lambda m, k: np.sqrt((m[:, k:] ** 2).sum(axis=1))
    tails = [(rest(x, k), rest(y, k)) for k in stops]
    slack = least - 1e-9
    for a in range(0, len(x), STRIP):
        strip = x[a : a + STRIP]
        if stops:
            part = strip[:, : stops[0]] @ y[:, : stops[0]].T
            i, j = np.nonzero(part + tails[0][0][a : a + STRIP, None] * tails[0][1][None, :] >= slack)
            total = part[i, j]
        else:
            i, j = np.divmod(np.arange(len(strip) * len(y)), len(y))
            total = None
        i = i + a
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
            total = total[keep] if total is not None else None
        for n in range(1, len(stops)):
            if not len(i):
                break
            total = total + np.einsum("ij,ij->i", x[i, stops[n - 1] : stops[n]], y[j, stops[n - 1] : stops[n]])
            keep = total + tails[n][0][i] * tails[n][1][j] >= slack
            i, j, total = i[keep], j[keep], total[keep]
        if len(i):
            keep = np.einsum("ij,ij->i", px[i], py[j]) >= least
            if keep.any():
                yield i[keep], j[keep]


def _compare(least: float):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        weight = group.column("weight").to_numpy()
        side = group.column("side").to_numpy()
        plain, turned = (
            np.frombuffer(b"".join(group.column(c).to_pylist()), np.float64).reshape(len(ids), -1) for c in ("plain", "turned")
        )
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        same = bool((side == 0).any())
        links, root = np.zeros(len(ids), np.int64), ids.copy()
        found = []
        for i, j in linked_pairs(turned[left], turned[right], plain[left], plain[right], least, same):
            i, j = left[i], right[j]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            # One link for each row and strip keeps the components: the others go through the same least root.
            found.append(spanning(i, j))
        changed = bool(found)
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        while changed:
            before = root.copy()
            least_root = np.minimum(root[pairs[0]], root[pairs[1]])
            np.minimum.at(root, pairs[0], least_root)
            np.minimum.at(root, pairs[1], least_root)
            changed = bool((before != root).any())
        hit = links > 0
        return pa.table([pa.array(ids[hit]), pa.array(links[hit]), pa.array(root[hit])], schema=schema)

    return run, "id bigint, links bigint, root bigint"


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98,
    tile: int = TILE, sample: int = SAMPLE,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept. Links are pairs of equal, non-null label and length whose cosine
    in double precision is at least ``least``.

    Equal vectors of a label are one class, counted and represented by their smallest id, so a vector that a third of
    all rows share is compared once. Two vectors that are linked differ by at most sqrt(2 - 2 * least) along the first
    principal axis; the axis is cut into cells of that width and only equal and next cells meet. A cell is cut into
    tiles by its count, and every pair of tiles is one task, so no label or cell is the work of one task. A task returns
    a count and one root for each vector, never its pairs. The work inside a cell still grows with the square of its
    distinct vectors: that is the price of exact links.

    Vectors that are null, zero, or hold null or non-finite parts, and rows with a null id or label, link with nothing
    and are returned as their own component. Equal rows that repeat an id count once; rows that repeat an id with
    other vectors share the id's component. Other columns are ignored; an empty table gives an empty result.
    """
    width = math.sqrt(2 - 2 * least) + 1e-9
    rows = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    )
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = rows.filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd & F.exists("vector", lambda v: v != 0)
    )
    classes = usable.distinct().groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    classes = materialize(classes, "vector-classes")
    member = usable.join(classes, ["label", "vector"]).select("id", "rep", "weight").distinct()
    chosen = [list(r[0]) for r in bounded_sample(classes.select("rep", "vector"), "rep", sample).select("vector").collect()]
    run, schema = _rotate(principal_axes(chosen), width)
    turned = materialize(
        classes.select(F.col("rep").alias("id"), "weight", "label", "vector").mapInArrow(run, schema), "vector-turned"
    )
    sizes = turned.groupBy("label", "d", "cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    sizes = materialize(sizes, "vector-cells")
    placed = turned.join(sizes, ["label", "d", "cell"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    other = sizes.select("label", "d", F.col("cell").alias("cell2"), F.col("tiles").alias("tiles2"))
    meet = sizes.join(other, ["label", "d"]).filter("cell2 - cell between 0 and 1")
    meet = meet.withColumn("tile", F.explode(F.expr("sequence(0, tiles - 1)")))
    meet = meet.withColumn("tile2", F.explode(F.expr("sequence(if(cell2 = cell, tile, 0), tiles2 - 1)"))).select("label", "d", "cell", "tile", "cell2", "tile2")
    alone = (F.col("cell") == F.col("cell2")) & (F.col("tile") == F.col("tile2"))
    key = F.struct("label", "d", "cell", "tile", "cell2", "tile2").alias("pair")
    first = meet.select("label", "d", "cell", "tile", key, F.when(alone, 0).otherwise(1).alias("side"))
    second = meet.filter(~alone).select(
        "label", "d", F.col("cell2").alias("cell"), F.col("tile2").alias("tile"), key, F.lit(2).alias("side")
    )
    work = placed.join(first.unionByName(second), ["label", "d", "cell", "tile"]).select("pair", "side", "id", "weight", "plain", "turned")
    run, schema = _compare(least)
    found = materialize(work.groupBy("pair").applyInArrow(run, schema), "vector-links")
    edges = found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    # An id whose rows fall in several classes connects them.
    twice = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z")
    edges = edges.unionByName(member.join(twice, "id").filter("a <> rep").select("a", F.col("rep").alias("b")))
    label = components(edges, "vector-components")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_id = member.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(
        label.withColumnRenamed("id", "rep"), "rep", "left"
    ).groupBy("id").agg(
        F.max(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.min(F.coalesce("component", "rep")).alias("component")
    )
    out = rows.select("id").join(per_id, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
