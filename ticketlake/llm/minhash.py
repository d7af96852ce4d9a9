"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One permutation places the shingles on a ring of 2^32 positions; a second one, shifted by k positions, gives coordinate
k of the signature. Rows of coordinates form bands, equal bands make buckets, and every link is confirmed on the full
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketlake.llm import words
from ticketlake.llm.common import components, spanning, text_buffer, text_rows, text_slices
from ticketlake.session import materialize

# 32 bands of 4 rows: a pair at similarity 0.75 shares no band with probability 5e-6.
BANDS, ROWS = 32, 4
#: Buckets up to this size compare all their pairs at once; classes in a block when a larger bucket's rest is compared.
SMALL_BUCKET, TILE = 16, 256
_RING = np.uint32


def _place(sets: np.ndarray) -> np.ndarray:
    """First permutation: the position of each shingle on the ring (its hash, permuted)."""
    return (words.mix(sets + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(_RING)


def _second(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Second permutation of the ring, in place: every step is a bijection of 32-bit words."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, _RING(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, _RING(factor), out=x)
    np.right_shift(x, _RING(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def signatures(sets: list[np.ndarray], size: int, block: int = 1 << 15) -> np.ndarray:
    """Circulant MinHash signatures of non-empty shingle sets: one row for each, ``size`` coordinates."""
    out = np.full((len(sets), size), 0xFFFFFFFF, _RING)
    if not sets:
        return out
    ring = _place(np.concatenate(sets))
    ends = np.cumsum([len(s) for s in sets])
    starts = ends - np.array([len(s) for s in sets])
    for at in range(0, len(ring), block):
        part = ring[at : at + block]
        low = int(np.searchsorted(ends, at, "right"))
        high = int(np.searchsorted(starts, at + len(part), "left"))
        edges = np.maximum(starts[low:high] - at, 0)
        x, spare = np.empty_like(part), np.empty_like(part)
        for k in range(size):
            np.add(part, _RING(k), out=x)
            least = np.minimum.reduceat(_second(x, spare), edges)
            np.minimum(out[low:high, k], least, out=out[low:high, k])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; equal keys mean equal rows of the same band."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    keys = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = np.broadcast_to(keys, parts.shape[:2]).copy()
    for r in range(rows):
        keys = words.mix(keys + parts[:, :, r] + np.uint64(1))
    return keys.view(np.int64)


def _sign(shingle: int, bands: int, rows: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in text_slices(batch):
                sets = words.shingle_sets(*text_buffer(part.column("text")), shingle)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                # Two sums of differently mixed hashes stand for the whole set.
                fa = np.array([words.mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                fb = np.array([words.mix(s + np.uint64(0xC3C3)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                keys = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)
                edges = np.zeros(len(sets) + 1, np.int32)
                np.cumsum(np.where(n > 0, bands, 0), out=edges[1:])
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(fa), pa.array(fb), lists], schema=schema)

    return run, "id bigint, n bigint, fa bigint, fb bigint, keys array<bigint>"


def _sets(shingle: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in text_slices(batch):
                sets = words.shingle_sets(*text_buffer(part.column("text")), shingle)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return run, "id bigint, shingles binary"


def _overlap(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("either", pa.int64())])
    for batch in it:
        shared, either = [], []
        for x, y in zip(batch.column("left_set"), batch.column("right_set")):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(p) > len(q):
                p, q = q, p
            both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
            shared.append(both)
            either.append(len(p) + len(q) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(either, pa.int64())], schema=schema)


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact intersection and union sizes of the pairs (a, b). A pivot's many pairs are a skewed join, which AQE splits."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right_set"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left_set", "right_set").mapInArrow(
        _overlap, "a bigint, b bigint, shared bigint, either bigint"
    )


def _tile(percent: int):
    """Links between the classes of two blocks that are not in one component: enough of them to join what is linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        ids, parts = group.column("id").to_numpy(), group.column("component").to_numpy()
        minor = group.column("minor").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64())] * 2, schema=schema)
        known = np.unique(np.concatenate([sets[i] for i in left]))
        where = []
        for s in sets:
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            where.append(at[known[at] == s])
        shared = np.zeros((len(left), len(right)), np.float32)
        for base in range(0, len(known), 8192):
            width = min(8192, len(known) - base)
            both = []
            for side in (left, right):
                present = np.zeros((len(side), width), np.float32)
                for row, i in enumerate(side):
                    low, high = np.searchsorted(where[i], (base, base + width))
                    present[row, where[i][low:high] - base] = 1
                both.append(present)
            shared += both[0] @ both[1].T
        n = np.array([len(s) for s in sets], np.int64)
        count = shared.astype(np.int64)
        either = n[left][:, None] + n[right][None, :] - count
        i, j = np.nonzero((count * 100 >= either * percent) & (parts[left][:, None] != parts[right][None, :]))
        edges = spanning(left[i], right[j])
        return pa.table([pa.array(ids[edges[0]]), pa.array(ids[edges[1]])], schema=schema)

    return run, "a bigint, b bigint"


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = 5,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets. Candidates share a band;
    each link is confirmed on the full sets. Documents with equal sets are one class, represented by its smallest id.
    A bucket of up to SMALL_BUCKET classes compares all their pairs, a larger one every class with a pivot. Jaccard distance
    is a metric, so of the pivot's component only classes go on whose distance from the pivot is within the linking distance
    of another component's. In what is left, all classes outside the bucket's largest component meet all others in blocks of
    TILE, each pair of blocks one task that returns at most a spanning forest of its links. So a group of n near copies
    costs n comparisons, not n * n; only classes that stay unlinked to the group are compared with all of it.

    Null or empty texts have no shingles and link with nothing. Rows that repeat an id count as one document that has
    the links of all of them; each row is returned. A row without id links with nothing, has no component and is kept.
    Other columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    source = text_rows(docs, id_col, text_col)
    run, schema = _sign(shingle, bands, rows)
    signed = materialize(source.mapInArrow(run, schema), "minhash-signed")
    usable = signed.filter("id is not null and n > 0")
    first = usable.groupBy("n", "fa", "fb").agg(F.min(F.struct("id", "keys")).alias("first"))
    classes = materialize(first.select("n", "fa", "fb", F.col("first.id").alias("rep"), F.col("first.keys").alias("keys")), "minhash-classes")
    member = materialize(
        usable.select("id", "n", "fa", "fb").join(classes.drop("keys"), ["n", "fa", "fb"]).select("id", "rep"), "minhash-members"
    )
    buckets = classes.select(F.col("rep").alias("id"), "n", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    active = materialize(buckets.join(shared.select("key"), "key"), "minhash-buckets")
    run, schema = _sets(shingle)
    sets = materialize(source.join(active.select("id").distinct(), "id", "left_semi").mapInArrow(run, schema), "minhash-sets")
    # An id that repeats with different sets belongs to several classes: they are one document.
    several = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a < last")
    links = materialize(member.join(several, "id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "minhash-links")
    # First round: small buckets compare their pairs, larger ones each class with a pivot.
    state = active.join(
        active.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("size")), "key"
    )
    state = materialize(state, "minhash-open")
    few = state.filter(F.col("size") <= SMALL_BUCKET).join(classes.select(F.col("rep").alias("id"), "n", "keys"), ["id", "n"])
    x = few.select("key", F.col("id").alias("a"), F.col("n").alias("n1"), F.col("keys").alias("k1"))
    y = few.select("key", F.col("id").alias("b"), F.col("n").alias("n2"), F.col("keys").alias("k2"))
    close = lambda p, q: F.least(p, q) * 100 >= F.greatest(p, q) * percent  # noqa: E731  sets of other sizes cannot be linked
    # A pair that shares several buckets is compared in the one of smallest key.
    once = F.array_min(F.array_intersect("k1", "k2")) == F.col("key")
    pairs = x.join(y, "key").filter((F.col("a") < F.col("b")) & close("n1", "n2") & once)
    large = state.filter((F.col("size") > SMALL_BUCKET) & (F.col("id") != F.col("pivot")))
    pivots = large.select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    measured = materialize(_measure(pairs.select("a", "b").unionByName(pivots).distinct(), sets), "minhash-measured")
    linked = F.col("shared") * 100 >= F.col("either") * percent
    links = materialize(links.unionByName(measured.filter(linked).select("a", "b")).distinct(), "minhash-links")
    label = materialize(components(links), "minhash-labels")
    # Second round: what large buckets hold besides their pivots, without what cannot join two components any more.
    gap = 1.0 - percent / 100 + 1e-9
    far = measured.groupBy("a", "b").agg(F.min(1.0 - F.col("shared") / F.col("either")).alias("distance"))
    rest = large.select("key", "pivot", "id").join(far.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "distance"), ["pivot", "id"])
    home = label.select(F.col("id").alias("pivot"), F.col("component").alias("home"))
    rest = rest.join(label, "id", "left").join(home, "pivot", "left").select(
        "key", "id", "distance", F.coalesce("component", "id").alias("component"), F.coalesce("home", "pivot").alias("home")
    )
    rest = materialize(rest, "minhash-rest")
    outside = F.when(F.col("component") != F.col("home"), F.col("distance"))
    near = rest.groupBy("key").agg(F.min(outside).alias("near")).filter("near is not null")
    # The pivot's own component is one already: its classes matter only if another one is near enough.
    rest = materialize(
        rest.join(near, "key").filter((F.col("component") != F.col("home")) | (F.col("near") - F.col("distance") <= gap))
        .select("key", "id", "component"),
        "minhash-undecided",
    )
    shares = rest.groupBy("key", "component").agg(F.count("*").alias("c"))
    keys = shares.groupBy("key").agg(
        F.sum("c").alias("size"), F.max("c").alias("most"), F.count("*").alias("parts"), F.max_by("component", F.struct("c", "component")).alias("major")
    ).filter("parts > 1")
    blocks = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    keys = materialize(
        keys.select("key", "major", blocks(F.col("size") - F.col("most")).alias("rows"), blocks(F.col("size")).alias("columns")), "minhash-tiles"
    )
    if not keys.isEmpty():
        # Classes outside the largest component meet all others of the bucket, block by block.
        rest = rest.join(keys, "key").withColumn("spot", F.xxhash64("id"))
        minor = rest.filter("component <> major").withColumn("column", F.explode(F.expr("sequence(0, columns - 1)")))
        minor = minor.select("key", F.expr("cast(pmod(spot, rows) as int)").alias("row"), "column", F.lit(True).alias("minor"), "id", "component")
        every = rest.withColumn("row", F.explode(F.expr("sequence(0, rows - 1)")))
        every = every.select("key", "row", F.expr("cast(pmod(spot, columns) as int)").alias("column"), F.lit(False).alias("minor"), "id", "component")
        run, schema = _tile(percent)
        tiles = minor.unionByName(every).join(sets, "id").groupBy("key", "row", "column").applyInArrow(run, schema)
        links = materialize(links.unionByName(tiles).distinct(), "minhash-links")
        label = materialize(components(links), "minhash-labels")
    final = member.join(label.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(
        F.min(F.coalesce("component", "rep")).alias("component")
    )
    out = signed.select("id", "n").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
