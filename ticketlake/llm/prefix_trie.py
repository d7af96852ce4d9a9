"""Trie of conversation prefixes: a count-min sketch keeps the tails that only one conversation has out of the shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ticketlake.llm.common import batches
from ticketlake.session import materialize

# Conversations of a family, and the number of different lengths of what they share with its first.
FAMILY, HEADS = 5, 9
ROOT = bytes(16)
#: Sketch rows, and the most cells of one: a bit for each cell goes to every task, 32 MB at most.
DEPTH, MAX_CELLS = 2, 1 << 27
_PART = 1 << 20  # cells that one task counts at once
_FLUSH = 1 << 20  # digests that a task holds before it sends their cells
#: Ids that one piece of a node's list of ends can hold.
END_BLOCK = 4096

_PREFIX = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("ends", pa.bool_()),
])
_PREFIX_SQL = "conv_id bigint, depth bigint, digest binary, parent binary, bytes bigint, ends boolean"


def _rebuild(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes of the rebuilt conversations of sorted turns: first conversation of a family first, then turns in order."""

    def rows() -> Iterator[tuple]:
        family = conv = last = None
        heads: list[tuple[bytes, int]] = []
        skip, own, depth, digest = 0, 0, 0, ROOT

        def push(turn: bytes, size: int) -> Iterator[tuple]:
            nonlocal depth, digest, last
            if last:
                yield *last, False
            parent, digest, depth = digest, blake2b(digest + turn, digest_size=16).digest(), depth + 1
            last = (conv, depth, digest, parent, size)

        def finish() -> Iterator[tuple]:
            if conv is not None:
                yield (*last, True) if last else (conv, 0, ROOT, None, 0, True)

        for batch in it:
            columns = (batch.column(c).to_pylist() for c in ("family", "conv_id", "turn_digest", "bytes"))
            for f, c, turn, size in zip(*columns):
                if c != conv or f != family:
                    yield from finish()
                    if f != family:
                        family, heads = f, []
                    conv, last, own, depth, digest = c, None, 0, 0, ROOT
                    skip = 0 if c == f else zlib.crc32(str(c).encode()) % HEADS
                    for head in heads[:skip]:
                        yield from push(*head)
                if c == f and len(heads) < HEADS - 1:
                    heads.append((turn, size))
                if own >= skip:
                    yield from push(turn, size)
                own += 1
        yield from finish()

    yield from batches(_PREFIX, rows())


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, bytes, ends): every prefix of every rebuilt conversation, its own and its parent's
    digest, the size of its last text, and whether the conversation ends there; depth 0 only for those without turns.

    Turns are sent as digests; a family of conversations meets in one task, which streams them and holds eight turns.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    c = F.col("conv_id").cast("bigint")
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    slim = turns.filter(c.isNotNull()).select(
        (c - c % FAMILY).alias("family"), c.alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.substring(F.unhex(whole), 1, 16).alias("turn_digest"), F.octet_length(text).cast("bigint").alias("bytes"),
    )
    order = ["family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "role", "turn_digest"]
    dealt = slim.repartition("family").sortWithinPartitions(*order)
    return dealt.select("family", "conv_id", "turn_digest", "bytes").mapInArrow(_rebuild, _PREFIX_SQL)


def _words(column: pa.Array) -> np.ndarray:
    """Non-null 16-byte values as two columns of unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


def _cells(it: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """(line, part, once, more): the sketch cells that digests fall in, as offsets in parts; ``more`` were hit again."""
    schema = pa.schema([("line", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])

    def flush(held: list[np.ndarray]) -> Iterator[tuple]:
        for line in range(DEPTH if held else 0):
            at, n = np.unique(np.concatenate([h[:, line] for h in held]) & np.uint64(cells - 1), return_counts=True)
            edges = np.searchsorted(at, np.arange(0, cells + _PART, _PART, dtype=np.uint64))
            for part in np.flatnonzero(np.diff(edges)).tolist():
                cut = slice(edges[part], edges[part + 1])
                offset, again = (at[cut] % np.uint64(_PART)).astype("<u4"), n[cut] > 1
                yield line, part, offset[~again].tobytes(), offset[again].tobytes()

    def rows() -> Iterator[tuple]:
        held: list[np.ndarray] = []
        for batch in it:
            held.append(_words(batch.column("digest")))
            if sum(map(len, held)) >= _FLUSH:
                yield from flush(held)
                held = []
        yield from flush(held)

    yield from batches(schema, rows(), 16)


def _count(it: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """(line, part, bits): which cells of a part were hit more than once; the rows of a part follow one another."""
    schema = pa.schema([("line", pa.int32()), ("part", pa.int32()), ("bits", pa.binary())])

    def rows() -> Iterator[tuple]:
        at, seen = None, np.zeros(0, np.uint8)
        for batch in it:
            for line, part, once, more in zip(*(batch.column(c).to_pylist() for c in ("line", "part", "once", "more"))):
                if (line, part) != at:
                    if at:
                        yield *at, np.packbits(seen > 1).tobytes()
                    at, seen = (line, part), np.zeros(min(_PART, cells), np.uint8)
                once, more = np.frombuffer(once, "<u4"), np.frombuffer(more, "<u4")
                seen[once] = np.minimum(seen[once] + 1, 2)
                seen[more] = 2
        if at:
            yield *at, np.packbits(seen > 1).tobytes()

    yield from batches(schema, rows(), 16)


def sketch(paths: DataFrame, max_cells: int = MAX_CELLS) -> tuple[np.ndarray, int]:
    """The count-min sketch of the prefix digests, each counter cut to "more than one", and its cells in a line.

    There are eight cells for each prefix, up to ``max_cells``. Beyond that fewer singletons are proved and more prefixes
    shuffle, but what is proved stays true.
    """
    deep = paths.filter("depth > 0").select("digest")
    cells = 1 << min(max(16, (8 * deep.count()).bit_length()), max_cells.bit_length() - 1)
    sent = deep.mapInArrow(lambda it: _cells(it, cells), "line int, part int, once binary, more binary")
    counted = sent.repartition("line", "part").sortWithinPartitions("line", "part").mapInArrow(
        lambda it: _count(it, cells), "line int, part int, bits binary"
    )
    bits = np.zeros((DEPTH, cells // 8), np.uint8)
    width = min(_PART, cells) // 8
    for line, part, packed in counted.toLocalIterator():  # max_cells bits a line at most
        bits[line, part * width : (part + 1) * width] = np.frombuffer(packed, np.uint8)
    return bits, cells


def screened(spark: SparkSession, paths: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """Prefixes with ``alone``: an estimate of one proves that no other conversation has the parent prefix."""
    bits, cells = sketch(paths, max_cells)
    shared = spark.sparkContext.broadcast(bits)

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parent = batch.column("parent").to_pylist()
            at = np.frombuffer(b"".join(p or ROOT for p in parent), "<u8").reshape(-1, 2) & np.uint64(cells - 1)
            many = np.ones(len(parent), bool)
            for line in range(DEPTH):
                byte = shared.value[line][(at[:, line] >> np.uint64(3)).astype(np.int64)]
                many &= (byte >> (np.uint8(7) - (at[:, line] & np.uint64(7)).astype(np.uint8))) & 1 == 1
            deep = batch.column("depth").to_numpy(zero_copy_only=False) > 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deep & ~many)], names=[*batch.schema.names, "alone"])

    return paths.mapInArrow(look, f"{_PREFIX_SQL}, alone boolean")


def _end_lists(rows: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the sorted, comma-joined ids of the conversations that end at each prefix.

    Ids are joined in blocks by number first, so the task that hashes a list reads one row for up to ``END_BLOCK`` ids.
    """
    block = F.floor(F.col("conv_id") / END_BLOCK)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = rows.filter("ends").groupBy("digest", block.alias("block")).agg(joined.alias("ids"))

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists() -> Iterator[tuple]:
            at, running = None, sha256()
            for batch in it:
                for key, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                    if key != at:
                        if at is not None:
                            yield at, running.hexdigest()
                        at, running = key, sha256(ids.encode())
                    else:
                        running.update(b"," + ids.encode())
            if at is not None:
                yield at, running.hexdigest()

        yield from batches(pa.schema([("end_digest", pa.binary()), ("ends_sha256", pa.string())]), lists())

    ordered = blocks.repartition("digest").sortWithinPartitions("digest", "block").select("digest", "ids")
    return ordered.mapInArrow(digest, "end_digest binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the root included.

    Columns, all long but the last: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; null at the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The sketch proves for most prefixes that their parent has one member: such tails are rows of their own conversation
    and are not shuffled. All other prefixes are grouped by their 128-bit digests, and what a subtree holds is carried
    by single members: a node's saving, its place among its parent's children and a leaf each count once, for the node's
    smallest member, and are summed from the end of that conversation upwards. So the number of rounds does not grow with
    the depth. Groups are pre-aggregated; a prefix that a third of all conversations share is one row of the node table
    and is joined back by AQE's skew join, or by broadcast if that table is small. One family (five conversations) is
    streamed by one task, in bounded memory.

    Rows without a conv_id belong to no conversation. Turns with equal numbers are ordered by role, then by the digest of
    role and text; repeated rows are turns. Ids count as their integer values; ``c % 5`` has the sign of c. Null roles and
    texts are empty. A conversation without turns left ends at the root. Other columns are ignored, an empty table gives
    an empty result.
    """
    spark = turns.sparkSession
    paths = materialize(prefixes(turns), "trie-prefixes")
    checked = screened(spark, paths, max_cells)
    rows = materialize(checked.filter("not alone").drop("alone", "parent"), "trie-shared")
    first = paths.agg(F.min("conv_id")).first()[0]

    counted = rows.filter("depth > 0").groupBy(F.col("digest").alias("node")).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("first"), F.bool_or(~F.col("ends")).alias("inner")
    )
    nodes = materialize(counted, "trie-nodes")
    joined = rows.filter("depth > 0").join(nodes, F.col("digest") == F.col("node"))
    upwards = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    mine, below, above = F.col("first") == F.col("conv_id"), F.lag("depth").over(upwards), F.lead("depth").over(upwards)
    leaf = F.when(F.col("ends"), mine & ~F.col("inner")).otherwise(True)
    child = F.when(below == F.col("depth") + 1, F.lag(mine).over(upwards)).otherwise(~F.col("ends"))
    parent = (
        F.when(F.col("depth") == 1, F.lit(first)).when(above == F.col("depth") - 1, F.lead("first").over(upwards))
        .otherwise(F.col("conv_id"))
    )
    carried = joined.select(
        "digest", "conv_id", "depth", mine.alias("mine"), parent.alias("parent_conv_id"), child.cast("bigint").alias("child"),
        F.first(leaf.cast("bigint")).over(upwards).alias("leaf"),
        F.sum(F.when(mine, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0)).over(upwards).alias("saved"),
    )
    shared = materialize(
        carried.groupBy("digest").agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.min(F.when(F.col("mine"), F.col("parent_conv_id"))).alias("parent_conv_id"),
            F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        ),
        "trie-shared-nodes",
    )
    # The root: what its children hold, and the conversations without turns.
    top = shared.filter("depth = 1").select("conv_id", "n_convs", F.lit(1).alias("kid"), "n_leaves", "saved_tokens").unionByName(
        rows.filter("depth = 0").groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        .selectExpr("conv_id", "n_convs", "0 AS kid", "0L AS n_leaves", "0L AS saved_tokens")
    )
    root = top.agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("kid").alias("n_children"),
        F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    ).filter("n_convs > 0").withColumns({
        "digest": F.lit(ROOT), "depth": F.lit(0).cast("bigint"), "parent_conv_id": F.lit(None).cast("bigint")
    })
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    grouped = shared.unionByName(root).join(_end_lists(rows), F.col("digest") == F.col("end_digest"), "left")
    nothing = F.lit(sha256().hexdigest())
    tails = checked.filter("alone").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
        (~F.col("ends")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return grouped.select(*columns, F.coalesce("ends_sha256", nothing).alias("ends_sha256")).unionByName(tails)
