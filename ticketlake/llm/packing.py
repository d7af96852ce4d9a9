"""Packing of tokenised documents into sequences of fixed length, balanced by attention cost."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ticketlake.llm.common import text_rows, text_slices

#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (projections, and attention within the piece).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
# Texts above this many characters go through the slower encoder, which takes runs of any length.
LONG_TEXT = 1_000_000
CHUNK_BYTES = 4 << 20
#: Partition number times this, plus a counter, is a sequence id.
STRIDE = 1 << 36


class Encoder:
    """Token ids of the byte-level vocabulary that ``tokenizers`` reads from ``json_path``.

    With ``ranks_path``, the same vocabulary as ranks, ordinary texts are encoded by ``tiktoken``: the same ids, four
    times as fast. Special token strings in a text become their ids, as ``tokenizers`` does by default.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items() if t.special}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) <= LONG_TEXT:
            return np.array(self.fast.encode(text, allowed_special="all", disallowed_special=()), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def public_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cost(n: float) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], capacities: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Places pieces of at most a full sequence into sequences with the given capacities.

    Pieces go in descending length, each to the sequence of lowest cost that still has room for all of it. A piece that
    fits nowhere is cut: the part that the roomiest sequence can take goes there, the rest waits its turn in the order.
    Returns (piece, start, length, sequence, offset) rows and the (piece, start, length) that found no room at all.
    Equal lengths keep their order, equal costs the first sequence.
    """
    room = np.array(capacities, np.int64)
    load = np.zeros(len(room))
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    placed, left = [], []
    while queue:
        minus, i, start = heapq.heappop(queue)
        n = -minus
        fits = room >= n
        if fits.any():
            at = int(np.where(fits, load, np.inf).argmin())
            take = n
        else:
            at = int(room.argmax()) if len(room) else -1
            take = int(room[at]) if at >= 0 else 0
            if not take:
                left.append((i, start, n))
                continue
            heapq.heappush(queue, (-(n - take), i, start + take))
        placed.append((i, start, take, at, int(capacities[at] - room[at])))
        room[at] -= take
        load[at] += cost(take)
    return placed, left


def _run(paths: tuple[str, str | None, str | None], size: int, end_id: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()),
    ])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*paths)
        number = TaskContext.get().partitionId() * STRIDE
        held: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of pieces that wait for the next chunk

        def fill(capacities: list[int]) -> list[tuple]:
            nonlocal held, number
            placed, left = pack([len(p[2]) for p in held], capacities)
            rows = []
            for i, start, n, at, offset in placed:
                doc, first, ids, total = held[i]
                rows.append((doc, first + start, n, ids[start : start + n].tobytes(), total, number + at, offset, capacities[at]))
            number += len(capacities)
            held = [(held[i][0], held[i][1] + s, held[i][2][s : s + n], held[i][3]) for i, s, n in left]
            return rows

        for batch in it:
            for part in text_slices(batch, CHUNK_BYTES):
                rows = []
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(encoder.ids(text), np.array([end_id], "<u4"))
                    total, whole = len(ids), len(ids) // size * size
                    for start in range(0, whole, size):
                        rows.append((doc, start, size, ids[start : start + size].tobytes(), total, number, 0, size))
                        number += 1
                    if whole < total:
                        held.append((doc, whole, ids[whole:], total))
                rows += fill([size] * (sum(len(p[2]) for p in held) // size))
                if rows:
                    yield out(rows)
        rest = sum(len(p[2]) for p in held)
        # The last tokens of a task, fewer than a full sequence: sequences of the powers of two that add up to them.
        rows = fill([size] * (rest // size) + [1 << b for b in range((rest % size).bit_length() - 1, -1, -1) if rest % size >> b & 1])
        if rows:
            yield out(rows)

    return run, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint"


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0,
    paths: tuple[str, str | None, str | None] | None = None,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens, one row per piece.

    A document is the ids of its text and ``end_id``. Whole sequences are cut off first; the remainders of a chunk of
    documents are packed by ``pack`` into exactly as many sequences as their tokens fill, and what is left over waits
    for the task's next chunk. Only a task's last tokens are in shorter sequences, each of a power of two, so no
    sequence needs padding. Nothing is shuffled; the task holds one chunk at a time.

    Columns: doc_id, start (ids of the document before the piece), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id (unique, not contiguous), offset in the sequence, sequence_tokens. Null or empty texts are
    documents of the single ``end_id``. Rows that repeat an id, and rows without one, are packed like others. Other
    columns are ignored; an empty table gives an empty result.
    """
    run, schema = _run(paths or public_paths(), size, end_id)
    return text_rows(docs, id_col, text_col).mapInArrow(run, schema)
