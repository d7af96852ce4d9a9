"""Best-fit packing of tokenised documents in few sequences: local best fit, then merges of underfull sequences."""

from __future__ import annotations

import json
import math
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ticketlake.llm.common import batches, text_rows, text_slices
from ticketlake.session import materialize

CHUNK_BYTES = 4 << 20
#: Partition number times this, plus a counter, is the number of a sequence.
STRIDE = 1 << 36
_STOPS = string.punctuation
_KEPT, _KEPT_LENGTH = 500_000, 64


class LetterMerges:
    """The merges of a byte-pair vocabulary with word ends, applied to many words of Latin letters at once.

    A word's first symbols are the bytes of its UTF-8 form. Of neighbouring symbols the pair of lowest rank is merged, the
    first of equals, until no pair is a merge.
    """

    LONGEST = 16  # bytes

    def __init__(self, model: dict, suffix: str) -> None:
        ids = model["vocab"]
        # The vocabulary writes printable bytes as themselves and the others as the characters from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        signs = [chr(b if b in printable else next(others)) for b in range(256)]
        self.inner = np.array([ids[c] for c in signs], np.int32)
        self.last = np.array([ids[c + suffix] for c in signs], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs] + [0], np.int32)
        self.none = len(pairs)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.slot_keys = np.full(1 << 20, -1, np.int64)
        self.slot_ranks = np.full(1 << 20, self.none, np.int32)
        at = self._slot(self.keys)
        self.slot_keys[at], self.slot_ranks[at] = self.keys, self.ranks
        self.crowded = np.zeros(1 << 20, bool)  # slots of several keys: only there the sorted keys are searched
        self.crowded[at[self.slot_keys[at] != self.keys]] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 >> 12) & ((1 << 20) - 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 16 | b
        at = self._slot(key)
        out = np.where(self.slot_keys[at] == key, self.slot_ranks[at], self.none)
        doubt = np.nonzero(self.crowded[at])
        if len(doubt[0]):
            k = key[doubt]
            place = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out[doubt] = np.where(self.keys[place] == k, self.ranks[place], self.none)
        return out

    def codes(self, words: list[str], block: int = 8192) -> list[bytes]:
        """Ids of lower-case words of 1 to ``LONGEST`` bytes, each all letters; blocks that fit a core's cache."""
        return [c for a in range(0, len(words), block) for c in self._block(words[a : a + block])]

    def _block(self, words: list[str]) -> list[bytes]:
        width = self.LONGEST
        coded = [w.encode() for w in words]
        sizes = np.array([len(w) for w in coded])
        letters = np.frombuffer(b"".join(w.ljust(width) for w in coded), np.uint8).reshape(-1, width)
        columns = np.arange(width)
        symbols = np.where(columns == sizes[:, None] - 1, self.last[letters], self.inner[letters])
        ranks = np.full((len(words), width), self.none, np.int32)
        ranks[:, :-1] = self._rank(symbols[:, :-1], symbols[:, 1:])
        ranks[columns >= sizes[:, None] - 1] = self.none
        done, left, rows = symbols.copy(), sizes.copy(), np.arange(len(words))
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            going = best < self.none
            done[rows[~going]] = symbols[~going]
            if not going.any():
                break
            rows, symbols, ranks, at, best = rows[going], symbols[going], ranks[going], at[going], best[going]
            left[rows] -= 1
            n, i = left[rows], np.arange(len(rows))
            # The columns behind the pair move up by one.
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            symbols, ranks = np.take_along_axis(symbols, source, 1), np.take_along_axis(ranks, source, 1)
            symbols[i, at] = self.merged[best]
            after = np.minimum(at + 1, width - 1)
            ranks[i, at] = np.where(at + 1 < n, self._rank(symbols[i, at], symbols[i, after]), self.none)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self._rank(symbols[before, at[before] - 1], symbols[before, at[before]])
        raw, step = done.astype("<u4").tobytes(), 4 * width
        return [raw[i * step : i * step + 4 * n] for i, n in enumerate(left.tolist())]


class WordEncoder:
    """Token ids of a vocabulary that drops white space and lowers case, as ``tokenizers`` gives them.

    Nothing crosses a space, so the ids of a text are those of its words one after another, and stops behind a letter are
    a token run of their own. Words are encoded once, without such stops, and kept; if there are more than ``_KEPT``, those
    of the texts at hand. Words of a few letters a-z are merged together, others go through ``tokenizers``; texts with a
    special token's string do so whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        self.letters = LetterMerges(model, model["end_of_word_suffix"])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], kept: dict[str, bytes]) -> None:
        # Latin letters up to U+00FF: composed, and lowered one by one.
        plain = {p: p.lower() for p in pieces if p.isalpha() and max(p) < "\u0100" and len(p.encode()) <= LetterMerges.LONGEST}
        others = [p for p in pieces if p not in plain]
        kept.update(zip(plain, self.letters.codes(list(plain.values()))))
        kept.update(zip(others, self._encoded(others)))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        special = [any(s in text for s in self.special) for text in texts]
        cut = [[] if whole else text.replace("\n", " ").replace("\t", " ").split(" ") for text, whole in zip(texts, special)]
        words = set().union(*cut)
        kept = self.kept
        new = [w for w in words if w not in kept]
        if len(kept) + len(new) > _KEPT:
            kept = {w: kept[w] for w in words if w in kept}
        cores = [w.rstrip(_STOPS) for w in new]
        # A Latin letter before the stops: other characters may form one run with them.
        cores = [c if c and c[-1].isalpha() and c[-1] < "\u0100" else w for c, w in zip(cores, new)]
        stops = [w[len(c) :] for c, w in zip(cores, new)]
        self._learn([p for p in {*cores, *stops} if p not in kept], kept)
        for w, c, s in zip(new, cores, stops):
            if s:
                kept[w] = kept[c] + kept[s]
        out = [self._encoded([t])[0] if w else b"".join(map(kept.__getitem__, c)) for t, c, w in zip(texts, cut, special)]
        # Words as long as a text are not kept for the next ones.
        for w in [w for w in (*new, *cores, *stops) if len(w) > _KEPT_LENGTH]:
            kept.pop(w, None)
        self.kept = kept
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary; its pieces are kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Bins:
    """Open sequences by free room. An item goes where it leaves the least room, or opens a sequence."""

    def __init__(self, size: int, slack: int) -> None:
        self.size, self.slack = size, slack
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.rooms = 0  # bit r is set if a sequence has r free tokens

    def place(self, length: int, new: int) -> tuple[int, int]:
        """(sequence, offset) of an item; ``new`` is the number that a sequence opened for it gets."""
        fitting = self.rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = self.open[room].pop()
            if not self.open[room]:
                self.rooms ^= 1 << room
        else:
            room, at = self.size, new
        left = room - length
        if left > self.slack:
            self.open[left].append(at)
            self.rooms |= 1 << left
        return at, self.size - room

    def underfull(self) -> Iterator[tuple[int, int]]:
        """(sequence, tokens in it) of all open sequences."""
        for room, numbers in enumerate(self.open):
            for n in numbers:
                yield n, self.size - room


_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("bin", pa.int64()), ("place", pa.int64()), ("fill", pa.int64()),
])
_PIECES_SQL = "doc_id bigint, piece int, start bigint, length bigint, ids binary, bin bigint, place bigint, fill bigint"


def _local(path: str, size: int, slack: int, end_id: int):
    """Cuts, encodes and packs the documents of a task, chunk by chunk, and lists its underfull sequences (``fill`` is set)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bins = encoder(path), Bins(size, slack)
        number = TaskContext.get().partitionId() * STRIDE

        def chunk(part: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal number
            short = []
            for doc, ids in zip(part.column("id").to_pylist(), words.ids(part.column("text").to_pylist())):
                ids += end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, size)):
                    cut = ids[4 * start : 4 * (start + size)]
                    if len(cut) == 4 * size:
                        yield doc, piece, start, size, cut, number, 0, None
                        number += 1
                    else:
                        short.append((doc, piece, start, len(cut) // 4, cut))
            short.sort(key=lambda p: -p[3])
            for p in short:
                at, place = bins.place(p[3], number)
                number += at == number
                yield *p, at, place, None

        for batch in it:
            for part in text_slices(batch, CHUNK_BYTES):
                yield from batches(_PIECES, chunk(part))
        yield from batches(_PIECES, ((None, None, None, None, None, n, None, fill) for n, fill in bins.underfull()))

    return run


def _merge(size: int, slack: int):
    """Best fit of a group's underfull sequences, longest first, into one another."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bins, rows = Bins(size, slack), []
        group = group.sort_values(["fill", "bin"], ascending=[False, True])
        for number, fill in zip(group["bin"].tolist(), group["fill"].tolist()):
            rows.append((number, *bins.place(fill, number)))
        out = pd.DataFrame(rows, columns=["bin", "into", "shift"])
        still = dict(bins.underfull())
        first = out["bin"] == out["into"]
        out["fill"] = pd.array([still.get(b) if f else None for b, f in zip(out["bin"], first)], dtype="Int64")
        return out

    return run


def merge_underfull(underfull: DataFrame, size: int, slack: int = 0, group_items: int = 50_000) -> DataFrame:
    """(bin, into, shift) of the sequences (bin, fill) that end inside others, after rounds of best fit among themselves.

    A round deals the sequences to groups of about ``group_items`` by the hash of their number, and packs each group in
    one task. What is then nearly full, or has less room than the least of all, leaves; the rest is the next, smaller
    round, until one group holds it or a round merges less than one in a thousand. Each round is written, so the next
    one and a lost executor read the same numbers.
    """
    moves = underfull.limit(0).select("bin", F.col("bin").alias("into"), F.lit(0).cast("bigint").alias("shift"))
    rest = underfull
    while True:
        n, least = rest.agg(F.count("*"), F.min("fill")).first()
        able = rest.filter(F.col("fill") <= size - (least or 0))
        groups = max(1, math.ceil(n / group_items))
        if n < 2:
            return moves
        dealt = able.withColumn("part", F.pmod(F.xxhash64("bin", F.lit(groups)), F.lit(groups)))
        step = materialize(
            dealt.groupBy("part").applyInPandas(_merge(size, slack), "bin bigint, into bigint, shift bigint, fill bigint"), "packing-round"
        )
        merged = step.filter("bin <> into").select(F.col("bin").alias("_bin"), F.col("into").alias("_into"), F.col("shift").alias("_shift"))
        # What moved before goes on with the sequence that it is in; only moved sequences are listed.
        earlier = moves.join(merged, F.col("into") == F.col("_bin"), "left").select(
            "bin", F.coalesce("_into", "into").alias("into"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift")
        )
        moves = materialize(earlier.unionByName(step.filter("bin <> into").select("bin", "into", "shift")), "packing-moves")
        rest = step.filter("fill is not null").select("bin", "fill")
        if groups == 1 or rest.count() > 0.999 * n:
            return moves


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_best_fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, slack: int = 0, end_id: int = 0,
    path: str | None = None, group_items: int = 50_000,
) -> DataFrame:
    """Pieces of all documents in as few sequences of at most ``size`` tokens as best fit finds, one row per piece.

    A document is the ids of its text and ``end_id``; only one longer than ``size`` is cut, into pieces of ``size`` and a
    rest. Full pieces are sequences of their own. Each task packs its other pieces, a chunk at a time in descending
    length, where they leave the least room; its sequences stay open from chunk to chunk, of which it keeps numbers and
    rooms only, no ids. A sequence with at most ``slack`` free tokens is done; the others are merged as items by
    ``merge_underfull``. Texts are not shuffled; the ids are written once to the shared folder.

    Columns: doc_id, piece (from 0), start (ids of the document before the piece), length, ids (little-endian unsigned
    32-bit), sequence_id (unique, not contiguous), offset in the sequence (gapless from 0). Null or empty texts are
    documents of the single ``end_id``. Rows that repeat an id, and rows without one, are packed like others. Equal lengths
    keep their order. Other columns are ignored; an empty table gives an empty result.
    """
    packed = materialize(
        text_rows(docs, id_col, text_col).mapInArrow(_local(path or public_path(), size, slack, end_id), _PIECES_SQL), "packing-pieces"
    )
    underfull = packed.filter("fill is not null").select("bin", "fill")
    moves = merge_underfull(underfull, size, slack, group_items).withColumnRenamed("bin", "_bin")
    return packed.filter("fill is null").join(moves, F.col("bin") == F.col("_bin"), "left").select(
        "doc_id", "piece", "start", "length", "ids", F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
