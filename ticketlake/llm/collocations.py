"""Phrases whose words keep together: exact phrase counts in prefix and suffix order, merged in lockstep."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketlake.llm.common import batches, text_slices
from ticketlake.session import materialize

#: Longest phrase in words; a number of a word has BITS bits, so the numbers of three words fit in one long.
LONGEST, BITS = 4, 18
#: Most words that get a number, and the longest of them in bytes; phrases with other words are counted as strings.
MAX_WORDS, MAX_WORD_BYTES = (1 << BITS) - 2, 64
UNKNOWN_LANG = "und"
_FILTER_CELLS = 134_217_689  # a prime under 2^27: bits of the filters that go to every task, 16 MB each
_A, _B = 1_000_003, 998_244_353
_BITMAP = 32_768  # bits of one of Spark's bitmaps
_HELD_WORDS, _HELD_PAIRS = 500_000, 4_000_000
_SLICE_BYTES = 1 << 20
_RANGE_ROWS, _MOST_RANGES = 50_000, 4096

# Bytes that end a piece become a line feed, A-Z is lowered, a tab is a space.
_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
_FOLD[9] = 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _FOLD[_c] = 10
_FOLD = bytes(_FOLD)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, folded texts of it, with a line feed between them) of a batch, a slice at a time."""
    for part in text_slices(batch, _SLICE_BYTES):
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            yield lang, "\n".join(texts).encode().translate(_FOLD)


def _count_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    held: dict[str, Counter] = {}

    def flush() -> Iterator[tuple]:
        for lang, counts in held.items():
            for word, n in counts.items():
                yield lang, word.decode(), n
        held.clear()

    for batch in it:
        for lang, data in _texts(batch):
            held.setdefault(lang, Counter()).update(data.split())
            if sum(map(len, held.values())) > _HELD_WORDS:
                yield from batches(schema, flush(), 50_000)
    yield from batches(schema, flush(), 50_000)


class Numbers:
    """Word numbers from 2 on; 1 is a word without a number that may be frequent, 0 ends a run."""

    def __init__(self, words: list[tuple[str, str]], others: bytes | None) -> None:
        self.words, self.others = words, others
        self.by_lang: dict[str, dict[bytes, int]] | None = None

    def __getstate__(self):
        return self.words, self.others, None

    def __setstate__(self, state) -> None:
        self.words, self.others, self.by_lang = state

    def _known(self, lang: str) -> dict[bytes, int]:
        if self.by_lang is None:
            self.by_lang = {}
            for i, (of, word) in enumerate(self.words):
                self.by_lang.setdefault(of, {b"": -1, b"\n": 0})[word.encode()] = i + 2
        return self.by_lang.setdefault(lang, {b"": -1, b"\n": 0})

    def encode(self, lang: str, data: bytes) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the words of folded text, and its tokens with the same places."""
        known = self._known(lang)
        tokens = data.replace(b"\n", b" \n ").split(b" ")
        if self.others is None:
            ids = np.array([known.get(t, 0) for t in tokens], np.int64)
            return ids[ids >= 0], tokens
        mark = f"{lang}\0".encode()

        def number(t: bytes) -> int:
            at = known.get(t)
            if at is None:
                cell = zlib.crc32(mark + t) % _FILTER_CELLS
                at = self.others[cell >> 3] >> (cell & 7) & 1
            return at

        tokens = [t for t in tokens if t]
        return np.array([number(t) for t in tokens], np.int64), tokens


def _filter_bits(cells: DataFrame) -> bytes:
    """The set cells (column ``cell``) as a bit array, lowest bit first: at most ``_FILTER_CELLS`` bits reach the driver."""
    maps = cells.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    out = bytearray(_FILTER_CELLS // 8 + _BITMAP)
    for bucket, bits in maps.toLocalIterator():
        # A bucket b holds the cells from (b - 1) * _BITMAP + 1 on; the first bit is the first cell.
        at = (bucket - 1) * _BITMAP // 8
        out[at : at + len(bits)] = bits
    return bytes(out)


def _shifted(cell: Column) -> Column:
    """A cell as Spark's bitmap functions count: from 1."""
    return cell + 1


def _number_words(counts: DataFrame, max_words: int) -> Numbers:
    """Numbers for the most frequent words, at most ``max_words``, and a filter of the others if there are any.

    The limit is put between two classes of counts, so ties at it are all left to the others.
    """
    short = F.octet_length("word") <= MAX_WORD_BYTES
    size_class = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(size_class.alias("c"), short.alias("short")).count().collect()  # 16 classes for each doubling
    least, total = math.inf, 0
    for c in sorted({r["c"] for r in sizes}, reverse=True):
        total += sum(r["count"] for r in sizes if r["c"] == c and r["short"])
        if total > max_words:
            break
        least = c
    chosen = short & (size_class >= F.lit(least).cast("double"))
    words = sorted((r["lang"], r["word"]) for r in counts.filter(chosen).select("lang", "word").toLocalIterator())
    if len(words) == sum(r["count"] for r in sizes):
        return Numbers(words, None)
    cell = F.crc32(F.concat(F.col("lang"), F.lit("\0"), F.col("word")).cast("binary")) % _FILTER_CELLS
    return Numbers(words, _filter_bits(counts.filter(~chosen).select(_shifted(cell).alias("cell"))))


def _windows(ids: np.ndarray, tokens: list[bytes]) -> Iterator[bytes]:
    """Phrases of two and more words that hold a word without a number."""
    for i in np.flatnonzero(ids == 1).tolist():
        for first in range(max(0, i - LONGEST + 1), i + 1):
            if (ids[first:i] != 1).all() and (ids[first : i + 1] > 0).all():  # the first such word of the phrase
                for end in range(max(first + 2, i + 1), min(first + LONGEST, len(ids)) + 1):
                    if ids[end - 1] <= 0:
                        break
                    yield b" ".join(tokens[first:end])


class _Sums:
    """Counts of integer keys, kept as sorted arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            part = np.unique(keys, return_counts=True)
            self.parts.append(part)
            self.held += len(part[0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = (np.concatenate(p) for p in zip(*self.parts))
        self.parts, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[edges], np.add.reduceat(n, edges)


def _count_pairs(numbers) -> Callable:
    """(key, n) of pairs of numbered words, and (lang, phrase, n) of phrases with other words."""
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, phrases = _Sums(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = pairs.take()
            for a in range(0, len(keys), 65_536):
                k = keys[a : a + 65_536]
                none = pa.nulls(len(k), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(k), none, none, pa.array(n[a : a + 65_536])], schema=schema)
            yield from batches(schema, ((None, lang, p.decode(), c) for (lang, p), c in phrases.items()), 50_000)
            phrases.clear()

        for batch in it:
            for lang, data in _texts(batch):
                ids, tokens = numbers.value.encode(lang, data)
                x, y = ids[:-1], ids[1:]
                both = (x > 1) & (y > 1)
                pairs.add(x[both] << BITS | y[both])
                if numbers.value.others is not None:
                    phrases.update((lang, p) for p in _windows(ids, tokens))
                if pairs.held > _HELD_PAIRS or len(phrases) > _HELD_WORDS:
                    yield from flush()
        yield from flush()

    return run


def _count_longer(numbers, pairs) -> Callable:
    """(key, last, n) of phrases of three and four numbered words (``last`` 0 for three) whose pairs may all be frequent."""
    schema = pa.schema([("key", pa.int64()), ("last", pa.int64()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threes = _Sums()
        fours: list[np.ndarray] = []
        bits = np.frombuffer(pairs.value, np.uint8)

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = threes.take()
            found = [(keys, np.zeros(len(keys), np.int64), n)] if len(keys) else []
            if fours:
                whole = np.concatenate(fours)
                fours.clear()
                whole = whole[np.lexsort((whole[:, 1], whole[:, 0]))]
                edges = np.flatnonzero(np.append(True, (whole[1:] != whole[:-1]).any(axis=1)))
                found.append((whole[edges, 0], whole[edges, 1], np.diff(np.append(edges, len(whole)))))
            for keys, last, n in found:
                for a in range(0, len(keys), 65_536):
                    cut = slice(a, a + 65_536)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[cut]), pa.array(last[cut]), pa.array(n[cut].astype(np.int64))], schema=schema)

        for batch in it:
            for lang, data in _texts(batch):
                ids, _ = numbers.value.encode(lang, data)
                x, y = ids[:-1], ids[1:]
                cell = (x * _A + y * _B) % _FILTER_CELLS
                may = (x > 1) & (y > 1) & (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 == 1)
                three = may[:-1] & may[1:]
                at = np.flatnonzero(three)
                key = (ids[at] << BITS | ids[at + 1]) << BITS | ids[at + 2]
                threes.add(key)
                longer = np.append(three, False)[at + 1] if len(at) else np.zeros(0, bool)
                if longer.any():
                    fours.append(np.stack([key[longer], ids[at[longer] + 3]], axis=1))
                if threes.held + sum(map(len, fours)) > _HELD_PAIRS:
                    yield from flush()
        yield from flush()

    return run


def _decoded(numbers) -> Callable:
    """(lang, words, a) of the phrases of numbered words."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.int64())])
    mask = (1 << BITS) - 1

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        words = numbers.value.words
        for key, last, a in zip(*(batch.column(c).to_pylist() for c in ("key", "last", "a"))):
            ids = [i for i in (key >> 2 * BITS & mask, key >> BITS & mask, key & mask, last) if i]
            yield words[ids[0] - 2][0], [words[i - 2][1] for i in ids], a

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from batches(schema, rows(batch), 50_000)

    return run


def phrase_counts(texts: DataFrame, min_count: int, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, a) of all phrases of up to four words with at least ``min_count`` places, and (lang, n) of all words.

    A phrase is no more frequent than its parts, so each step counts only what the one before leaves: words, pairs of
    frequent words, then phrases of frequent pairs. Tasks add up what they see before they send it. Frequent words get
    numbers; phrases with a frequent word beyond ``max_words`` are counted as strings. The pairs go back to the tasks as
    a bit filter of fixed size, which may let others through but holds none back.
    """
    spark = texts.sparkSession
    counted = texts.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(counted, "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.filter(F.col("n") >= min_count)
    numbers = spark.sparkContext.broadcast(_number_words(frequent, max_words))

    sent = texts.mapInArrow(_count_pairs(numbers), "key bigint, lang string, phrase string, n bigint")
    both = materialize(
        sent.groupBy("key", "lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= min_count), "phrase-pairs"
    )
    pairs = both.filter("key is not null")
    x, y = F.shiftrightunsigned("key", BITS), F.col("key").bitwiseAND((1 << BITS) - 1)
    bits = spark.sparkContext.broadcast(_filter_bits(pairs.select(_shifted((x * _A + y * _B) % _FILTER_CELLS).alias("cell"))))
    longer = texts.mapInArrow(_count_longer(numbers, bits), "key bigint, last bigint, n bigint")
    longer = longer.groupBy("key", "last").agg(F.sum("n").alias("a")).filter(F.col("a") >= min_count)
    coded = pairs.select("key", F.lit(0).cast("bigint").alias("last"), "a").unionByName(longer)
    out = frequent.select("lang", F.array("word").alias("words"), F.col("n").alias("a")).unionByName(
        coded.mapInArrow(_decoded(numbers), "lang string, words array<string>, a bigint")
    ).unionByName(both.filter("key is null").select("lang", F.split("phrase", " ", -1).alias("words"), "a"))
    return materialize(out, "phrase-counts"), totals


_Key = tuple[str, ...]


def _bounds(counts: DataFrame, order: Column, rows: int) -> list[_Key]:
    """Keys that cut the phrases, in this order, into ranges of about ``rows``; the driver gets some twenty keys a range."""
    total = counts.count()
    ranges = min(_MOST_RANGES, math.ceil(total / rows))
    if ranges < 2:
        return []
    share = min(1.0, 20 * ranges / total)
    spot = F.pmod(F.xxhash64("lang", "words"), F.lit(1 << 30))
    picked = counts.filter(spot < int(share * (1 << 30))).select("lang", order.alias("key")).toLocalIterator()
    keys = sorted((r["lang"], *r["key"]) for r in picked)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


_ROUTED = "part int, lang string, key array<string>, a bigint, ghost boolean"


def _route(bounds: list[_Key]) -> Callable:
    """Each phrase to its range, and a ghost of it to every range that begins among the phrases that go on from it."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("key", pa.list_(pa.string())), ("a", pa.int64()), ("ghost", pa.bool_())])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for lang, key, a in zip(*(batch.column(c).to_pylist() for c in ("lang", "key", "a"))):
            whole = (lang, *key)
            yield bisect_right(bounds, whole), lang, key, a, False
            at = bisect_left(bounds, whole)
            while at < len(bounds) and bounds[at][: len(whole)] == whole:
                if bounds[at] != whole:
                    yield at + 1, lang, key, a, True
                at += 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from batches(schema, rows(batch), 50_000)

    return run


def _lockstep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks phrases in order with the counts of all that they begin with at hand, and passes each count up one word.

    Emits (lang, key, a, ghost, firsts, longest): the counts of a phrase's beginnings, and the largest count among the
    phrases one word longer that begin with it.
    """
    schema = pa.schema([
        ("lang", pa.string()), ("key", pa.list_(pa.string())), ("a", pa.int64()), ("ghost", pa.bool_()),
        ("firsts", pa.list_(pa.int64())), ("extension", pa.int64()),
    ])

    def rows() -> Iterator[tuple]:
        stack: list[list] = []  # [lang, key, a, ghost, firsts, extension]
        at = None
        for batch in it:
            for part, lang, key, a, ghost in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "key", "a", "ghost"))):
                while stack and (part != at or stack[-1][0] != lang or stack[-1][1] != key[: len(stack[-1][1])]):
                    yield tuple(stack.pop())
                at = part
                if stack:
                    stack[-1][5] = max(stack[-1][5], a if not ghost else 0)
                stack.append([lang, key, a, ghost, [s[2] for s in stack], 0])
        while stack:
            yield tuple(stack.pop())

    yield from batches(schema, rows(), 50_000)


def _stream(counts: DataFrame, backwards: bool, firsts: str, extension: str, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """The count stream in prefix order (or suffix order, ``backwards``) after its lockstep walk, and its ghosts' findings."""
    order = F.reverse("words") if backwards else F.col("words")
    bounds = _bounds(counts, order, range_rows)
    routed = counts.select("lang", order.alias("key"), "a").mapInArrow(_route(bounds), _ROUTED)
    walked = routed.repartition("part").sortWithinPartitions("part", "lang", "key").mapInArrow(
        _lockstep, "lang string, key array<string>, a bigint, ghost boolean, firsts array<bigint>, extension bigint"
    )
    done = materialize(walked, "phrase-order")
    words = F.reverse("key") if backwards else F.col("key")
    real = done.filter("not ghost").select("lang", words.alias("words"), "a", F.col("firsts").alias(firsts), F.col("extension").alias(extension))
    return real, done.filter("ghost and extension > 0").select("lang", words.alias("words"), "extension")


def mine_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 30, top: int = 2000, max_words: int = MAX_WORDS,
    range_rows: int = _RANGE_ROWS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words that keep together.

    a counts a phrase's places, l and r those of its two parts at the cut with the lowest floor(2000000 * a / (l + r)), which
    is its score; n counts all words of the language. A phrase goes if a longer one that holds it has 80 % of its places:
    then one that is a single word longer has, so only those are looked at.

    ``phrase_counts`` counts exactly. The counts are kept as two streams, one ordered by the words from the first on, one
    from the last back. Walking a stream in order, the counts of all beginnings (endings) of the phrase at hand are known,
    and the largest count one word further on is handed up, so l, r and extensions need no lookup by hash. Streams are
    cut into ranges at sampled keys; a phrase that others continue beyond its range stands in for itself there. Both
    streams are then merge-joined. All counts are of whole texts and exact, scores are exact decimals.

    Null texts are empty, a null lang is ``und``. Words are kept apart by spaces and tabs, pieces by ``.,;:!?`` and line
    ends; repeated rows count each time. Equal scores are ordered by a, then by the phrase's bytes. Other columns are
    ignored; an empty table gives an empty result.
    """
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    counts, totals = phrase_counts(texts, min_count, max_words)
    left, ghosts = _stream(counts, False, "lefts", "right_more", range_rows)
    right, more = _stream(counts, True, "rights", "left_more", range_rows)
    stand_ins = materialize(ghosts.unionByName(more).groupBy("lang", "words").agg(F.max("extension").alias("extension")), "phrase-ghosts")
    many = F.size("words") >= 2
    merged = left.filter(many).hint("merge").join(right.filter(many).drop("a"), ["lang", "words"])
    merged = merged.join(stand_ins, ["lang", "words"], "left")
    longest = F.greatest("left_more", "right_more", F.coalesce("extension", F.lit(0)))
    # A cut after k words leaves the beginning of k words and the ending of size - k words.
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
        k.alias("k"), F.get("lefts", k - 1).alias("l"), F.get("rights", F.size("words") - k - 1).alias("r")))
    one = F.explode(cuts).alias("cut")
    whole = F.expr("CAST(2000000 * CAST(a AS DECIMAL(20,0)) DIV (CAST(cut.l AS DECIMAL(20,0)) + CAST(cut.r AS DECIMAL(20,0))) AS BIGINT)")
    kept = merged.filter(F.lit(100) * longest < F.lit(80) * F.col("a")).select("lang", "words", "a", one)
    best = kept.groupBy("lang", "words", "a").agg(F.min(F.struct(whole.alias("score"), F.col("cut.k"), F.col("cut.l"), F.col("cut.r"))).alias("b"))
    phrases = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "b.l", "b.r", "b.score")
    place = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    listed = phrases.withColumn("rank", F.row_number().over(place).cast("bigint")).filter(F.col("rank") <= top)
    return listed.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
