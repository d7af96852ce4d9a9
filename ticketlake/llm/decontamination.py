"""Benchmark decontamination: items found in documents by windows of canonical words, with consistent slots.

Numbers, units after numbers and names become typed placeholders, so a question with other numbers or names has the
same template. Windows of template words are joined by hash; a window counts if its values are those that most places of
the passage show for the item's values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketlake.llm import words
from ticketlake.llm.common import BLOCK_BYTES, text_buffer, text_rows, text_slices
from ticketlake.session import materialize

WINDOW = 5
# Template windows of the benchmark that one pass over the documents looks for: 16 MB of hashes in a task.
PASS_WINDOWS = 2_000_000
#: Words that are units when they follow a number.
UNITS = frozenset(
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams lb lbs pound pounds oz ounce ounces ton tons ml l "
    "litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years c f k degree degrees percent dollar dollars cent cents euro euros mph kmh w kw v a hz".split()
)
#: Units in the plural or another spelling, and how their slots are written.
ONE_UNIT = {u: u[:-1] for u in UNITS if u[-1] == "s" and u[:-1] in UNITS} | {
    "feet": "foot", "inches": "inch", "litre": "liter", "litres": "liter", "euros": "euro",
}
#: Words that are numbers.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
#: Kinds of template words, and what stands for them in a template.
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
KINDS = "wnmu"
_MARKS = np.array([0, 0x6E756D626572, 0x6E616D65, 0x756E6974], np.uint64)


def _bytes(characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters.encode())] = True
    return found


_DIGIT, _UPPER = _bytes("0123456789"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SMALL = _bytes("abcdefghijklmnopqrstuvwxyz")
_SMALL[128:] = True  # a byte of another letter
_SOLID = _DIGIT | _UPPER | _SMALL
_INNER, _STOP = _bytes(".,:/"), _bytes(".!?\n")


def _known(names: frozenset[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(sorted(names)).encode(), np.uint8)
    return np.sort(words.word_hashes(data, np.zeros(1, np.int64))[0])


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template words of the texts in ``data``: hash, kind, first byte, end, and the lowered bytes.

    Words are runs of ASCII letters, digits and bytes of other letters; a dot, comma, colon or slash between digits
    belongs to the number. A word that begins with a digit, or is a number word, is a number; a unit word after a number
    is a unit; a capitalised word inside a sentence is a name. Words in capitals throughout, or at a sentence's start
    (the text's, or after a full stop, exclamation or question mark or line break), are ordinary. Latin letters with
    accents are lowered too; other alphabets are compared as they are written.
    """
    digit = _DIGIT[data]
    solid = _SOLID[data]
    if len(data) > 2:
        solid[1:-1] |= digit[:-2] & digit[2:] & _INNER[data[1:-1]]
    low = words.LOWER[data]
    accent = np.zeros(len(data), bool)
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = low + (accent * 32).astype(np.uint8)
    hashes, first, end = words.word_hashes(low, offsets[:-1], solid)
    kind = np.zeros(len(hashes), np.int8)
    if not len(hashes):
        return hashes, kind, first, end, low
    stops = np.concatenate([[0], np.cumsum(_STOP[data] & ~solid)])
    before = np.concatenate([[0], end[:-1]])
    opens = stops[first] > stops[before]
    opens[np.unique(np.searchsorted(first, offsets[:-1])[np.searchsorted(first, offsets[:-1]) < len(first)])] = True
    wide = np.append(data, np.uint8(32)), np.append(accent, False)
    tall = accent[np.minimum(first + 1, len(data) - 1)] & (data[first] == 0xC3)
    second = np.where(tall, np.minimum(first + 2, len(data)), np.minimum(first + 1, len(data)))
    inside = second < end
    small = inside & _SMALL[wide[0][second]] & ~wide[1][np.minimum(second + 1, len(data))]
    kind[(_UPPER[data[first]] | tall) & small & ~opens] = NAME
    kind[digit[first] | np.isin(hashes, _known(NUMBERS))] = NUMBER
    after = np.zeros(len(kind), bool)
    after[1:] = (kind[:-1] == NUMBER) & ~opens[1:]
    kind[after & (kind != NUMBER) & np.isin(hashes, _known(UNITS))] = UNIT
    return np.where(kind > 0, _MARKS[kind], hashes), kind, first, end, low


_SCHEMA = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("place", pa.int64()), ("slots", pa.list_(pa.string()))])
_COLUMNS = "id bigint, hash bigint, place bigint, slots array<string>"


def _find(size: int, wanted: bytes | None):
    """Template windows of each text (all its words as one window if they are fewer), or those whose hash is among the
    sorted ``wanted`` ones. Windows of placeholders alone say nothing and are no windows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else np.frombuffer(wanted, np.uint64)
        for batch in it:
            for part in text_slices(batch, BLOCK_BYTES):
                data, offsets = text_buffer(part.column("text"))
                hashes, kind, first, end, low = template(data, offsets)
                edges = np.searchsorted(first, offsets)
                runs = words.combine(hashes, size)
                doc = np.repeat(np.arange(len(part)), np.diff(edges))
                at = np.arange(len(runs))
                plain = np.concatenate([[0], np.cumsum(kind == WORD)])
                good = (doc[: len(runs)] == doc[size - 1 :]) & (plain[size:] > plain[:-size]) if len(runs) else np.zeros(0, bool)
                if known is not None and len(runs):
                    good &= known[np.minimum(np.searchsorted(known, runs), len(known) - 1)] == runs
                where, values, widths = at[good], runs[good], np.full(int(good.sum()), size)
                # Texts of fewer words than a window.
                for d in np.flatnonzero((np.diff(edges) < size) & (np.diff(edges) > 0)).tolist():
                    a, b = int(edges[d]), int(edges[d + 1])
                    if plain[b] > plain[a]:
                        one = words.combine(hashes[a:b], b - a)
                        if known is None or known[min(np.searchsorted(known, one[0]), len(known) - 1)] == one[0]:
                            where, values, widths = np.append(where, a), np.append(values, one), np.append(widths, b - a)
                if not len(where):
                    continue
                def value(at: int) -> str:
                    word = low[first[at] : end[at]].tobytes().decode("utf-8", "replace")
                    return KINDS[kind[at]] + (ONE_UNIT.get(word, word) if kind[at] == UNIT else word)

                slots = [
                    [f"{k}{value(w + k)}" for k in np.flatnonzero(kind[w : w + n]).tolist()]
                    for w, n in zip(where.tolist(), widths.tolist())
                ]
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(doc[where])), pa.array(values.view(np.int64)),
                    pa.array((where - edges[doc[where]]).astype(np.int64)), pa.array(slots, pa.list_(pa.string())),
                ], schema=_SCHEMA)

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = WINDOW, percent: int = 75, pass_windows: int = PASS_WINDOWS,
) -> DataFrame:
    """One row per document and benchmark item that it contains: id, item_id, item_windows, found_windows, slots.

    A document contains an item if at least ``percent`` of the item's distinct template windows occur in passages of
    the document with agreeing slots: within one alignment (same distance between places) a value of the item stands for
    the value that most of its places show (the same value at a tie, else none), and only windows with other values
    don't count. Two values of the item may stand for one of the document. ``slots`` counts the item's slot values that
    were matched. The benchmark's windows are looked for in passes of at most ``pass_windows`` hashes, so what a task
    holds is bounded however large the benchmark is; all documents are read whole in each pass.

    Null or empty texts contain nothing, items without words are contained nowhere, and rows without id are left out.
    Rows that repeat an id count as one document (or item) with the windows of all. Other columns are ignored; an
    empty table on either side gives an empty result.
    """
    names = "item bigint, hash bigint, item_place bigint, item_slots array<string>"
    items = text_rows(benchmark, item_col, item_text_col).filter("id is not null").mapInArrow(_find(size, None), _COLUMNS)
    items = materialize(items.toDF(*[x.split()[0] for x in names.split(", ")]), "benchmark-windows")
    keys = materialize(items.select("hash").distinct(), "benchmark-hashes")
    total = keys.count()
    passes = max(1, -(-total // pass_windows))
    source = text_rows(docs, id_col, text_col).filter("id is not null")
    hits = None
    for k in range(passes):
        part = keys.filter(F.pmod(F.xxhash64("hash"), F.lit(passes)) == k)
        known = np.sort(np.array([r[0] for r in part.toLocalIterator()], np.int64).view(np.uint64))
        found = source.mapInArrow(_find(size, known.tobytes()), _COLUMNS) if len(known) else None
        if found is not None:
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = source.filter("false").mapInArrow(_find(size, np.zeros(1, np.uint64).tobytes()), _COLUMNS)
    hits = materialize(hits, "benchmark-hits")
    met = hits.join(items, "hash").withColumn("shift", F.col("place") - F.col("item_place"))
    # A slot is written as position, kind and value: the kind and value are what must agree.
    slot = F.explode_outer(F.arrays_zip(F.col("slots").alias("theirs"), F.col("item_slots").alias("ours"))).alias("slot")
    bare = lambda c: F.regexp_replace(c, r"^\d+", "")
    passage = ["id", "item", "shift"]
    pairs = met.select(*passage, "hash", "item_place", "slots", slot).select(
        *passage, "hash", "item_place", "slots", bare("slot.theirs").alias("theirs"), bare("slot.ours").alias("ours"),
        (F.col("item_place") + F.regexp_extract("slot.ours", r"^\d+", 0).try_cast("bigint")).alias("at"),
    )
    # Places that show a value, doubled; the item's own value wins a tie.
    shown = pairs.filter("ours is not null").groupBy(*passage, "ours", "theirs").agg(F.countDistinct("at").alias("n"))
    shown = shown.withColumn("weight", 2 * F.col("n") + (F.col("ours") == F.col("theirs")).cast("int"))
    agreed = shown.groupBy(*passage, "ours").agg(
        F.max_by("theirs", "weight").alias("agreed"), F.sort_array(F.collect_list("weight"), False).alias("weights")
    ).filter("size(weights) = 1 or weights[0] > weights[1]").drop("weights")
    same = F.col("ours").isNull() | F.coalesce(F.col("theirs") == F.col("agreed"), F.lit(False))
    judged = pairs.join(agreed, [*passage, "ours"], "left").groupBy(*passage, "hash", "item_place", "slots").agg(
        F.min(same).alias("good"), F.collect_set("ours").alias("ours")
    ).filter("good")
    per_item = items.groupBy("item").agg(F.countDistinct("hash").alias("item_windows"))
    counted = judged.select(*passage, F.explode("ours").alias("ours")).groupBy(*passage).agg(F.countDistinct("ours").alias("n"))
    counted = counted.groupBy("id", "item").agg(F.max("n").alias("slots"))
    covered = judged.groupBy("id", "item").agg(F.countDistinct("hash").alias("found_windows"))
    covered = covered.join(counted, ["id", "item"], "left").withColumn("slots", F.coalesce("slots", F.lit(0).cast("bigint")))
    return covered.join(per_item, "item").filter(F.col("found_windows") * 100 >= F.col("item_windows") * percent).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "item_windows", "found_windows", "slots"
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no benchmark item."""
    found = materialize(contaminated(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias("_found")).distinct(), "benchmark-documents")
    return docs.join(found, docs[id_col] == found["_found"], "left_anti")
