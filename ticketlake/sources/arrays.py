"""Records of JSON array files, read by byte ranges: one large file is many tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ticketlake.session import materialize

_MARKS = re.compile(r'["{\[\]\n]|\\.', re.S)
_CLOSE = re.compile(r'["\n]|\\.', re.S)
_SPACE = " \t\r\n,"
_DEEP = 1 << 20


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, piece): the text between closing braces, in the order of the file within each range of it.

    A closing brace as line separator makes the text reader split a file anywhere, whatever its lines are.
    """
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("piece"))


class Scanner:
    """Walks over pieces of a range and knows whether it is inside a string, and how deep.

    Depth 1 is between records. A raw line end cannot be inside a string, so a string that lacks its closing quote ends
    there; and no object can follow a comma directly inside a record, so a record that lacks its brace ends there.
    """

    def __init__(self, in_string: bool = False, depth: int = 1) -> None:
        self.in_string, self.depth = in_string, depth
        self.open = depth > 1  # inside a record
        self.head = self.open  # the record began before this range
        self.text: list[str] = []

    def cut(self, piece: str, closed: bool = True) -> Iterator[tuple[str, str]]:
        """(kind, text) of what ends with this piece: a record, the ``head`` of one that began earlier, or junk."""
        at = begin = 0
        while True:
            found = (_CLOSE if self.in_string else _MARKS).search(piece, at)
            if not found:
                break
            mark, at = found.group(), found.end()
            if mark == '"':
                self.in_string = not self.in_string
            elif mark == "\n":
                self.in_string = False
            elif mark == "{" and (not self.open or self.depth == 2 and piece[begin : found.start()].rstrip().endswith(",")):
                self.text.append(piece[begin : found.start()])
                yield from self._finish()
                begin, self.open, self.depth = found.start(), True, 2
            elif self.open:
                self.depth += 1 if mark in "{[" else -1 if mark == "]" and self.depth > 2 else 0
        self.text.append(piece[begin:])
        if not closed:
            return
        self.text.append("}")
        if not self.in_string and self.open:
            self.depth -= 1
            if self.depth == 1:
                yield from self._finish()

    def _finish(self) -> Iterator[tuple[str, str]]:
        text, kind = "".join(self.text), "head" if self.head else "record"
        text = text if self.open else text.strip(_SPACE + "[]")
        self.text, self.open, self.head, self.depth = [], False, False, 1
        if text or kind == "head":
            yield kind, text

    def rest(self) -> Iterator[tuple[str, str]]:
        """What is left at the end of a range: a record that goes on, or all of the range's part of one."""
        if self.open:
            yield ("middle" if self.head else "tail"), "".join(self.text)
        else:
            text = "".join(self.text).strip(_SPACE + "[]")
            # The last piece of a file has no brace behind it.
            text = text[:-1].rstrip(_SPACE + "[]") if text.endswith("}") else text
            if text:
                yield "record", text


# States that a range can begin in: between records, in a record, in a list or object of it, and deeper, which is relative.
_DEPTHS = (1, 2, 3, _DEEP)
_BEGINS = [(inside, depth) for inside in (False, True) for depth in _DEPTHS]


def _summaries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, ends): the state (inside a string, depth) that a range ends in, for each that it can begin in."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def done(key, scans) -> pa.RecordBatch:
        ends = [n for s in scans for n in (int(s.in_string), s.depth)]
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], schema=schema)

    key, scans = None, []
    for batch in it:
        for file, start, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "piece"))):
            if (file, start) != key:
                if key:
                    yield done(key, scans)
                key, scans = (file, start), [Scanner(*state) for state in _BEGINS]
            for scan in {id(s): s for s in scans}.values():
                for _ in scan.cut(piece):
                    pass
                scan.text.clear()
            # Scanners in the same state are one from here on: after a record's end there are few.
            one: dict[tuple, Scanner] = {}
            scans = [one.setdefault((s.in_string, s.depth), s) for s in scans]
    if key:
        yield done(key, scans)


def _begin_states(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state at the begin of each range of one file, from the ranges before it."""
    rows, inside, depth = [], False, 1
    for file, start, ends in ranges.sort_values("start")[["file", "start", "ends"]].itertuples(index=False):
        rows.append((file, start, inside, depth))
        at = _BEGINS.index((inside, depth if depth in _DEPTHS else _DEEP))
        end = int(ends[2 * at + 1])
        depth = max(1, end if depth in _DEPTHS else depth + end - _DEEP)
        inside = bool(ends[2 * at])
    return pd.DataFrame(rows, columns=["_file", "_start", "inside", "depth"])


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, kind, text) of the records and parts of records in each range."""
    key, scan, rows = None, Scanner(), []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["file", "start", "kind", "text"])

    for batch in it:
        columns = (batch.column(c).to_pylist() for c in ("file", "start", "piece", "inside", "depth"))
        for file, start, piece, inside, depth in zip(*columns):
            if (file, start) != key:
                rows += [(*key, *r) for r in scan.rest()] if key else []
                key, scan = (file, start), Scanner(inside, depth)
            rows += [(file, start, *r) for r in scan.cut(piece)]
        if rows:
            yield out()
            rows = []
    rows += [(*key, *r) for r in scan.rest()] if key else []
    if rows:
        yield out()


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record): the text of every element of UTF-8 files that hold a JSON array of objects each.

    Files are read by ranges, twice. The first pass finds the state that each range ends in, for the few that it can begin
    in; from that every range's begin follows, one row a range. The second pass cuts the ranges into records, and a record
    over a border is put together from its parts: the result is that of reading the file from front to back. Text that is
    no object is a record of its own, for the reader to reject; a broken record spoils itself only. A compressed file is
    one range.
    """
    states = _pieces(spark, path).mapInArrow(
        _summaries, "file string, start bigint, ends array<bigint>"
    ).groupBy("file").applyInPandas(_begin_states, "_file string, _start bigint, inside boolean, depth bigint")
    # A row for each range of at most maxPartitionBytes: under a hundred megabytes for a hundred terabytes.
    states = F.broadcast(materialize(states, "array-ranges"))
    pieces = _pieces(spark, path).join(states, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    cut = materialize(
        pieces.select("file", "start", "piece", "inside", "depth").mapInArrow(_cut, "file string, start bigint, kind string, text string"), "array-parts"
    )
    whole = cut.where("kind = 'record'").select("file", F.col("text").alias("record"))
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == "tail")
    parts = cut.where("kind <> 'record'").withColumn("_n", F.count_if(F.col("kind") == "tail").over(order))
    joined = parts.groupBy("file", "_n").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
    return whole.unionByName(joined.select("file", F.array_join("parts.text", "").alias("record")).where(F.trim("record") != ""))
