"""JSON arrays cut at any byte: the records of a plain parser, and broken records that spoil themselves only."""

import json
import random

import pandas as pd
import pytest

from ticketlake.sources import arrays, tickets


def value(rng, depth=0):
    kind = rng.randrange(7)
    if kind < 3:
        return "".join(rng.choice('ab"\\{}[],: \n\té') for _ in range(rng.randrange(30)))
    if kind == 3:
        return rng.random()
    if kind == 4 or depth == 3:
        return rng.choice([None, True, 7])
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}


def cut(ranges):
    """What the two passes make of one file's pieces, range by range."""
    ends = []
    for n, pieces in enumerate(ranges):
        states = []
        for begin in arrays._BEGINS:
            scan = arrays.Scanner(*begin)
            for p in pieces:
                list(scan.cut(p))
            states += [int(scan.in_string), scan.depth]
        ends.append(("f", n, states))
    begins = arrays._begin_states(pd.DataFrame(ends, columns=["file", "start", "ends"]))
    records, part = [], ""
    for pieces, (_, _, inside, depth) in zip(ranges, begins.itertuples(index=False)):
        scan = arrays.Scanner(inside, depth)
        for kind, text in [r for p in pieces for r in scan.cut(p)] + list(scan.rest()):
            if kind == "record":
                records.append(text)
            elif kind == "head":
                records.append(part + text)
            else:
                part = text if kind == "tail" else part + text
    return records


def test_records_at_any_cut():
    rng = random.Random(1)
    for _ in range(500):
        rows = [{f"f{i}": value(rng) for i in range(rng.randrange(6))} for _ in range(6)]
        pieces = json.dumps(rows, indent=rng.choice([None, 2]), ensure_ascii=False).split("}")
        at = [0, *sorted(rng.sample(range(1, len(pieces)), min(4, len(pieces) - 1))), len(pieces)]
        assert [json.loads(r) for r in cut([pieces[a:b] for a, b in zip(at, at[1:])])] == rows


@pytest.mark.parametrize("most", ["10m", "300", "64"])
def test_files_in_small_ranges(spark, tmp_path, most):
    rng = random.Random(2)
    want = []
    for n, size in enumerate([0, 40, 15]):
        rows = [{f"f{i}": value(rng) for i in range(rng.randrange(6))} for _ in range(size)]
        want += rows
        (tmp_path / f"{n}.json").write_text(json.dumps(rows, ensure_ascii=n == 1))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert most == "10m" or spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = [json.loads(r["record"]) for r in arrays.array_records(spark, str(tmp_path)).collect()]
    finally:
        for name, old in before.items():
            spark.conf.set(name, old)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_broken_records(spark, tmp_path):
    """A lost quote, lost braces, a stray brace, a lost bracket and a number among records."""
    text = '[{"a":1},\n{"a":"x},\n{"a":3},\n{"a":4,\n{"a":[5,"}"]},{"a":["q"}, {"a":6}},\n 7, {"a":8}]'
    (tmp_path / "a.json").write_text(text)
    found = []
    for r in arrays.array_records(spark, str(tmp_path)).collect():
        try:
            found.append(json.loads(r["record"]))
        except json.JSONDecodeError:
            continue
    assert sorted(f["a"] for f in found if isinstance(f, dict) and not isinstance(f["a"], list)) == [1, 3, 6, 8]
    assert {"a": [5, "}"]} in found


def test_array_equals_lines(spark, tmp_path):
    rows = [{"ticket_id": str(i), "subject": f"s{i} }}{{", "tags": ["a", "]"], "category": None if i % 3 else "c"} for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)))
    array, line = (tickets.read_tickets(spark, str(tmp_path / f), layout) for f, layout in (("a.json", "array"), ("l.json", "lines")))
    assert sorted(map(str, array.collect())) == sorted(map(str, line.collect())) and array.count() == 50
