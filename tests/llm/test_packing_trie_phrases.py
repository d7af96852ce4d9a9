"""Residual packing, the prefix trie and phrase mining against round trips and brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.llm import collocations, prefix_trie, residual_packing
from ticketlake.llm.common import table

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def encoder():
    return residual_packing.WordEncoder(residual_packing.public_path())


def test_ids_are_those_of_the_tokenizer(encoder):
    rng = random.Random(1)
    signs = "aB'sS.,;:!?-)( \n\t\r\x0b\x1c\x85\xa0éÉΣσ´̸́İ9½²_<|>ßあ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["x<|endoftext|>y, <|endoftext|>", "it's, don't! we're;", "", " ", "word " * 5000, "q" * 500, "Zebra zebra ZEBRA."]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.ids(texts) == want
    assert encoder.ids(texts) == want  # from the kept pieces


def test_kept_pieces_are_bounded(encoder, monkeypatch):
    monkeypatch.setattr(residual_packing, "_KEPT", 50)
    small = residual_packing.WordEncoder(residual_packing.public_path())
    for part in range(5):
        texts = [" ".join(f"{w}{'abcdefghij'[i % 10]}" for i, w in enumerate(["alpha", "beta", "gamma"] * 9)), f"only{'xyz' * part} here."]
        assert small.ids(texts) == encoder.ids(texts)


def packed(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("group_items", [50_000, 3])
def test_packing_round_trip(spark, encoder, group_items):
    rng = np.random.default_rng(3)
    texts = {i: " ".join(f"w{rng.integers(300)}" for _ in range(int(rng.integers(1, 60)))) for i in range(200)}
    texts |= {900: None, 901: "", 902: "long " * 300}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(7)
    rows = packed(residual_packing.pack_best_fit(df, size=64, group_items=group_items))
    by_doc, by_seq = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 64
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        whole = encoder.ids([texts[doc] or ""])[0] + bytes(4)
        assert b"".join(p["ids"] for p in pieces) == whole
        assert [(p["piece"], p["start"]) for p in pieces] == [(i, 64 * i) for i in range(len(pieces))]
        assert all(p["length"] == 64 for p in pieces[:-1])
    total = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for p in pieces:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64
        total += at
    if group_items > 3:
        # Best fit in descending order over all pieces at once.
        room = []
        for n in sorted((r["length"] for r in rows), reverse=True):
            fit = min((i for i, x in enumerate(room) if x >= n), key=lambda i: room[i], default=None)
            if fit is None:
                room.append(64 - n)
            else:
                room[fit] -= n
        assert len(by_seq) <= 1.05 * len(room) + 1


def test_merge_keeps_order_inside(spark):
    rows = [(1, 30), (2, 30), (3, 20), (4, 10), (5, 64), (6, 34)]
    moves = {r["bin"]: (r["into"], r["shift"]) for r in residual_packing.merge_underfull(spark.createDataFrame(rows, "bin bigint, fill bigint"), 64).collect()}
    fill = dict(rows)
    ends = Counter()
    for b, n in rows:
        ends[moves.get(b, (b, 0))[0]] += n
    assert all(n <= 64 for n in ends.values()) and len(ends) == 3
    for into in {m[0] for m in moves.values()}:
        inside = sorted([(0, fill[into])] + [(s, fill[b]) for b, (i, s) in moves.items() if i == into])
        assert all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:]))


def test_packing_cases(spark):
    rows = [(1, "same", 1, 2), (1, "same", 3, 4), (None, "no id", 5, 6), (2, "word " * 60_000, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fill bigint, bin bigint")
    got = residual_packing.pack_best_fit(df)
    assert got.filter("piece = 0").count() == 4 and got.filter("doc_id = 2").agg(F.sum("length")).first()[0] == 60_001
    assert got.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    assert residual_packing.pack_best_fit(df.limit(0)).count() == 0


# ---- prefix trie ------------------------------------------------------------------------------


def brute_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()[:16]))
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = [t[1:] for t in own.get(c - int(math.fmod(c, 5)), [])[:h]] + [t[1:] for t in own[c][h:]]
    members, kids = {}, {}
    for c, path in full.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(full[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("cells", [1 << 27, 64])
def test_trie_equals_brute_force(spark, cells):
    """Conversations of few different turns, absent bases, ties, nulls, repeated rows; a tiny sketch is full of collisions."""
    rng = random.Random(5)
    rows = []
    for c in [*range(-7, 60), 99, 4096, 8193]:
        if c % 7 == 3:
            continue
        for turn in range(rng.choice([1, 2, 5, 12])):
            rows.append((c, rng.choice([turn, turn, None, 1]), rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "bé", None])))
    rows += [(200 + 5 * i, t, "user", "same") for i in range(40) for t in range(4)] + rows[:5] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = [tuple(r) for r in prefix_trie.prefix_trie(df, cells).collect()]
    assert sorted(got, key=str) == brute_trie(rows)


def test_sketch_never_takes_a_shared_prefix_for_single(spark):
    rows = [(i, t, "u", f"{i // 3}-{t}") for i in range(0, 3000, 5) for t in range(4)]
    paths = prefix_trie.prefixes(spark.createDataFrame(rows, TURNS)).cache()
    checked = prefix_trie.screened(spark, paths)
    counts = checked.groupBy("digest").count()
    assert checked.filter("alone").join(counts, "digest").filter("count > 1").count() == 0
    assert checked.filter("alone").count() > 0


def test_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "END_BLOCK", 7)
    rows = [(5 * i, 0, "u", "hello") for i in range(100)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).filter("depth = 1").first()
    assert got["ends_sha256"] == hashlib.sha256(",".join(str(5 * i) for i in range(100)).encode()).hexdigest()


def test_trie_cases(spark):
    df = spark.createDataFrame([(1, None, None, None, 5, "x")], f"{TURNS}, depth int, digest string")
    got = sorted(tuple(r) for r in prefix_trie.prefix_trie(df).drop("parent_conv_id").collect())
    want = sorted(t[:2] + t[3:] for t in brute_trie([(1, None, None, None)]))
    assert got == want
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    long = spark.createDataFrame([(5, t, "u", "y" * 100_000 if t == 3 else "z") for t in range(3000)], TURNS)
    assert prefix_trie.prefix_trie(long).count() == 3001


# ---- phrases ----------------------------------------------------------------------------------


def brute_phrases(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or ("und" if lang is None else lang)
        counts = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                counts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        dropped = {
            q[i : i + k] for q, b in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 80 * candidates[q[i : i + k]]
        }
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"max_words": 4, "range_rows": 5}, {"range_rows": 3}, {"max_words": 0, "top": 7}])
def test_phrases_equal_brute_force(spark, settings):
    """A few words in all orders, control characters in words, numbers for few or no words, ranges of a few phrases."""
    rng = random.Random(2)
    words = ["A", "b", "é", "É", "x\x01y", "of", "Of", "the", "a\x1fb", "日本", "-", "w" * 80]
    texts = []
    for i in range(150):
        parts = [rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", "\r\n", " ?"]) for _ in range(rng.randrange(40))]
        texts.append((rng.choice(["en", "en", "fr", None]), "".join(parts)))
    texts += [("en", None), ("en", ""), ("xx", "..,"), (None, "one")] + [("en", "new york city hall stays open")] * 12 + [("fr", "b é " * 400)]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(6)
    got = collocations.mine_phrases(df, min_count=4, **settings).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(texts, 4, settings.get("top", 2000))


def test_phrase_cases(spark):
    rows = [("en", "red car " * 40, 1, "z")] * 3
    df = spark.createDataFrame(rows, "lang string, text string, n int, words string")
    got = collocations.mine_phrases(df).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases([r[:2] for r in rows], 30, 2000)
    assert collocations.mine_phrases(df.limit(0)).count() == 0
    assert collocations.mine_phrases(spark.createDataFrame([("en", "word " * 60_000)], "lang string, text string")).count() == 1


@needs_tables
def test_queries_give_the_contract_columns(spark):
    from ticketlake.llm.queries import QUERIES

    pieces = QUERIES["op11_residual_packing"](spark, SF)
    assert pieces.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert dict(pieces.dtypes)["piece"] == "int"
    assert pieces.filter("piece = 0").count() == table(spark, SF, "documents").count()
    nodes = QUERIES["op12_prefix_trie"](spark, SF)
    assert {t for c, t in nodes.dtypes if c != "ends_sha256"} == {"bigint"} and nodes.filter("depth = 0").count() == 1
    assert [t for _, t in QUERIES["op13_collocations"](spark, SF).dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5


# ---- licence expressions and nested pages -----------------------------------------------------


@pytest.mark.parametrize("text,labels,permissive", [
    ("see LICENSE file", None, None), ("MIT and more text", {"mit"}, True), ("GPL-2.0 WITH Linux-syscall-note", {"gpl"}, False),
    ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl"}, True), ("MIT OR Foo-1.0", None, None), ("MIT with thanks", {"mit"}, True),
    ("(MIT and more", None, None), ("LicenseRef-Own. */", {"licenseref-own"}, False), ("Mitigation", None, None), ("MIT WITH", None, None),
    ("(MIT OR GPL-3.0) AND 0BSD", {"mit", "gpl", "bsd"}, True),
])
def test_expressions_beside_free_text(text, labels, permissive):
    from ticketlake.llm import licences

    rpn = licences.parse_expression(text)
    assert (rpn and licences.evaluate(rpn)) == (labels and (labels, permissive))


def test_deeply_nested_pages_are_linear():
    import time

    from ticketlake.llm import html_text

    for page in ("<div>" * 40_000, "<div><p>x</b>" * 40_000, "<li>" * 40_000 + "</p>" * 40_000, "<svg>" * 40_000 + "<g/>" * 40_000):
        begin = time.process_time()
        html_text.parse(page)
        assert time.process_time() - begin < 5


def test_quality_stage_with_clashing_columns(spark):
    from ticketlake.llm import quality

    docs = spark.createDataFrame([(1, "a b", 1, 2, 3)], "doc_id bigint, text string, _known int, _q_n int, _s int")
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    kept = quality.keep_quality(docs, labels, least=0.0)
    assert kept.columns == docs.columns and kept.count() == 1
