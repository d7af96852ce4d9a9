"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, calibrated votes.

The vocabulary is all terms of the examples. A term's weight is its TF-IDF times one plus the log-likelihood ratio of its
counts in both classes, counted over examples without their copies, so that terms that tell the classes apart decide
which examples are near; document frequencies are counted over all documents. Examples are kept in blocks of an inverted
index that also holds the largest weight of a term in each block: the blocks of highest possible score are visited first,
then those that can still improve the k nearest. The terms of most examples are dense columns as well, which are multiplied
as a matrix for many documents at a time: their part of a score is known before the bounds, which it makes tight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ticketlake.llm import words
from ticketlake.llm.common import BLOCK_BYTES, bounded_sample, fold, text_buffer, text_rows, text_slices
from ticketlake.llm.quality import _sigmoid, labelled_ids
from ticketlake.session import materialize

# Labelled examples of each class, examples in a block, neighbours that vote, blocks that a search scores first.
MAX_EXAMPLES, BLOCK, NEIGHBOURS, FIRST_BLOCKS = 4000, 64, 15, 4
# Terms that are dense columns (8 bytes an example each), documents multiplied with them at a time.
DENSE, QUERIES = 512, 64
#: A term that is reported as evidence speaks for label 1 beyond chance (log-likelihood ratio, one degree of freedom: a chance of 8e-6)
#: and strongly (odds ratio).
LEAST_RATIO, LEAST_ODDS = 20.0, 4.0
#: Examples of one label that agree in any of so many least shingles are compared: a pair at similarity 0.75 escapes with a
#: chance of 0.4 %. They are copies from this percentage of shared shingles on.
COPIES, ALIKE = 4, 75
_SPACES = bytes(c if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """Lower-case words: runs of letters and digits (and any character beyond ASCII)."""
    return text.lower().encode("utf-8", "replace").translate(_SPACES).split()


def _example_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each example, its word shingles, and the least of them under COPIES hash functions."""
    whole = pa.list_(pa.int64())
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("least", whole), ("shingles", whole), ("terms", pa.list_(pa.string()))])
    for batch in it:
        for part in text_slices(batch):
            sets = words.shingle_sets(*text_buffer(part.column("text")))
            least = [[int(words.mix(s + np.uint64(k)).min().view(np.int64)) if len(s) else k for k in range(1, COPIES + 1)] for s in sets]
            terms = [sorted(t.decode("utf-8") for t in set(terms_of(x.as_py()))) for x in part.column("text")]
            held = [pa.array(c, f.type) for c, f in zip((least, [s.view(np.int64) for s in sets], terms), list(schema)[2:])]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), *held], schema=schema)


def copies_among(ids: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """The ids whose set of shingles is at least ALIKE percent the same as that of a smaller id. Empty sets are the same."""
    order = np.argsort(ids, kind="stable")
    ids, sets = ids[order], [sets[i] for i in order.tolist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    out = []
    for n in range(len(ids)):
        fit = (100 * np.minimum(sizes[:n], sizes[n]) >= ALIKE * np.maximum(sizes[:n], sizes[n])) & (ids[:n] < ids[n])
        for m in np.flatnonzero(fit).tolist():
            both = len(np.intersect1d(sets[m], sets[n], assume_unique=True))
            if 100 * both >= ALIKE * (sizes[m] + sizes[n] - both):
                out.append(int(ids[n]))
                break
    return out


def _bucket_copies(bucket: pa.Table) -> pa.Table:
    sets = [np.array(s, np.int64) for s in bucket.column("shingles").to_pylist()]
    return pa.table({"id": pa.array(copies_among(bucket.column("id").to_numpy(), sets), pa.int64())})


def without_copies(examples: DataFrame) -> DataFrame:
    """id, y and distinct terms of the examples (id, y, text), without those that are near copies of one of their label with a smaller id."""
    found = examples.select("id", "y", "text").mapInArrow(_example_terms, "id bigint, y int, least array<bigint>, shingles array<bigint>, terms array<string>")
    found = materialize(found, "toxicity-found")
    agree = found.select("id", "y", "shingles", F.posexplode("least").alias("k", "value"))
    # Only examples whose least shingles are shared are sent. There are at most 8 * ``examples`` least shingles.
    shared = agree.groupBy("y", "k", "value").agg(F.countDistinct("id").alias("n")).filter("n > 1").drop("n")
    copy = agree.join(F.broadcast(shared), ["y", "k", "value"], "left_semi").groupBy("y", "k", "value").applyInArrow(_bucket_copies, "id bigint").distinct()
    return found.join(copy, "id", "left_anti").drop("least", "shingles")


def tally(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the vocabulary in each text, ascending, and their counts, one text after another, and where each text ends."""
    clean = pa.array([t.lower().encode("utf-8", "replace").translate(_SPACES) for t in texts.to_pylist()], pa.large_binary()).cast(pa.large_string())
    split = pc.ascii_split_whitespace(clean)
    found = split.flatten().dictionary_encode()
    place = pc.index_in(found.dictionary, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    term = place[found.indices.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    key, counts = np.unique((text * len(vocabulary) + term)[term >= 0], return_counts=True)
    text, term = np.divmod(key, max(len(vocabulary), 1))
    return term.astype(np.int32), counts.astype(np.int32), np.searchsorted(text, np.arange(1, len(texts) + 1))


def tallied(batch: pa.RecordBatch, vocabulary: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each text of a batch."""
    out = []
    for part in text_slices(batch, 4 * BLOCK_BYTES):
        terms, counts, ends = tally(part.column("text"), vocabulary)
        out += zip(np.split(terms, ends[:-1]), np.split(counts, ends[:-1]))
    return out


def _vectors(vocabulary: pa.Array):
    schema = pa.schema([("id", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            both = tallied(batch, vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([b[k] for b in both], schema[1].type) for k in (0, 1))], schema=schema)

    return run, "id bigint, terms array<int>, counts array<int>"


def _frequencies(vocabulary: pa.Array):
    """Documents of a task that hold each term of the vocabulary, and all its documents as term -1."""
    schema = pa.schema([("t", pa.int32()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in it:
            seen[-1] += len(batch)
            for part in text_slices(batch, 4 * BLOCK_BYTES):
                seen[:-1] += np.bincount(tally(part.column("text"), vocabulary)[0], minlength=len(vocabulary))
        held = np.flatnonzero(seen)
        terms = np.where(held == len(vocabulary), -1, held).astype(np.int32)
        for i in range(0, len(held), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 100_000]), pa.array(seen[held[i : i + 100_000]])], schema=schema)

    return run, "t int, n bigint"


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


@dataclass
class BlockMaxIndex:
    """Unit TF-IDF vectors of the examples. Postings (``rows``, ``weights``) lie by term, then example. An entry is the
    postings of one term in one block: ``entries[t]`` is the first entry of term t, ``places[e]`` the first posting of
    entry e (both with an end), ``blocks[e]`` its block and ``tops[e]`` its largest weight. ``dense[column[t]]`` are the
    weights of term t in all examples if it is one of the DENSE terms of most examples; ``column[t]`` is -1 for others."""

    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    entries: np.ndarray
    places: np.ndarray
    blocks: np.ndarray
    tops: np.ndarray
    block: int
    column: np.ndarray
    dense: np.ndarray

    @staticmethod
    def build(idf: np.ndarray, examples: list[tuple[int, int, list[int], list[int]]], block: int = BLOCK) -> "BlockMaxIndex":
        """``examples`` are (id, label, terms, counts); those without terms are left out. Neighbours share blocks: examples
        are ordered by their heaviest term."""
        held = []
        for i, y, terms, counts in examples:
            if len(terms):
                w = weigh(idf, terms, counts)
                held.append((int(terms[int(w.argmax())]), i, y, np.array(terms, np.int64), w))
        held.sort(key=lambda e: (e[0], e[1]))
        joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        terms, weights = joined([e[3] for e in held], np.int64), joined([e[4] for e in held], np.float64)
        rows = np.repeat(np.arange(len(held)), [len(e[3]) for e in held])
        order = np.lexsort((rows, terms))
        terms, rows, weights = terms[order], rows[order], weights[order]
        key = terms * (len(held) // block + 1) + rows // block
        places = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        most = np.argsort(-np.bincount(terms, minlength=len(idf)), kind="stable")[:DENSE]
        column = np.full(len(idf), -1)
        column[most] = np.arange(len(most))
        dense, common = np.zeros((len(most), len(held))), column[terms] >= 0
        dense[column[terms[common]], rows[common]] = weights[common]
        return BlockMaxIndex(
            idf, np.array([e[1] for e in held], np.int64), np.array([e[2] for e in held], np.int64), rows, weights,
            np.searchsorted(terms[places], np.arange(len(idf) + 1)), np.append(places, len(terms)), rows[places] // block,
            np.maximum.reduceat(weights, places) if len(places) else weights, block, column, dense,
        )

    def nearest(self, terms: list[int], counts: list[int], k: int, without: int | None = None) -> list[tuple[float, int]]:
        """The k examples of highest cosine above 0, as (cosine, row), by cosine, then row. ``without`` is an id to leave out."""
        return self.nearest_of([(terms, counts)], k, None if without is None else [without])[0]

    def nearest_of(self, documents: list[tuple], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """``nearest`` of many documents (terms, counts), each without the id of its place in ``without``."""
        out: list[list[tuple[float, int]]] = []
        if not len(self.ids):
            return [[] for _ in documents]
        starts = np.arange(0, len(self.ids), self.block)
        for at in range(0, len(documents), QUERIES):
            rest, parts = [], np.zeros((min(QUERIES, len(documents) - at), len(self.dense)))
            for part, (terms, counts) in zip(parts, documents[at : at + QUERIES]):
                t = np.asarray(terms, np.int64)
                q, column = weigh(self.idf, t, counts) if len(t) else np.zeros(0), self.column[t]
                part[column[column >= 0]] = q[column >= 0]
                rest.append((t[column < 0], q[column < 0]))
            scores = parts @ self.dense
            highest = np.maximum.reduceat(scores, starts, axis=1)
            for n, (t, q) in enumerate(rest):
                out.append(self._search(t, q, scores[n], highest[n], k, None if without is None else without[at + n]))
        return out

    def _search(self, t: np.ndarray, q: np.ndarray, score: np.ndarray, highest: np.ndarray, k: int, without: int | None) -> list[tuple[float, int]]:
        """``score`` is what dense columns add to each example, ``highest`` its largest value in each block; t and q are other terms."""
        low, high = self.entries[t], self.entries[t + 1]
        entries = _ranges(low, high)
        q, blocks = np.repeat(q, high - low), self.blocks[entries]
        bound = highest + np.bincount(blocks, q * self.tops[entries], minlength=len(highest))
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int]] = []
        for some in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            least = -best[-1][0] - 1e-12 if len(best) == k else 0.0
            some = some[(bound[some] > 0) & (bound[some] >= least)]
            if not len(some):
                break
            wanted = np.zeros(len(bound), bool)
            wanted[some] = True
            hit = np.flatnonzero(wanted[blocks])
            low, high = self.places[entries[hit]], self.places[entries[hit] + 1]
            p = _ranges(low, high)
            full = score + np.bincount(self.rows[p], np.repeat(q[hit], high - low) * self.weights[p], minlength=len(score))
            if without is not None:
                full[self.ids == without] = 0
            found = np.flatnonzero((full > 0) & (full >= least))
            found = found[wanted[found // self.block]]
            full = full[found].round(12)
            if len(found) > k:
                high = full >= np.partition(full, -k)[-k]
                found, full = found[high], full[high]
            best = sorted(best + [(-s, r) for s, r in zip(full.tolist(), found.tolist()) if s > 0])[:k]
        return [(-s, r) for s, r in best]

    def vote(self, neighbours: list[tuple[float, int]]) -> float:
        """Share of label 1, each neighbour weighted by the inverse of its cosine distance."""
        w = np.array([1.0 / (1.05 - min(s, 1.0)) for s, _ in neighbours])
        return float((w * self.labels[[r for _, r in neighbours]]).sum() / w.sum())


def weigh(idf: np.ndarray, terms: list[int], counts: list[int]) -> np.ndarray:
    w = (1.0 + np.log(np.array(counts, np.float64))) * idf[terms]
    return w / np.sqrt((w * w).sum())


def class_ratios(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio of each term's counts among n1 and n0 examples of both classes, and its odds ratio for label 1."""
    def part(n: np.ndarray, total: float, share: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / np.maximum(total * share, 1e-9)), 0.0)

    share = (a + b) / max(n1 + n0, 1.0)
    ratio = 2 * (part(a, n1, share) + part(b, n0, share) + part(n1 - a, n1, 1 - share) + part(n0 - b, n0, 1 - share))
    odds = (a + 0.5) / (n1 - a + 0.5) * (n0 - b + 0.5) / (b + 0.5)
    return np.maximum(ratio, 0.0).round(6), odds


def calibrate(votes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over the votes, fitted by Newton steps with a weak ridge; the slope is at least 0."""
    a, b = 1.0, 0.0
    x = np.stack([votes - 0.5, np.ones(len(votes))])
    for _ in range(50):
        p = _sigmoid(a * x[0] + b)
        g = x @ (weight * (p - y)) + 1e-2 * np.array([a, b])
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))) @ x.T + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        a, b = max(0.0, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


@dataclass
class Examples:
    """Counted terms of the examples, one after another, and where each example ends: what tasks are sent, a tenth of the
    index, which they build."""

    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    ends: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    def index(self) -> BlockMaxIndex:
        cuts = self.ends[:-1]
        return BlockMaxIndex.build(self.idf, list(zip(self.ids.tolist(), self.labels.tolist(), np.split(self.terms, cuts), np.split(self.counts, cuts))))


def _votes(examples: Examples, k: int):
    """The vote on each example by the others; null if it has no neighbours."""
    schema = pa.schema([("id", pa.int64()), ("vote", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = examples.index()
        for batch in it:
            columns = [batch.column(n).to_pylist() for n in ("id", "terms", "counts")]
            near = index.nearest_of(list(zip(*columns[1:])), k, columns[0])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([index.vote(n) if n else None for n in near], pa.float64())], schema=schema)

    return run, "id bigint, vote double"


def _score(examples: Examples, curve: tuple[float, float], nothing: float, k: int, vocabulary: pa.Array, evidence: dict[int, str]):
    schema = pa.schema([
        ("id", pa.int64()), ("score", pa.float64()), ("nearest", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64())),
        ("matched", pa.list_(pa.string())),
    ])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = examples.index()
        for batch in it:
            # Documents of the same counted terms are searched once.
            both = tallied(batch, vocabulary)
            keys = [np.concatenate(b).tobytes() for b in both]
            distinct = dict(zip(keys, both))
            seen: dict[bytes, tuple] = {}
            for (key, (terms, _)), near in zip(distinct.items(), index.nearest_of(list(distinct.values()), k)):
                score = float(_sigmoid(curve[0] * (index.vote(near) - 0.5) + curve[1])) if near else nothing
                seen[key] = (score, [int(index.ids[r]) for _, r in near], [s for s, _ in near], [evidence[t] for t in terms.tolist() if t in evidence])
            out = [seen[key] for key in keys]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[1:]))], schema=schema)

    return run, "id bigint, score double, nearest array<bigint>, cosines array<double>, matched array<string>"


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", parts: int = 3, held: int = 1,
    examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS,
) -> DataFrame:
    """One row per document: id, held_out, score, predicted, nearest (ids of the neighbours), cosines, matched (terms).

    Learns from at most ``examples`` labelled rows of each class outside the held-out part, those with the smallest
    hashes of their ids (of copies among them one), and from all their terms. Votes are calibrated on the examples, each
    without itself, weighted back to the class sizes. ``matched`` are the terms of the document that speak for label 1.
    A document that shares no term with any example has no neighbours and gets the share of label 1 among such examples,
    or among all if there are none. Null or empty texts are such documents. Rows that repeat an id are scored
    each by its own text; a row without id is never held out. Without labels of both classes no term separates them and
    every score is the smoothed rate (0.5 without labels). Other columns are ignored; an empty table gives an empty result.
    """
    source = text_rows(docs, id_col, text_col)
    known = materialize(labelled_ids(labels, label, parts, held), "toxicity-labelled")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = bounded_sample(known.filter(F.col("y") == y), "id", examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * ``examples`` ids: small enough to send to every executor.
    chosen = F.broadcast(materialize(chosen, "toxicity-chosen"))
    found = materialize(without_copies(source.join(chosen, "id")), "toxicity-examples")
    terms = found.select("y", F.explode("terms").alias("term"))
    chosen = F.broadcast(found.select("id", "y").distinct())
    found = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(found.get(1, 0)), float(found.get(0, 0))
    counted = terms.groupBy("term").agg(F.sum("y").alias("a"), F.count("*").alias("n")).orderBy("term").toArrow() if n1 and n0 else None
    vocabulary = counted.column("term").to_pylist() if counted else []
    a, n = (counted.column(c).to_numpy().astype(np.float64) for c in ("a", "n")) if counted else (np.zeros(0), np.zeros(0))
    ratio, odds = class_ratios(a, n - a, n1, n0)
    evidence = {t: vocabulary[t] for t in np.flatnonzero((ratio >= LEAST_RATIO) & (odds >= LEAST_ODDS)).tolist()}
    places = pa.array(vocabulary, pa.large_string())
    run, schema = _frequencies(places)
    counted = source.mapInArrow(run, schema).groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    which, number = counted.column("t").to_numpy(), counted.column("n").to_numpy()
    total, seen = int(number[which < 0].sum()), np.zeros(len(vocabulary))
    seen[which[which >= 0]] = number[which >= 0]
    idf = (np.log((1.0 + total) / (1.0 + seen)) + 1.0) * (1.0 + ratio)
    run, schema = _vectors(places)
    taught = materialize(source.join(chosen.select("id"), "id").mapInArrow(run, schema).join(chosen, "id"), "toxicity-taught")
    columns = taught.toArrow()
    sample = [(i, y, t.values.to_numpy(), c.values.to_numpy()) for i, y, t, c in zip(
        columns["id"].to_pylist(), columns["y"].to_pylist(), columns["terms"], columns["counts"]
    )]
    sample.sort(key=lambda e: (e[0], e[1], e[2].tolist(), e[3].tolist()))
    joined = lambda k: np.concatenate([np.zeros(0, np.int32), *(e[k] for e in sample)])
    ids, label = (np.array([e[k] for e in sample], np.int64) for k in (0, 1))
    taught_by = Examples(idf, ids, label, np.cumsum([len(e[2]) for e in sample]), joined(2), joined(3))
    taken = {y: max(1, sum(s[1] == y for s in sample)) for y in (0, 1)}
    weight = {y: sizes.get(y, 0) / taken[y] for y in (0, 1)}
    run, schema = _votes(taught_by, k)
    label_of = {i: y for i, y, *_ in sample}
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    votes = sorted((r["vote"], label_of[r["id"]], weight[label_of[r["id"]]]) for r in taught.repartition(tasks).mapInArrow(run, schema).collect() if r["vote"] is not None)
    bare = [(y, weight[y]) for _, y, t, _ in sample if not len(t)] or [(y, weight[y]) for _, y, *_ in sample]
    nothing = (sum(w for y, w in bare if y) + 0.5) / (sum(w for _, w in bare) + 1.0)
    curve = calibrate(*(np.array(c, np.float64) for c in zip(*votes))) if votes else (0.0, float(np.log(nothing / (1 - nothing))))
    run, schema = _score(taught_by, curve, nothing, k, places, evidence)
    return source.mapInArrow(run, schema).select(
        F.col("id").alias(id_col), F.coalesce(fold("id", parts) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "nearest", "cosines", "matched",
    )
