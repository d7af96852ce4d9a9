"""Quality classifier: tree paths over text statistics as rules, lasso logistic weights, Spark column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.llm.common import bounded_sample, fold
from ticketlake.session import materialize

# Labelled rows that the rules are fitted on, at most.
MAX_LABELLED = 20_000
TREES, DEPTH, RULES = 30, 3, 240
STATISTICS = (
    "n_words", "word_length", "distinct_share", "distinct_root", "upper_share", "symbol_share", "bar_share", "digit_share",
    "stop_share", "line_words",
)


def _counts(text: Column, words: Column) -> dict[str, Column]:
    """What the statistics are computed from, of a text and its words."""
    return {
        "chars": F.length(text), "n": F.size(words), "distinct": F.size(F.array_distinct(words)),
        "upper": F.regexp_count(text, F.lit(r"[A-ZÀ-ÖØ-Þ]")), "symbols": F.regexp_count(text, F.lit(r"[#$%&*!<>{}@~^=\[\]]")),
        "bars": F.regexp_count(text, F.lit(r"\|")), "digits": F.regexp_count(text, F.lit("[0-9]")),
        "stops": F.regexp_count(text, F.lit("[.,]")), "lines": F.regexp_count(text, F.lit(r"\n")) + 1,
    }


def _ratios(count: Callable[[str], Column]) -> dict[str, Column]:
    """The statistics, by name, from the counts that ``count`` gives."""
    chars, n = F.greatest(count("chars"), F.lit(1)), F.greatest(count("n"), F.lit(1))
    values = {
        "n_words": count("n"), "word_length": count("chars") / n, "distinct_share": count("distinct") / n,
        "distinct_root": count("distinct") / F.sqrt(n), "upper_share": count("upper") / chars,
        "symbol_share": count("symbols") / chars, "bar_share": count("bars") / n, "digit_share": count("digits") / chars,
        "stop_share": count("stops") / n, "line_words": count("n") / count("lines"),
    }
    return {k: c.cast("double") for k, c in values.items()}


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "_") -> DataFrame:
    """``docs`` with one column for each statistic, named with ``prefix``, by JVM functions only. All are 0 for a null or empty text."""
    p = prefix
    df = docs.withColumn(f"{p}list", _words(_text(text_col)))
    counts = _counts(_text(text_col), F.col(f"{p}list"))
    df = df.withColumns({p + k: c for k, c in counts.items()}).drop(f"{p}list")
    df = df.withColumns({p + k: c for k, c in _ratios(lambda k: F.col(p + k)).items()})
    return df.drop(*(p + k for k in counts))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it and wherever the plan moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def statistics(text_col: str = "text") -> Column:
    """The statistics of ``with_statistics`` as one struct, without helper columns."""
    def ratios(counts: Column) -> Column:
        return F.struct(*(c.alias(k) for k, c in _ratios(lambda k: counts[k]).items()))

    text = _text(text_col)
    return bound(bound(_words(text), lambda w: F.struct(*(c.alias(k) for k, c in _counts(text, w).items()))), ratios)


Condition = tuple[int, bool, float]  # statistic, above (or at most), limit


@dataclass
class RuleModel:
    """Weighted conjunctive rules; ``rules[i]`` holds if all its conditions do."""

    rules: list[tuple[Condition, ...]]
    weights: list[float]
    intercept: float

    def score(self, statistic: Callable[[str], Column] = lambda name: F.col("_" + name)) -> Column:
        """Probability of label 1 as a column expression over the statistics that ``statistic`` gives by name."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            held = F.lit(True)
            for k, above, limit in rule:
                column = statistic(STATISTICS[k])
                held = held & ((column > limit) if above else (column <= limit))
            total = total + F.when(held, float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.intercept + _hold(self.rules, x) @ np.array(self.weights, np.float64)) if self.rules else np.full(len(x), _sigmoid(self.intercept))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _hold(rules: list[tuple[Condition, ...]], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for k, above, limit in rule:
            out[:, j] *= x[:, k] > limit if above else x[:, k] <= limit
    return out


def _grow(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple, found: list, out: np.ndarray) -> None:
    """Regression tree on the rows; every node's path is a rule, and ``out`` gets the leaf means."""
    t = target[rows]
    out[rows] = t.mean()
    if depth == 0 or len(rows) < 20:
        return
    best = (1e-9, -1, 0.0)
    base = t.sum() ** 2 / len(t)
    for k, limits in enumerate(cuts):
        if not len(limits):
            continue
        bins = np.searchsorted(limits, x[rows, k], "left")
        n = np.cumsum(np.bincount(bins, minlength=len(limits) + 1))[:-1]
        s = np.cumsum(np.bincount(bins, t, minlength=len(limits) + 1))[:-1]
        rest = len(t) - n
        ok = (n >= 5) & (rest >= 5)
        gain = np.where(ok, s**2 / np.maximum(n, 1) + (t.sum() - s) ** 2 / np.maximum(rest, 1) - base, 0)
        at = int(gain.argmax())
        if gain[at] > best[0] * (1 + 1e-9):
            best = (float(gain[at]), k, float(limits[at]))
    if best[1] < 0:
        return
    _, k, limit = best
    right = x[rows, k] > limit
    for above, part in ((False, rows[~right]), (True, rows[right])):
        step = (*path, (k, above, limit))
        found.append(step)
        _grow(x, target, cuts, part, depth - 1, step, found, out)


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, limit: int = RULES, seed: int = 7) -> list[tuple[Condition, ...]]:
    """Distinct paths of boosted trees, each grown on half of the rows, in the order in which they are found."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64)))for k in range(x.shape[1])]
    rate = np.clip(y.mean(), 0.01, 0.99)
    z = np.full(len(y), np.log(rate / (1 - rate)))
    rules: dict[tuple, None] = {}
    for _ in range(trees):
        grad = y - _sigmoid(z)
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        found: list = []
        _grow(x, grad, cuts, rows, depth, (), found, np.zeros(len(y)))
        # The step goes to all rows, so later trees see what is left.
        if found:
            leaves = [p for p in found if not any(q[: len(p)] == p and len(q) > len(p) for q in found)]
            for p, held in zip(leaves, _hold(leaves, x).T.astype(bool)):
                inside = held[rows]
                if inside.any():
                    z[held] += 2.0 * grad[rows][inside].mean()
        for p in found:
            rules.setdefault(tuple(sorted(set(p))), None)
    return list(rules)[:limit]


def fit_lasso(h: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights with an absolute-value penalty, by accelerated proximal gradient steps."""
    n = len(y)
    scale = max(1e-9, 0.25 * float(np.linalg.norm(h.astype(np.float64).T @ h / n, 2) + 1.0))
    w, b = np.zeros(h.shape[1]), 0.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = _sigmoid(h @ v.astype(np.float32) + c) - y
        nw = v - (h.T @ error.astype(np.float32)).astype(np.float64) / n / scale
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / scale, 0)
        nb = c - float(error.mean()) / scale
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rule ensemble on statistics ``x`` and labels ``y``. The strongest penalty whose loss on a fifth of the rows is within
    a hundredth of the best is used. One class only, or no rows: no rules, and the smoothed rate as score (0.5 for none)."""
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    if len(np.unique(y)) < 2 or len(y) < 40:
        return RuleModel([], [], float(np.log(rate / (1 - rate))))
    rules = extract_rules(x, y)
    if not rules:
        return RuleModel([], [], float(np.log(rate / (1 - rate))))
    h = _hold(rules, x)
    test = np.arange(len(y)) % 5 == 0
    tried = []
    for penalty in (3e-2, 1e-2, 3e-3, 1e-3, 3e-4):
        w, b = fit_lasso(h[~test], y[~test], penalty)
        p = np.clip(_sigmoid(h[test] @ w + b), 1e-6, 1 - 1e-6)
        tried.append((float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()), penalty))
    best = min(tried)[0]
    w, b = fit_lasso(h, y, max(penalty for loss, penalty in tried if loss <= best * 1.01 + 1e-4), 600)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([rules[i] for i in kept], [float(w[i]) for i in kept], float(b))


def labelled_ids(labels: DataFrame, label: str, parts: int, held: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of the labelled ids outside the held-out part: the larger label of an id that has several; null ids and
    labels other than 0 and 1 are left out."""
    return labels.filter(
        F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold(id_col, parts) != held)
    ).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(label).cast("int").alias("y"))


def fit_quality(
    statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", prefix: str = "_", parts: int = 4,
    held: int = 2, limit: int = MAX_LABELLED,
) -> RuleModel:
    """Fits on at most ``limit`` labelled rows, those with the smallest hashes of their ids."""
    known = labelled_ids(labels, label, parts, held)
    rows = statistics.select(F.col(id_col).cast("bigint").alias("id"), *(F.col(prefix + s).alias(s) for s in STATISTICS)).join(known, "id")
    rows = bounded_sample(rows, "id", limit).toPandas().sort_values(["id", *STATISTICS])
    return fit_rules(rows[list(STATISTICS)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 4, held: int = 2, limit: int = MAX_LABELLED) -> DataFrame:
    """One row per document: id, held_out, score, predicted, and the statistics.

    The statistics of every whole text are computed once and written; the rules are fitted on a bounded sample of them
    and applied as column expressions. Null or empty texts have zero statistics and are scored like others. Rows that
    repeat an id are scored each by its own text; a row without id is never held out. Without labels the score is 0.5.
    Other columns of either table are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("_text"))
    table = materialize(with_statistics(source, "_text").drop("_text"), "quality-statistics")
    model = fit_quality(table, labels, id_col, parts=parts, held=held, limit=limit)
    return table.withColumn("score", model.score()).select(
        id_col, F.coalesce(fold(id_col, parts) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), *(F.col("_" + s).alias(s) for s in STATISTICS),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7, parts: int = 4, held: int = 2, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``least``. Same cases as ``score_quality``.

    The rules are fitted on the written statistics of the labelled rows. The filter is one expression that computes a text's
    statistics once; it adds no columns, so names in ``docs`` cannot clash with it.
    """
    known = materialize(bounded_sample(labelled_ids(labels, "quality", parts, held), "id", limit), "quality-labelled")
    # At most ``limit`` ids: small enough to send to every executor, so that no text is shuffled for the fit.
    wanted = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text")).join(
        F.broadcast(known.select(F.col("id").alias("_known"))), F.col(id_col) == F.col("_known"), "left_semi"
    )
    sample = materialize(wanted.select(id_col, statistics("_text").alias("_s")), "quality-sample")
    fitted = sample.select(id_col, *(F.col(f"_s.{s}").alias("_" + s) for s in STATISTICS))
    model = fit_quality(fitted, labels, id_col, parts=parts, held=held, limit=limit)
    return docs.filter(bound(statistics(text_col), lambda s: model.score(lambda name: s[name])) >= least)
