"""Extractive summaries: rank the sentences of each text by their word overlap (TextRank)."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.functions.text import blank_to_null, collapse_whitespace

# Sentences per summary; damping, stopping rule and row-sum guard of the ranking; a word is a
# run of letters, apostrophes and hyphens that starts with a letter and touches no digit or underscore.
MAX_SENTENCES = 6
DAMPING = 0.85
EPSILON = 1e-4
GUARD = 1e-7
WORD = r"(?<![\p{L}\p{N}_])\p{L}[\p{L}'-]*+(?![\p{N}_])"

# A sentence ends at . ! or ? before whitespace, or at a blank line.
_SENTENCE_END = r"(?<=[.!?])\s+|\n\s*\n"


def sentences(text: Column | str) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), _SENTENCE_END)
    return F.filter(F.transform(parts, collapse_whitespace), lambda s: s != "")


def sentence_words(sentence: Column) -> Column:
    return F.regexp_extract_all(F.lower(sentence), F.lit(WORD), F.lit(0))


_TABLE_CELLS = 2_000_000


def _ranker(max_sentences: int, damping: float, epsilon: float):
    def choose(word_lists) -> list[int]:
        """Positions of the best sentences, in text order.

        The similarity of two sentences, or of one with itself, is their number of common word pairs over
        the sum of the logs of their lengths. The divisor depends on the lengths alone, so similarity times
        a vector is a sum per (length, word), mixed over the distinct lengths: no pairs are formed.
        """
        n = len(word_lists)
        if n <= max_sentences:
            return list(range(n))
        size = np.array([len(w) for w in word_lists])
        if not size.any():
            return list(range(max_sentences))
        word, seen = pd.factorize(np.concatenate([np.asarray(w, dtype=object) for w in word_lists if len(w)]))
        by_word = np.argsort(word, kind="stable")
        word, sent = word[by_word], np.repeat(np.arange(n), size)[by_word]
        lengths, length_of = np.unique(size, return_inverse=True)
        logs = np.log(np.maximum(lengths, 1))
        divisor = logs[:, None] + logs[None, :]
        closeness = 1.0 / np.where(divisor > 0, divisor, 1.0)
        # Words are taken in slices so that the (length, word) table stays small for any text.
        step = max(1, _TABLE_CELLS // len(lengths))
        cuts = np.searchsorted(word, np.arange(0, len(seen) + step, step))
        slices = [(a, b, lo) for a, b, lo in zip(cuts, cuts[1:], range(0, len(seen), step)) if b > a]

        def similarity_times(x: np.ndarray) -> np.ndarray:
            total = np.zeros(n)
            for a, b, lo in slices:
                w, s = word[a:b] - lo, sent[a:b]
                width = int(w[-1]) + 1
                cell = length_of[s] * width + w
                mass = np.bincount(cell, weights=x[s], minlength=len(lengths) * width)
                spread = closeness @ mass.reshape(len(lengths), width)
                total += np.bincount(s, weights=spread.ravel()[cell], minlength=n)
            return total

        share = 1.0 / (similarity_times(np.ones(n)) + GUARD)
        rank = np.full(n, 1.0 / n)
        while True:
            # The similarity is symmetric, so spreading rank along rows is one product with it.
            nxt = (1.0 - damping) / n * rank.sum() + damping * similarity_times(rank * share)
            moved = np.linalg.norm(nxt - rank)
            rank = nxt
            if moved <= epsilon:
                break
        best = np.lexsort((np.arange(n), -np.round(rank, 12)))[:max_sentences]
        return sorted(int(i) for i in best)

    return choose


def extractive_summary(
    df: DataFrame, id_col: str, text: Column | str, max_sentences: int = MAX_SENTENCES, damping: float = DAMPING,
    epsilon: float = EPSILON,
) -> DataFrame:
    """(id, n_sentences, summary): the best sentences of each text, in text order.

    A text is one row, so ranking is a map over Arrow batches and nothing is shuffled.
    """
    choose = _ranker(max_sentences, damping, epsilon)

    @F.pandas_udf("array<int>")
    def chosen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(choose)

    text = F.col(text) if isinstance(text, str) else text
    split = df.select(id_col, sentences(text).alias("_sentences"))
    ranked = split.withColumn("_best", chosen(F.transform("_sentences", sentence_words)))
    picked = F.transform("_best", lambda i: F.get("_sentences", i))
    return ranked.select(
        id_col, F.size("_sentences").cast("bigint").alias("n_sentences"), F.array_join(picked, " ").alias("summary")
    )


def summary_source(subject: str, description: str, context: str) -> Column:
    """Ticket text and retrieved context, separated by a blank line; empty parts are left out."""
    own = F.trim(F.concat_ws("\n", F.coalesce(subject, F.lit("")), F.coalesce(description, F.lit(""))))
    return F.concat_ws("\n\n", blank_to_null(own), blank_to_null(context))
