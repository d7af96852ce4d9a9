"""Rule-based tags: sentiment classes, heuristic priority, online features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ticketlake.functions.text import blank_to_null, list_length

# Stems and words of the rules. Negative stems are tried before positive ones.
NEGATIVE_STEMS = ["frustrat", "angry", "upset", "unhappy"]
POSITIVE_STEMS = ["happy", "satisf", "great", "good"]
TROUBLE_WORDS_STRUCTURED = ["error", "fail", "issue", "crash", "broken"]
TROUBLE_WORDS_TEXT = ["error", "fail", "failing", "issue", "bug"]
URGENT_WORDS = ["p0", "critical", "urgent", "severe"]


def contains_any(c: Column, words: list[str]) -> Column:
    return F.lower(c).rlike("|".join(words))


def sentiment_class(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (
        F.when(c.isNull(), "unknown")
        .when(contains_any(c, NEGATIVE_STEMS), "negative")
        .when(contains_any(c, POSITIVE_STEMS), "positive")
        .otherwise("neutral")
    )


def _headline(subject: Column | str, description: Column | str) -> Column:
    return F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(description, F.lit("")))


def structured_sentiment(subject: Column | str = "subject", description: Column | str = "description") -> Column:
    hit = contains_any(_headline(subject, description), TROUBLE_WORDS_STRUCTURED)
    return F.when(hit, "frustrated").otherwise("neutral")


def structured_priority(flag: Column | str = "contains_error_code") -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "high").otherwise("medium")


def text_sentiment(subject: Column | str = "subject", description: Column | str = "description") -> Column:
    hit = contains_any(_headline(subject, description), TROUBLE_WORDS_TEXT)
    return F.when(hit, "frustrated").otherwise("neutral")


def text_priority(subject: Column | str = "subject", description: Column | str = "description") -> Column:
    return F.when(contains_any(_headline(subject, description), URGENT_WORDS), "high").otherwise("medium")


def retrieval_success(helpful: Column | str, accepted: Column | str) -> Column:
    """1 when an article helped or the automatic suggestion was taken, else 0; never null."""
    accepted = F.col(accepted) if isinstance(accepted, str) else accepted
    return ((list_length(helpful) > 0) | F.coalesce(accepted, F.lit(False))).cast("bigint")


def online_features() -> list[Column]:
    """Per-ticket features that need no other row; used on batch and streaming frames."""
    text = F.concat_ws(
        "\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("subject", "description", "error_logs", "stack_trace")]
    )
    has_code = text.contains("ERROR_") | F.lower(text).contains(" error ")
    return [
        text.alias("text"),
        F.coalesce(blank_to_null("product"), F.lit("unknown")).alias("product"),
        F.coalesce(blank_to_null("customer_tier"), F.lit("unknown")).alias("tier"),
        has_code.alias("has_error_code"),
        F.md5(text).alias("text_hash"),
    ]
