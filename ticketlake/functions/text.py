"""Text expressions: trimming, the concatenation forms, fingerprints and display strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters that count as whitespace (Unicode, not only blanks).
WHITESPACE = (
    r"[\t-\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Fixed value: a token is a run of at least two Unicode letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"
# Label of an empty category and separators of the text forms.
MISSING_CATEGORY = "<MISSING>"
FINGERPRINT_SEPARATOR = "||"
BLOCK_SEPARATOR = " \n "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def concat_training(*cols: Column | str) -> Column:
    """Join with one blank; empties stay, nothing is trimmed."""
    return F.concat_ws(" ", *[_text(c) for c in cols])


def concat_compact(*cols: Column | str) -> Column:
    """Trim each part, drop empties, join with one blank."""
    return F.concat_ws(" ", *[blank_to_null(strip(_text(c))) for c in cols])


def concat_separated(*cols: Column | str) -> Column:
    """Trim each part, keep empties, join with a separator line."""
    return F.concat_ws(BLOCK_SEPARATOR, *[strip(_text(c)) for c in cols])


def collapse_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_text(c), f"{WHITESPACE}+", " "))


def concat_normalized(*cols: Column | str) -> Column:
    """Collapse whitespace runs in each part, drop empties, join with one blank."""
    return F.concat_ws(" ", *[blank_to_null(collapse_whitespace(c)) for c in cols])


def fingerprint(*cols: Column | str) -> Column:
    """Content hash; no case folding, no trimming."""
    return F.md5(F.concat_ws(FINGERPRINT_SEPARATOR, *[_text(c) for c in cols]))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(TOKEN), F.lit(0))


def with_bigrams(words: Column) -> Column:
    """The tokens followed by every pair of neighbours."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)


def category_label(c: Column | str) -> Column:
    return F.coalesce(blank_to_null(strip(c)), F.lit(MISSING_CATEGORY))


def list_length(c: Column | str) -> Column:
    return F.coalesce(F.size(_col(c)), F.lit(0))


def kb_articles(helpful: Column | str, viewed: Column | str) -> Column:
    """The helpful articles when there are any, otherwise the viewed ones."""
    return F.when(list_length(helpful) > 0, _col(helpful)).otherwise(_col(viewed))


def joined(c: Column | str) -> Column:
    """An array of strings as one blank-separated string; null gives ''."""
    return F.coalesce(F.array_join(_col(c), " "), F.lit(""))


def kb_text() -> Column:
    """Searchable text of a knowledge-base document; inner empties stay, the ends are trimmed."""
    parts = [
        _text("subject"), _text("product"), _text("category"), _text("subcategory"), joined("tags"),
        _text("resolution_code"), joined(kb_articles("kb_articles_helpful", "kb_articles_viewed")),
        _text("resolution"), _text("description"),
    ]
    return strip(F.concat_ws(" ", *parts))


def query_text(predicted: Column | str) -> Column:
    """Search text of a ticket; the predicted category, when there is one, replaces its own."""
    category = F.coalesce(blank_to_null(_col(predicted)), _text("category"))
    parts = [strip(_text("subject")), strip(_text("product")), category, joined("tags"),
             strip(_text("description"))]
    return strip(F.concat_ws(" ", *parts))


# Fixed formats: what a user sees for a hit and for a solved ticket.
def preview() -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[TITLE] "), _text("doc_id")),
        F.concat(F.lit("[PRODUCT] "), _text("product")),
        F.concat(F.lit("[CATEGORY] "), _text("category"), F.lit("::"), _text("subcategory")),
        F.concat(F.lit("[RES_CODE] "), _text("resolution_code")),
    )


def quality_text(c: Column | str) -> Column:
    return F.format_string("%.1f", _col(c))


def context_block() -> Column:
    return F.concat(
        F.lit("[DOC "), _text("doc_id"), F.lit("]\nproduct="), _text("product"),
        F.lit(" category="), _text("category"), F.lit("::"), _text("subcategory"),
        F.lit("\nresolution_code="), _text("resolution_code"),
        F.lit(" quality="), quality_text("quality"), F.lit("\n---\n"), strip(_text("preview")),
    )


NO_MATCH = "No close matches found; try broadening filters or escalate."


def solve_summary(hit: Column) -> Column:
    """Answer line for the best hit (a struct), or the no-match line when it is null."""
    found = F.concat(
        F.lit("Closest historical case: "), _text(hit["doc_id"]),
        F.lit(" ("), _text(hit["category"]), F.lit("::"), _text(hit["subcategory"]),
        F.lit(") Resolution code: "), _text(hit["resolution_code"]),
        F.lit(" Suggested next step: apply the known fix or verify the steps from the matched case; "
              "if it diverges, re-run retrieval with broader filters."),
    )
    return F.when(hit.isNull(), F.lit(NO_MATCH)).otherwise(found)
