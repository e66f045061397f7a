"""Column expressions on texts and phrases."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from phraselens.config import MAX_NGRAM

# Every Unicode white-space character; neither Java's nor RE2's \s covers them all.
WHITESPACE = r"\x{09}-\x{0d}\x{1c}-\x{1f}\x{85}\p{Z}"
STRIP_PATTERN = f"^[{WHITESPACE}]+|[{WHITESPACE}]+$"
WORD_PATTERN = f"[^{WHITESPACE}]+"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP_PATTERN, "")


def has_min_chars(text: Column, min_chars: int) -> Column:
    """True when the stripped text is long enough to look for phrases in."""
    return F.length(strip(text)) >= min_chars


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN))


def ngram_limit(words: Column) -> Column:
    """Longest n-gram for a text of so many words."""
    return F.when(words > 20, 4).when(words > 15, 3).otherwise(2)


def profile_ngram_limit(text: Column, banded: bool) -> Column:
    return ngram_limit(word_count(text)) if banded else F.lit(MAX_NGRAM)


def tokens(text: Column) -> Column:
    """Lower-case tokens of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def clean_phrase(phrase: Column) -> Column:
    return F.lower(strip(phrase))


def has_any_word(phrase: Column, words) -> Column:
    """True when one of the phrase's words is in the list."""
    return F.arrays_overlap(F.split(phrase, " "), F.array(*[F.lit(w) for w in words]))


def preview(text: Column, width: int = 100) -> Column:
    head = F.substring(text, 1, width)
    return F.when(F.length(text) > width, F.concat(head, F.lit("..."))).otherwise(head)
