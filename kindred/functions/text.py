"""Text cleaning, tag handling and message texts as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by a Unicode "strip".
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Patterns and replacements. "(?U)" gives \b and \d their Unicode meaning in Java.
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_MASK = "[email removed]"
PHONE_PATTERN = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
PHONE_MASK = "[phone removed]"

# Default keyword -> implied tag rules; callers may pass their own.
TAG_RULES = [
    ("code", "programming"),
    ("python", "programming"),
    ("data", "data science"),
    ("game", "gaming"),
    ("cloud", "devops"),
]


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def mask_emails(col: Column) -> Column:
    """Texts without an @ skip the pattern."""
    masked = F.regexp_replace(col, "(?U)" + EMAIL_PATTERN, F.lit(EMAIL_MASK))
    return F.when(F.contains(col, F.lit("@")), masked).otherwise(col)


def mask_phones(col: Column) -> Column:
    """Texts without a run of ten (possibly separated) digits skip the word-boundary pattern."""
    masked = F.regexp_replace(col, "(?U)" + PHONE_PATTERN, F.lit(PHONE_MASK))
    return F.when(F.rlike(col, F.lit("(?U)" + PHONE_PATTERN.replace(r"\b", ""))), masked).otherwise(col)


def mask_pii(col: Column) -> Column:
    """E-mails first, then phone numbers."""
    return mask_phones(mask_emails(col))


def normalize_tags(tags: Column) -> Column:
    """Strip and lower-case, drop blanks and duplicates, sort."""
    cleaned = F.transform(tags, lambda t: F.lower(strip(t)))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda t: F.length(t) > 0)))


def enrich_tags(bio: Column, tags: Column, rules: Sequence[tuple[str, str]] = tuple(TAG_RULES)) -> Column:
    """Add the tags whose keyword occurs as a word of the bio.

    ``rules`` is a small literal list of lower-case alphanumeric keywords and tags.
    """
    text = F.lower(bio)
    implied = F.array_compact(F.array(*[
        F.when(F.contains(text, F.lit(keyword))
               & F.rlike(text, F.lit(f"(?<![a-z0-9]){keyword}(?![a-z0-9])")), F.lit(tag))
        for keyword, tag in rules]))
    return F.array_sort(F.array_union(tags, implied))


def embedding_text(bio: Column, tags: Column) -> Column:
    return F.concat(F.lit("Bio: "), bio, F.lit("\nInterests: "), F.array_join(tags, ", "))


# Fixed value: the welcome sentence.
def default_introduction(community_name: Column) -> Column:
    return F.concat(F.lit("Welcome to "), community_name, F.lit("! We're excited to have you here."))


def percent(score: Column) -> Column:
    return F.format_string("%.0f%%", score * 100)


def with_separators(count: Column) -> Column:
    return F.format_number(count, 0)
