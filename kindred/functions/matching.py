"""Match tiers, diversity and emission rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.schemas import EXPLORER, EXPLORER_FROM, FALLBACK, SOULMATE, SOULMATE_ABOVE, TOXICITY_LIMIT


def match_tier(top_score: Column) -> Column:
    """A null score (no candidate at all) is a fallback."""
    return (F.when(top_score > SOULMATE_ABOVE, F.lit(SOULMATE))
            .when(top_score >= EXPLORER_FROM, F.lit(EXPLORER))
            .otherwise(F.lit(FALLBACK)))


def diversify(column: str) -> Column:
    """Move the first match of another category to third place if the top three share one.

    ``column`` is one user's ranked array (at most the top 20), so this needs no shuffle.
    """
    other = f"array_position(transform({column}, m -> m.category <> {column}[0].category), true)"
    return F.expr(f"""
        CASE WHEN size({column}) >= 4 AND {other} > 3 THEN
          concat(slice({column}, 1, 2),
                 slice({column}, int({other}), 1),
                 slice({column}, 3, int({other}) - 3),
                 slice({column}, int({other}) + 1, size({column}) - int({other})))
        ELSE {column} END""")


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def postable(toxicity: Column) -> Column:
    return toxicity < TOXICITY_LIMIT


def model_approved(toxicity: Column) -> Column:
    return ~(toxicity > TOXICITY_LIMIT)


def score_or_default(given: Column, own: Column) -> Column:
    """The given score, else the row's own, else 0."""
    return F.coalesce(given, own, F.lit(0.0))
