"""Score -> tier rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.schemas import ADMIN_ACTION, KARMA_ACTIONS, KARMA_TIERS, PENALTY_ACTIONS


def _by_tier(score: Column, values: list, otherwise: Column) -> Column:
    """``values[i]`` for the highest tier whose lowest score is reached."""
    expr = None
    for (_, _, lowest, _), value in reversed(list(zip(KARMA_TIERS, values))):
        reached = score >= lowest
        expr = F.when(reached, F.lit(value)) if expr is None else expr.when(reached, F.lit(value))
    return expr.otherwise(otherwise)


def tier(score: Column) -> Column:
    return _by_tier(score, [t[0] for t in KARMA_TIERS], F.lit(None).cast("string"))


def tier_label(score: Column) -> Column:
    return _by_tier(score, [t[1] for t in KARMA_TIERS], F.lit(None).cast("string"))


def tier_level(score: Column) -> Column:
    return _by_tier(score, [t[3] for t in KARMA_TIERS], F.lit(0))


def next_threshold(score: Column) -> Column:
    """Lowest score of the next tier, null at the top."""
    above = F.lit(None).cast("int")
    for _, _, lowest, _ in reversed(KARMA_TIERS):
        above = F.when(score < lowest, F.lit(lowest)).otherwise(above)
    return above


def award_rejection(action: Column, delta: Column) -> Column:
    """Reason an award is refused, or null. A delta of zero passes for every action."""
    return (
        F.when(action.isNull() | ~action.isin(KARMA_ACTIONS), "unknown action")
        .when(delta.isNull(), "missing delta")
        .when(action.isin(PENALTY_ACTIONS) & (delta > 0), "penalty must be negative")
        .when(~action.isin(PENALTY_ACTIONS) & (action != ADMIN_ACTION) & (delta < 0),
              "reward must be positive")
    )


def message_allowed(sender: Column, target: Column, shield: Column) -> Column:
    return (sender >= target) & (sender >= shield)


def message_refusal(sender: Column, target: Column, shield: Column) -> Column:
    """Text shown to a sender who may not write to the target; null when allowed."""
    # Message texts.
    below_target = F.format_string(
        "Your karma (%d) is below the recipient's karma (%d). "
        "You can only message users with equal or lower karma.", sender, target)
    below_shield = F.format_string(
        "The recipient's inbox shield requires a minimum karma of %d. Your karma is %d.",
        shield, sender)
    return F.when(sender < target, below_target).when(sender < shield, below_shield)


def levels_may_chat(level_a: Column, level_b: Column) -> Column:
    return F.abs(level_a - level_b) <= 1
