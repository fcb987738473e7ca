"""Danger tiers compare by position, never as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_spark.fixed_values import TIERS


def _order() -> Column:
    return F.array(*[F.lit(t) for t in TIERS])


def danger_rank(tier: Column) -> Column:
    """0..3; NULL for NULL, -1 for a word that is not a tier (callers refuse it)."""
    return (F.array_position(_order(), tier) - 1).cast("int")


def is_tier(tier: Column) -> Column:
    return F.coalesce(tier.isin(*TIERS), F.lit(False))


def tier_at(rank: Column) -> Column:
    """The tier of a rank, NULL for NULL and for the rank of no tier."""
    return F.when(rank >= 0, F.element_at(_order(), (rank + 1).cast("int")))


def strictest(*tiers: Column) -> Column:
    """The most dangerous of several tiers, NULLs ignored."""
    return tier_at(F.greatest(*[danger_rank(t) for t in tiers]))


def mildest(*tiers: Column) -> Column:
    return tier_at(F.least(*[danger_rank(t) for t in tiers]))


def raise_to_floor(proposal: Column, floor: Column) -> Column:
    return strictest(proposal, floor)


def is_below_floor(proposal: Column, floor: Column) -> Column:
    return danger_rank(proposal) < danger_rank(floor)


def sort_rank(tier: Column) -> Column:
    """Screen order: a package with no floor sorts below every tier."""
    return F.coalesce(danger_rank(tier), F.lit(-1))
