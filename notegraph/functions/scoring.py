"""Relevance scoring of notes, as column expressions over one clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegraph.schema import OLDEST_RECENCY, RECENCY_TIERS, SCORING, Scoring


def _lookup(value: Column, table: dict[str, float]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(0.0))


def age_days(moment: Column, as_of: str) -> Column:
    """Whole days from ``moment`` to the clock, towards zero; null without moment."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(moment.cast("timestamp"))
    return (seconds / 86400).cast("bigint")


def recency(days: Column) -> Column:
    factor = F.when(days < RECENCY_TIERS[0][0], RECENCY_TIERS[0][1])
    for limit, value in RECENCY_TIERS[1:]:
        factor = factor.when(days < limit, value)
    return factor.otherwise(OLDEST_RECENCY)


def access_bonus(count: Column, cfg: Scoring = SCORING) -> Column:
    return F.least(F.coalesce(count, F.lit(0)).cast("double") * cfg.per_access, F.lit(cfg.max_access_bonus))


def salience(origin: Column, kind: Column, cfg: Scoring = SCORING) -> Column:
    return _lookup(F.coalesce(origin, F.lit("")), cfg.salience) + F.when(kind == "explore", cfg.explore_bonus).otherwise(0.0)


def relevance(edge_type: Column, matched: Column, contradictions: Column, as_of: str, cfg: Scoring = SCORING) -> Column:
    """Score of a note row (weight, status, origin, type, access_count, last_accessed).

    ``matched`` is the mean of 1 / log2(n + 2) over the matched tags, 0 without any.
    """
    return disputed(standing(edge_type, matched, cfg), contradictions, recency(age_days(F.col("last_accessed"), as_of)), cfg)


def disputed(value: Column, contradictions: Column, factor: Column, cfg: Scoring = SCORING) -> Column:
    """The score of a standing with contradictions against it, and a factor of recency."""
    return (value + contradictions * cfg.contradiction_penalty) * factor


def standing(edge_type: Column, matched: Column, cfg: Scoring = SCORING) -> Column:
    """What a note row has before contradictions and recency."""
    return (
        F.coalesce(F.col("weight"), F.lit(0.0))
        + _lookup(F.coalesce(edge_type, F.lit("")), cfg.edge_bonuses)
        + _lookup(F.coalesce(F.col("status"), F.lit("")), cfg.status_penalties)
        + access_bonus(F.col("access_count"), cfg)
        + salience(F.col("origin"), F.col("type"), cfg)
        + matched * cfg.tag_weight
    )


def specificity(n: Column) -> Column:
    return F.lit(1.0) / F.log2(F.coalesce(n, F.lit(0)).cast("double") + 2)
