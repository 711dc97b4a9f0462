"""Scores as column expressions. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..schema import PENALISED_STATUSES

# Fixed factors of the reference's ranking policy.
STALE, REVIEW, STATUS, CANONICAL, HASH_CURRENT, EXACT_FILTER, EXACT_SUBJECT, EXACT_FACT_KEY, PER_DERIVATION = 0.6, 0.7, 0.65, 1.08, 1.04, 1.04, 1.10, 1.12, 0.02


def minmax(score: Column) -> Column:
    """Scaled to 0..1 over the whole pool; all 1 where it has one value (relative tolerance 1e-9)."""
    whole = Window.partitionBy()
    low, high = F.min(score).over(whole), F.max(score).over(whole)
    flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.when(flat, 1.0).otherwise((score - low) / (high - low))


def age_hours(created_at: Column, now: Column) -> Column:
    """0 for the future, and for a missing date, which counts as now."""
    return F.coalesce(F.greatest((F.unix_micros(now) - F.unix_micros(created_at)) / 3.6e9, F.lit(0.0)), F.lit(0.0))


def recency(created_at: Column, now: Column, decay: float = 0.001) -> Column:
    return F.exp(-decay * age_hours(created_at, now))


def final_score(similarity: Column, importance: Column, fresh: Column) -> Column:
    return F.greatest(similarity, F.lit(0.0)) * F.greatest(F.least(importance, F.lit(10)), F.lit(0)) / 10.0 * fresh


def provenance_factor(*, history: bool = False, source: str | None = None, fact_key: str | None = None) -> Column:
    """Product of penalties (none where history is asked for) and boosts of a point's provenance."""
    out = F.lit(1.0)
    if not history:
        out = out * F.when(F.col("stale"), STALE).otherwise(1.0) * F.when(F.col("requires_review"), REVIEW).otherwise(1.0)
        out = out * F.when(F.col("fact_status").isin(*PENALISED_STATUSES), STATUS).otherwise(1.0)
    out = out * F.when(F.col("canonical"), CANONICAL).otherwise(1.0)
    if source is not None:
        out = out * F.when(F.lower("source") == source.lower(), EXACT_FILTER).otherwise(1.0)
    if fact_key is not None:
        out = out * F.when(F.lower(F.trim("fact_key")) == fact_key.strip().lower(), EXACT_FACT_KEY).otherwise(1.0)
    return out


def derivation_factor(depth: Column) -> Column:
    return F.when(depth > 0, F.greatest(F.lit(0.5), 1 - depth * PER_DERIVATION)).otherwise(1.0)


def graph_score(vector: Column, depth: Column, confidence: Column, provenance: Column, base: Column, usefulness: Column, inactive: Column) -> Column:
    near = F.when(depth > 0, 0.5 * F.exp(-depth.cast("double"))).otherwise(0.0)
    return vector + near + 0.35 * confidence + 0.15 * (provenance / F.greatest(base, F.lit(0.01))) + 0.15 * usefulness - F.when(inactive, 0.15).otherwise(0.0)


def zoom_efficiency(useful: Column, chars: Column) -> Column:
    return F.bround(useful / F.greatest(F.lit(1.0), chars / 1000.0), 6)
