"""Grades, recommendations and the expiry predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grade bands
GRADE_BANDS = [("A", 85.0), ("B", 70.0), ("C", 55.0), ("D", 40.0)]


def grade(score: Column, bands: list[tuple[str, float]] = GRADE_BANDS) -> Column:
    out = None
    for name, low in sorted(bands, key=lambda b: -b[1]):
        out = F.when(score >= low, name) if out is None else out.when(score >= low, name)
    return out.otherwise("E")


def recommend(score: Column, pass_min: Column, warn_min: Column) -> Column:
    return F.when(score >= pass_min, "approve").when(score >= warn_min, "needs_changes").otherwise("block")


def component_recommendation(score: Column, critical: Column) -> Column:
    return (
        F.when((critical >= 3) | (score < 40), "block")
        .when((critical > 0) | (score < 70), "needs_changes")
        .otherwise("approve")
    )


def is_expired(expires_at: Column, now: Column) -> Column:
    """An ISO date-time (no zone means UTC) before ``now``, or an ISO date whose midnight is; bad text never expires."""
    text = F.trim(F.coalesce(expires_at, F.lit("")))
    return F.coalesce(F.try_to_timestamp(text) < now, F.lit(False))


def valid_expiry(expires_at: Column) -> Column:
    """The text when it is an ISO date or date-time, else empty."""
    text = F.trim(F.coalesce(expires_at, F.lit("")))
    return F.when(F.try_to_timestamp(text).isNotNull(), text).otherwise("")
