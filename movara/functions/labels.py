"""Level, tone and status labels used by the analytics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from movara.functions.columns import as_col, first_match


def concentration_level(share) -> Column:
    share = F.coalesce(as_col(share), F.lit(0.0))
    return first_match((share >= 0.8, "high"), (share >= 0.6, "medium"), default="low")


def movement_severity(delta, pct) -> Column:
    size = F.abs(F.coalesce(as_col(pct), F.lit(0.0)))
    return first_match(
        (size >= 0.5, "critical"),
        (size >= 0.25, "relevant"),
        (F.abs(as_col(delta)) > 0, "moderate"),
        default="stable",
    )


def movement_status(delta, pct, zscore) -> Column:
    """Status precedence: first month, outlier, critical, relevant, then the sign."""
    delta, size = as_col(delta), F.abs(F.coalesce(as_col(pct), F.lit(0.0)))
    return first_match(
        (delta.isNull(), "base"),
        (F.abs(as_col(zscore)) >= 2, "outlier"),
        (size >= 0.5, "critical"),
        (size >= 0.25, "relevant"),
        (delta > 0, "up"),
        (delta < 0, "down"),
        default="flat",
    )


def status_tone(status) -> Column:
    status = as_col(status)
    return first_match(
        (status == "critical", "danger"),
        (status.isin("outlier", "relevant"), "warning"),
        (status.isin("up", "down"), "info"),
        default="neutral",
    )


def sign_tone(value) -> Column:
    value = as_col(value)
    return first_match((value > 0, "good"), (value < 0, "warning"), default="neutral")


def direction(delta) -> Column:
    return F.when(F.coalesce(as_col(delta), F.lit(0.0)) >= 0, "up").otherwise("down")


def quality_label(score) -> Column:
    score = as_col(score)
    return first_match((score >= 90, "consistent"), (score >= 75, "good"), (score >= 55, "review"), default="critical")


def score_tone(score) -> Column:
    score = as_col(score)
    return first_match((score >= 85, "good"), (score >= 65, "warning"), default="danger")
