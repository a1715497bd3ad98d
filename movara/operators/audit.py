"""Rule audit: findings with severities, and the audit score."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movara.functions.columns import first_match, numeric_columns, round_to
from movara.functions.names import named_as
from movara.functions.text import normalize_name
from movara.functions.sharing import shared
from movara.operators import quality, roles, stats
from movara.operators.vocabulary import AUDIT_NEGATIVE_ALLOWED, BUSINESS_VALUE_TERMS, DATED_DOMAINS

# Points taken per finding.
SEVERITY_POINTS = {"critical": 18, "warning": 9, "info": 3}


def is_generic(name: str) -> bool:
    return normalize_name(name).startswith(("coluna_", "unnamed"))


def _finding(df: DataFrame, name, severity, measure, fired: Column | None = None) -> DataFrame:
    rows = df if fired is None else df.where(fired)
    as_value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select(
        as_value(name).cast("string").alias("finding"),
        as_value(severity).cast("string").alias("severity"),
        round_to(as_value(measure)).alias("measure"),
    )


def audit_findings(
    df: DataFrame,
    metrics: Iterable[str],
    domain: str,
    numeric: Iterable[str] | None = None,
    ingest_warnings: int = 0,
    scored: DataFrame | None = None,
) -> DataFrame:
    """Every fired rule with its severity and measure; each rule is a select over one-row evidence."""
    metrics = list(metrics)
    numeric = list(numeric or numeric_columns(df))
    scored = shared(quality.quality_score(df, numeric)) if scored is None else scored
    typed = roles.profile(df)
    evidence = typed.agg(
        F.count_if(F.col("type") == "datetime").alias("dates"),
        F.count("*").alias("columns"),
    )
    findings = []

    generic = [c for c in df.columns if is_generic(c)]
    if generic:
        rate = len(generic) / max(len(df.columns), 1)
        findings.append(_finding(evidence, "generic_header", "critical" if rate >= 0.2 else "warning", float(len(generic))))

    suggested = roles.period_suggestions(typed).agg(F.count("*").alias("n"))
    no_dates = evidence.select(F.col("dates") == 0).scalar()
    findings.append(
        _finding(suggested, "period_as_text", F.when(no_dates, "warning").otherwise("info"), F.col("n"), F.col("n") > 0)
    )
    if domain in DATED_DOMAINS:
        findings.append(_finding(evidence, "no_date", "warning", F.col("dates"), F.col("dates") == 0))

    if not metrics and numeric:
        findings.append(_finding(evidence, "no_main_metric", "warning", float(len(numeric))))
    else:
        findings += _metric_findings(df, evidence, metrics, numeric, domain)

    missing_rate = F.col("missing_total") / F.greatest(F.col("rows") * F.col("columns"), F.lit(1))
    fullest = typed.agg(F.min("present")).scalar()
    worst = F.lit(1.0) - fullest / F.greatest(F.col("rows"), F.lit(1))
    level = first_match(
        (missing_rate >= 0.25, "critical"), ((missing_rate >= 0.08) | (worst >= 0.35), "warning"), default="info"
    )
    findings.append(_finding(scored, "missing_values", level, missing_rate, F.col("missing_total") > 0))

    duplicate_rate = F.col("duplicate_rows") / F.greatest(F.col("rows"), F.lit(1))
    level = F.when(F.round(duplicate_rate, 4) >= 0.1, "critical").otherwise("warning")
    findings.append(_finding(scored, "duplicate_rows", level, duplicate_rate, F.col("duplicate_rows") > 0))

    rows = scored.select("rows").scalar()
    outliers = quality.outlier_counts(df, numeric).agg(F.max("outliers").alias("n"))
    outlier_rate = F.col("n") / F.greatest(rows, F.lit(1))
    level = F.when(outlier_rate >= 0.08, "warning").otherwise("info")
    findings.append(_finding(outliers, "numeric_outliers", level, outlier_rate, F.col("n").isNotNull()))

    identifiers = [c for c in numeric_columns(df) if named_as("identifier", c)]
    if any(c in metrics for c in identifiers):
        findings.append(_finding(evidence, "identifier_as_metric", "critical", float(len(identifiers))))
    elif identifiers:
        findings.append(_finding(evidence, "numeric_identifiers", "info", float(len(identifiers))))
    if ingest_warnings:
        findings.append(_finding(evidence, "ingest_warnings", "warning", float(ingest_warnings)))

    result = findings[0]
    for other in findings[1:]:
        result = result.unionByName(other)
    return result


def _metric_findings(df, evidence, metrics, numeric, domain) -> list[DataFrame]:
    findings = []
    noisy = [m for m in metrics if named_as("noise", m)]
    if noisy:
        findings.append(_finding(evidence, "noise_metric", "critical", float(len(noisy))))
    candidates = [
        c for c in numeric if any(t in normalize_name(c) for t in BUSINESS_VALUE_TERMS) and not named_as("noise", c)
    ]
    if metrics and candidates and not any(m in candidates for m in metrics):
        findings.append(_finding(evidence, "unprioritised_metric", "warning", float(len(candidates))))
    checked = [m for m in metrics if not any(t in normalize_name(m) for t in AUDIT_NEGATIVE_ALLOWED)]
    if checked:
        measured = stats.numeric_stats(df, checked)
        negative_total = F.col("sum") < 0
        severity = "critical" if domain in ("vendas", "compras", "clientes") else "warning"
        findings.append(
            _finding(measured, F.concat(F.lit("negative_total_"), "column"), severity, F.col("sum"), negative_total)
        )
        findings.append(
            _finding(
                measured,
                F.concat(F.lit("negatives_"), "column"),
                "warning",
                F.col("negative_rate"),
                ~negative_total & (F.col("negative_rate") > 0.05),
            )
        )
    return findings


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Critical first, then warnings, then notes (a few dozen rows at most)."""
    level = first_match(*[(F.col("severity") == s, i) for i, s in enumerate(SEVERITY_POINTS)], default=2)
    order = Window.orderBy(level, "finding")
    return findings.withColumn("position", F.row_number().over(order).cast("bigint"))


def audit_score(findings: DataFrame, scored: DataFrame) -> DataFrame:
    """Quality score minus the points of all findings; a clean table carries one note."""
    points = first_match(*[(F.col("severity") == s, p) for s, p in SEVERITY_POINTS.items()], default=3)
    totals = findings.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("notes"),
        F.coalesce(F.sum(points), F.lit(SEVERITY_POINTS["info"])).cast("bigint").alias("points_lost"),
    )
    left = scored.select("score").scalar() - F.col("points_lost")
    score = F.greatest(F.lit(0), F.least(F.lit(100), left)).cast("bigint")
    return totals.withColumn("score", score)
