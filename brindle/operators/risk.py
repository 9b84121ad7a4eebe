"""Risk of a finding, and the orders that reading lists use.

Unmeasured is not zero: a null reach, coverage or churn acts as the factor 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.functions.findings import clamp, severity_rank, severity_weight


@dataclass(frozen=True)
class RiskSettings:
    reach: float = 1.0
    exposure: float = 0.5
    activity: float = 0.5
    inherited: float = 0.25
    nearby: float = 0.3


def reach(blast: Column, s: RiskSettings) -> Column:
    return F.when(blast >= 0, 1 + F.log10(1 + blast) * s.reach).otherwise(1.0)


def exposure(coverage: Column, s: RiskSettings) -> Column:
    return F.when(coverage.isNotNull(), 1 + (1 - clamp(coverage, 0.0, 1.0)) * s.exposure).otherwise(1.0)


def activity(changes: Column, s: RiskSettings) -> Column:
    return F.when(changes.isNotNull(), 1 + F.log10(1 + F.greatest(F.lit(0), changes)) * s.activity).otherwise(1.0)


def risk(severity: Column, confidence: Column, blast: Column, coverage: Column, changes: Column, is_new: Column | None = None, in_hunk: Column | None = None, settings: RiskSettings = RiskSettings()) -> Column:
    """The product of all factors; null ``is_new`` or ``in_hunk`` is outside a diff and counts as 1."""
    factor = lambda flag, low: F.lit(1.0) if flag is None else F.when(~flag, low).otherwise(1.0)
    value = severity_weight(severity) * clamp(confidence, 0, 100) / 100
    value = value * factor(is_new, settings.inherited) * factor(in_hunk, settings.nearby)
    return value * reach(blast, settings) * exposure(coverage, settings) * activity(changes, settings)


def with_risk(findings: DataFrame, blast: DataFrame | None = None, coverage: DataFrame | None = None, churn: DataFrame | None = None, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """Findings with ``risk``. ``churn`` given means that history is known: absent paths changed 0 times."""
    rows = findings
    rows = rows.join(blast, "subject", "left") if blast is not None else rows.withColumn("blast_radius", F.lit(None).cast("int"))
    rows = rows.join(coverage, "path", "left") if coverage is not None else rows.withColumn("ratio", F.lit(None).cast("double"))
    rows = rows.join(churn, "path", "left").withColumn("changes", F.coalesce("changes", F.lit(0))) if churn is not None else rows.withColumn("changes", F.lit(None).cast("int"))
    flag = lambda c: F.col(c) if c in findings.columns else None
    value = risk(F.col("severity"), F.col("confidence"), F.col("blast_radius"), F.col("ratio"), F.col("changes"), flag("is_new"), flag("in_hunk"), settings)
    return rows.withColumn("risk", value)


def by_risk() -> list[Column]:
    return [F.desc("risk"), F.asc("path"), F.asc("line"), F.asc("rule")]


def canonical() -> list[Column]:
    return [severity_rank(F.col("severity")).asc(), F.asc("path"), F.asc("line"), F.asc("rule"), F.asc("fingerprint")]


def top(findings: DataFrame, k: int) -> DataFrame:
    """The k riskiest findings: a bounded top-k in each partition, then one merge."""
    return findings.orderBy(*by_risk()).limit(k)


def by_file(findings: DataFrame) -> DataFrame:
    """A file's risk is the sum of its findings' risks."""
    return findings.groupBy("path").agg(F.sum("risk").alias("risk"), F.count("*").alias("n_findings"))


def places(findings: DataFrame) -> DataFrame:
    """(path, rule) groups with their size and their riskiest finding's line."""
    lead = F.min_by("line", F.struct((-F.col("risk")).alias("r"), "line"))
    return findings.groupBy("path", "rule").agg(F.count("*").alias("n_findings"), F.max("risk").alias("risk"), lead.alias("line"))


def ordinals(findings: DataFrame, key: str, order: list) -> DataFrame:
    """``ordinal``: the place of each finding among those of the same key."""
    return findings.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
