"""Scalar vocabulary of findings: severities, tiers, bands, identities. Column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Severity -> (rank, weight); category -> tier; least score -> band.
SEVERITIES = {"critical": (0, 20.0), "high": (1, 10.0), "medium": (2, 4.0), "low": (3, 1.5), "info": (4, 0.5)}
CATEGORY_TIERS = {
    "error-handling": "defect", "performance": "defect", "dead-code": "defect", "suppression": "defect",
    "architecture": "advisory",
}
OTHER_TIER = "maintainability"
BANDS = [(90, "clean"), (75, "healthy"), (60, "needs_attention"), (40, "poor")]
LOWEST_BAND = "severe"


def choose(key: Column, values: dict, otherwise=None) -> Column:
    """The value of ``key`` in a small fixed table, as one CASE expression."""
    pairs = [(key == k, F.lit(v)) for k, v in values.items()]
    case = reduce(lambda c, p: F.when(*p) if c is None else c.when(*p), pairs, None)
    return case if otherwise is None else case.otherwise(F.lit(otherwise))


def severity_rank(severity: Column) -> Column:
    return choose(severity, {k: rank for k, (rank, _) in SEVERITIES.items()})


def severity_weight(severity: Column) -> Column:
    return choose(severity, {k: weight for k, (_, weight) in SEVERITIES.items()})


def penalty(severity: Column, confidence: Column) -> Column:
    """What one finding costs: the severity's weight by its confidence."""
    return severity_weight(severity) * clamp(confidence, 0, 100) / 100


def clamp(value: Column, least, most) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), value))


def tier(category: Column, rule: Column | None = None, overrides: dict[str, str] | None = None) -> Column:
    """The rule's configured tier, else the category's."""
    usual = choose(category, CATEGORY_TIERS, OTHER_TIER)
    return F.coalesce(choose(rule, overrides), usual) if overrides else usual


def band(score: Column) -> Column:
    case = None
    for least, name in BANDS:
        case = F.when(score >= least, name) if case is None else case.when(score >= least, name)
    return case.otherwise(LOWEST_BAND)


def identity(rule: Column, path: Column, fingerprint: Column) -> Column:
    """Sixteen hexadecimal digits that name a finding; its line is left out, so moving it keeps the name."""
    return F.substring(F.sha2(F.concat_ws("\0", rule, path, fingerprint), 256), 1, 16)


def occurrence_key(identity_: Column, ordinal: Column) -> Column:
    """The identity for the first occurrence; a digest with the ordinal for later ones."""
    later = F.substring(F.sha2(F.concat_ws("\0", identity_, ordinal.cast("string")), 256), 1, 16)
    return F.when(ordinal == 1, identity_).otherwise(later)


def at_least(severity: Column, threshold: str) -> Column:
    """Whether a severity is at the threshold or graver."""
    return severity_rank(severity) <= SEVERITIES[threshold][0]


def lowered(severity: Column, configured: Column) -> Column:
    """The graver of two ranks loses: an override can only lower a severity."""
    return F.when(severity_rank(severity) >= severity_rank(configured), severity).otherwise(configured)
