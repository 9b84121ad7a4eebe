"""The path of findings through an analysis: which rules run, which findings stay, what is added to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.findings import at_least, tier

# Kinds of source that rules read besides or instead of code.
ALL_KINDS = ["code", "migration", "routes"]
ADMITTED = {
    "SL103": ALL_KINDS, "SL107": ALL_KINDS, "SL112": ALL_KINDS, "SL114": ALL_KINDS, "SL501": ALL_KINDS,
    "SL211": ["routes"], "SL212": ["routes"], "SL213": ["routes"],
    "SL215": ["migration"], "SL216": ["migration"], "SL217": ["migration"],
}
# What a condition on a value is certain to imply.
IMPLIED = {
    "truthy": ["truthy", "not-empty", "not-null"], "not-empty": ["truthy", "not-empty", "not-null"], "not-null": ["not-null"],
    "is-null": ["is-null", "falsy", "empty"], "falsy": ["falsy", "empty"], "empty": ["falsy", "empty"],
}


def planned(rules: DataFrame, frameworks: list[str], roles: bool, disabled: list[str]) -> DataFrame:
    """(rule, framework, needs_roles) -> rule and ``state``: run, off, or skipped.

    Rules that are turned off, or judge roles where none are declared, are off; only a rule of a framework
    that is not there is reported as skipped.
    """
    off = F.col("rule").isin(disabled) | (F.col("needs_roles") & F.lit(not roles))
    missing = F.col("framework").isNotNull() & ~F.coalesce(F.col("framework").isin(frameworks), F.lit(False))
    return rules.select("rule", F.when(off, "off").when(missing, "skipped").otherwise("run").alias("state"))


def confident(findings: DataFrame, least: int) -> DataFrame:
    """Findings that are certain enough; this comes before any score."""
    return findings.where(F.col("confidence") >= least)


def grave(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.where(at_least(F.col("severity"), threshold))


def of_rules(findings: DataFrame, rules: list[str]) -> DataFrame:
    """Findings of the named rules; case does not count."""
    return findings.where(F.upper("rule").isin([r.upper() for r in rules]))


def admitted(findings: DataFrame, kind: str = "kind", admission: dict[str, list[str]] | None = None) -> DataFrame:
    """Findings of rules that read their file's kind; a rule that is not listed reads code only."""
    table = ADMITTED if admission is None else admission
    listed = reduce(lambda a, b: a | b, [(F.col("rule") == r) & F.col(kind).isin(kinds) for r, kinds in table.items()], F.lit(False))
    return findings.where(listed | (~F.col("rule").isin(list(table)) & (F.col(kind) == "code")))


def reported(findings: DataFrame, only: DataFrame | None) -> DataFrame:
    """Findings in the asked paths. All files are indexed; only what is reported is narrowed."""
    return findings if only is None else findings.join(only.select("path").distinct(), "path", "left_semi")


def with_metrics(findings: DataFrame, more: Column, metrics: str = "metrics") -> DataFrame:
    """The map ``metrics`` with further entries; keys that are there already keep their value."""
    own = F.coalesce(F.col(metrics), F.create_map().cast("map<string,string>"))
    fresh = F.map_filter(more, lambda k, _: ~F.map_contains_key(own, k))
    return findings.withColumn(metrics, F.map_concat(own, F.coalesce(fresh, F.create_map().cast("map<string,string>"))))


def implies(earlier: Column, later: Column) -> Column:
    """Whether a condition of one kind makes a later one on the same subject certain."""
    case = reduce(lambda c, p: (F.when if c is None else c.when)(earlier == p[0], later.isin(p[1])), IMPLIED.items(), None)
    return F.coalesce(case.otherwise(F.lit(False)), F.lit(False))


def words_present(needles: Column, haystack: Column) -> Column:
    """Whether every word is among the others, where words of four letters or more may be cut at the end."""
    near = lambda a, b: (a == b) | ((F.length(a) >= 4) & F.startswith(b, a)) | ((F.length(b) >= 4) & F.startswith(a, b))
    return F.forall(needles, lambda n: F.exists(haystack, lambda w: near(n, w)))


def first_only(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by a partial minimum rather than a sort."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*key, *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)]).select(*rows.columns)


def analysis(findings: DataFrame, least: int = 0, rules: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """Findings as they are reported: certain enough, of the asked rules, admitted, in the asked paths, with their tier."""
    rows = admitted(confident(findings, least))
    rows = of_rules(rows, rules) if rules else rows
    return reported(rows, only).withColumn("tier", tier(F.col("category")))
