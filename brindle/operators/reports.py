"""Aggregates that reports show: counts, tallies, groups and reading lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.functions.findings import choose, severity_rank

# Categories in the order in which ties are listed.
CATEGORIES = ["complexity", "duplication", "dead-code", "error-handling", "readability", "performance", "architecture", "dependencies", "suppression", "laravel"]


def by_category(findings: DataFrame, order: list[str] = CATEGORIES) -> DataFrame:
    """(category, n, place): most findings first, ties in the order of the categories."""
    place = F.coalesce(choose(F.col("category"), {c: k for k, c in enumerate(order)}), F.lit(len(order)))
    return findings.groupBy("category").agg(F.count("*").alias("n")).withColumn("place", place).orderBy(F.desc("n"), "place", "category")


def by_rule(findings: DataFrame) -> DataFrame:
    """(rule, n): most findings first, ties by the rule."""
    return findings.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


def tally(findings: DataFrame) -> DataFrame:
    """(path, rules): how often each rule fires in a file, most first, ties by name; a row a file."""
    counts = findings.groupBy("path", "rule").agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "rule", "n"))), lambda x: F.concat(x["rule"], F.lit(" x"), x["n"].cast("string")))
    return counts.groupBy("path").agg(F.concat_ws(", ", listed).alias("rules"), F.sum("n").alias("n"))


def by_file(findings: DataFrame) -> DataFrame:
    """(path, findings): each file's findings as structs in their canonical order."""
    one = F.struct(severity_rank(F.col("severity")).alias("rank"), "line", "rule", "fingerprint")
    return findings.groupBy("path").agg(F.sort_array(F.collect_list(one)).alias("findings"))


def hotspots(risks: DataFrame, k: int = 10) -> DataFrame:
    """The riskiest files; ties by path."""
    return risks.groupBy("path").agg(F.sum("risk").alias("risk"), F.count("*").alias("n_findings")).orderBy(F.desc("risk"), "path").limit(k)


def review_order(findings: DataFrame) -> DataFrame:
    """New findings in the order in which a reviewer reads them: risk, then path and line."""
    return findings.where("state = 'new'").orderBy(F.desc("risk"), "path", "line")
