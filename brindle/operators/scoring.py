"""Score of a set of findings: penalties by rule, diminishing returns, and the share of lines touched.

``by`` names the columns of the groups that are scored; without any there is one score. The union of
line ranges is a running maximum within a file, and all else is grouped aggregation with partial sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.functions.findings import band, penalty


@dataclass(frozen=True)
class ScoreSettings:
    lines_per_unit: float = 1000.0
    multiplier: float = 1.0
    rule_cap: float = 30.0


def covered_lines(ranges: DataFrame, by: list[str], start: str = "line", end: str = "end_line") -> DataFrame:
    """Distinct integers in the closed ranges of each group. A null end is the start."""
    last = F.coalesce(F.col(end), F.col(start))
    rows = ranges.select(*by, F.col(start).alias("_s"), F.greatest(F.col(start), last).alias("_e"))
    before = Window.partitionBy(*by).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("_e").over(before), F.col("_s") - 1)
    fresh = F.greatest(F.lit(0), F.col("_e") - F.greatest(F.col("_s"), reached + 1) + 1)
    return rows.select(*by, fresh.alias("_n")).groupBy(*by).agg(F.sum("_n").cast("long").alias("covered"))


def capped(deduction: Column, cap: float) -> Column:
    """Diminishing returns: a rule's deduction approaches the cap; a cap of 0 turns them off."""
    return cap * (1 - F.exp(-deduction / cap)) if cap > 0 else deduction


def score(findings: DataFrame, lines: DataFrame, by: list[str], settings: ScoreSettings = ScoreSettings()) -> DataFrame:
    """(by..., rule, severity, confidence, path, line, end_line) and (by..., lines) -> score of each group.

    Every group of ``lines`` is scored; without findings it has 100.
    """
    per_rule = findings.groupBy(*by, "rule").agg(F.sum(penalty(F.col("severity"), F.col("confidence"))).alias("penalty"))
    touched = covered_lines(findings, [*by, "path"]).groupBy(*by).agg(F.sum("covered").alias("covered"))
    units = F.greatest(F.lit(1.0), F.col("lines") / settings.lines_per_unit)
    share = F.when(F.col("lines") > 0, F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.col("lines"))).otherwise(0.0)
    sized = lines.join(touched, by, "left") if by else lines.crossJoin(touched)  # without groups both have one row
    sized = sized.select(*by, units.alias("units"), share.alias("share"))
    rules = sized.join(per_rule, by, "left") if by else sized.join(per_rule, F.lit(True), "left")
    deduction = capped(F.coalesce("penalty", F.lit(0.0)) / F.col("units") * settings.multiplier * (1 + F.col("share")), settings.rule_cap)
    sums = rules.groupBy(*by).agg(
        F.sum(deduction).alias("deduction"),
        F.coalesce(F.sum("penalty"), F.lit(0.0)).alias("penalty"),
        F.max("units").alias("units"),
    )
    value = F.round(100 - F.least(F.lit(100.0), F.col("deduction"))).cast("int")
    return sums.select(*by, value.alias("score"), band(value).alias("band"), "penalty", (F.col("penalty") / F.col("units")).alias("density"))
