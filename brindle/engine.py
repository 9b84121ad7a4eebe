"""The library's front: source files in, findings, scores, risks and comparisons out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.functions.findings import SEVERITIES, choose, identity, severity_rank
from brindle.operators import analysis, detectors, reports, revisions, risk, scoring
from brindle.session import checkpoint_dir
from brindle.sources import php

# Names and categories of the rules.
RULES = {
    "SL101": ("God Method", "complexity"), "SL102": ("God Class", "complexity"), "SL103": ("Excessive Nesting", "complexity"),
    "SL104": ("Duplicate Logic", "duplication"), "SL111": ("Copy-Paste Drift", "duplication"), "SL105": ("Dead Private Method", "dead-code"),
    "SL106": ("Unused Constructor Dependency", "dead-code"), "SL107": ("Swallowed Exception", "error-handling"), "SL112": ("Placeholder Implementation", "dead-code"),
    "SL113": ("Long Parameter List", "complexity"), "SL114": ("Nested Ternary", "readability"), "SL204": ("Query Inside Loop", "performance"), "SL206": ("Controller Dependencies", "dependencies"),
    "SL207": ("Service Dependencies", "dependencies"), "SL210": ("Suspicious Model::all()", "performance"), "SL211": ("Missing Route Action", "laravel"), "SL213": ("Destructive GET Route", "laravel"),
    "SL215": ("Irreversible Migration", "laravel"), "SL216": ("Model In Migration", "laravel"), "SL217": ("Unconstrained Foreign Key", "laravel"), "SL303": ("Single-Use Abstraction", "architecture"),
    "SL304": ("Layer Violation", "architecture"), "SL305": ("Forbidden Capability", "architecture"), "SL306": ("Boundary Violation", "architecture"),
    "SL501": ("Unexplained Suppression", "suppression"),
}
#: Rules about a framework's code.
OF_FRAMEWORK = {rule: "laravel" for rule in RULES if rule.startswith("SL2")}
#: Rules that enforce a declared policy.
OF_POLICY = ("SL304", "SL305", "SL306")
FIELDS = ["rule", "severity", "confidence", "path", "line", "message", "fingerprint"]
#: Exit codes: nothing grave, findings at or above the threshold, an error.
OK, FOUND, FAILED = 0, 1, 2


class Engine:
    """Findings over files (path, source, kind, code_lines).

    ``custom`` adds rules: each takes the tokens and gives rows with ``FIELDS``. ``frameworks`` are those that the
    project uses; rules of others are skipped (None: not known, all rules run). ``disabled`` rules are off, as are
    those of policies that are not declared. Facts are cut from their lineage once and shared by all rules.
    """

    def __init__(
        self, spark: SparkSession, files: DataFrame, custom: list[Callable[[DataFrame], DataFrame]] = (),
        frameworks: list[str] | None = None, disabled: list[str] = (), policies: detectors.Policies = detectors.Policies(),
    ):
        checkpoint_dir(spark)
        self.spark, self.files, self.custom, self._tokens, self._found = spark, files, list(custom), None, None
        self.frameworks = sorted(set(OF_FRAMEWORK.values())) if frameworks is None else list(frameworks)
        self.disabled, self.policies = [r.upper() for r in disabled], policies

    def plan(self) -> DataFrame:
        """(rule, state): which rules run, which are off, and which are skipped for want of their framework."""
        undeclared = [r for r in OF_POLICY if r not in self.policies.declared()]
        rules = self.spark.createDataFrame([(r, OF_FRAMEWORK.get(r), r in undeclared) for r in RULES], "rule string, framework string, needs_roles boolean")
        return analysis.planned(rules, self.frameworks, False, self.disabled)

    def tokens(self) -> DataFrame:
        if self._tokens is None:
            self._tokens = php.tokens(self.files).checkpoint()
        return self._tokens

    def found(self) -> DataFrame:
        """What all rules find, with name, category, the file's kind, an identity and a last line."""
        if self._found is None:
            tokens = self.tokens()
            without = frozenset(r.rule for r in self.plan().where("state <> 'run'").collect())  # one row a rule
            rows = detectors.detect(tokens, without, self.policies)
            for more in (php.unexplained_suppressions(tokens), php.deep_nesting(php.units(tokens)), *(rule(tokens) for rule in self.custom)):
                rows = rows.unionByName(more.select(*FIELDS))
            rows = rows.where(~F.col("rule").isin(sorted(without)))
            named = rows.join(self.files.select("path", "kind"), "path").withColumns({
                "name": choose(F.col("rule"), {r: n for r, (n, _) in RULES.items()}, ""), "category": choose(F.col("rule"), {r: c for r, (_, c) in RULES.items()}, "complexity"),
                "identity": identity(F.col("rule"), F.col("path"), F.coalesce("fingerprint", F.lit(""))), "end_line": F.col("line"),
            })
            self._found = named.checkpoint()
        return self._found

    def findings(self, least: int = 0, rules: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
        return analysis.analysis(self.found(), least, rules, only)

    def score(self, findings: DataFrame | None = None) -> DataFrame:
        """One row: the score of the tree; paths that are not reported count as well."""
        lines = self.files.agg(F.coalesce(F.sum("code_lines"), F.lit(0)).alias("lines"))
        return scoring.score(self.findings() if findings is None else findings, lines, [])

    def ranked(self, coverage: DataFrame | None = None, churn: DataFrame | None = None) -> DataFrame:
        """Findings with their risk, the riskiest first."""
        rows = self.findings().withColumn("subject", F.col("path"))
        return risk.with_risk(rows, None, coverage, churn).orderBy(*risk.by_risk())

    def against(self, base: Engine) -> DataFrame:
        """New, existing and resolved findings compared with another state of the files."""
        return revisions.partition(self.findings(), base.findings(), "identity", ["line", "rule", "fingerprint"])

    def without(self, baseline: DataFrame, findings: DataFrame | None = None) -> DataFrame:
        """Findings that a baseline does not accept; entries of files that are gone cover moved ones."""
        matched, _ = revisions.match_baseline(self.findings() if findings is None else findings, baseline, self.files.select("path"), ["path", "line"])
        return matched.where("NOT accepted").drop("accepted")

    def health(self, top: int = 5) -> DataFrame:
        """One row: score and band, counts by severity and category, and the riskiest findings."""
        rows = self.findings()
        severities = rows.groupBy("severity").count().agg(F.map_from_entries(F.collect_list(F.struct("severity", "count"))).alias("by_severity"))
        categories = reports.by_category(rows).agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("by_category"))
        worst = risk.top(self.ranked(), top).agg(F.sort_array(F.collect_list(F.struct((-F.col("risk")).alias("r"), "path", "line", "rule"))).alias("top"))
        return self.score().crossJoin(severities).crossJoin(categories).crossJoin(worst)  # one row each

    def exit_code(self, fail_on: str = "high") -> int:
        return FOUND if not self.findings().where(severity_rank(F.col("severity")) <= SEVERITIES[fail_on][0]).isEmpty() else OK


def assert_clean(findings: DataFrame) -> None:
    """For tests: no findings at all."""
    left = findings.select("rule", "path", "line").limit(5).collect()
    assert not left, left


def assert_score(score: DataFrame, least: int) -> None:
    """For tests: the score is high enough."""
    value = score.first().score
    assert value >= least, value
