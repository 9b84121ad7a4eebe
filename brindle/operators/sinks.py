"""Report formats. Rows are rendered by column expressions; only the frame around them is made once.

``*_rows`` give one rendered value a finding and can be written by the cluster. The document functions
gather rows into one value, as a report must; use them on what a person or a tool will read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.functions.findings import choose, occurrence_key, severity_rank, tier
from brindle.operators.reports import review_order
from brindle.operators.risk import by_risk, canonical, places

# Severities in the vocabularies of the formats.
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
ANNOTATION_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "notice", "info": "notice"}
QUALITY_LEVELS = {"critical": "blocker", "high": "critical", "medium": "major", "low": "minor", "info": "info"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def with_keys(findings: DataFrame) -> DataFrame:
    """Findings with ``key``: unique also among findings of one identity."""
    order = Window.partitionBy("identity").orderBy(*canonical())
    return findings.withColumn("key", occurrence_key(F.col("identity"), F.row_number().over(order)))


def _ordered(findings: DataFrame, value: Column) -> Column:
    """All values as one array in canonical order: the report is one value, and its order is its rows' own."""
    order = F.struct(severity_rank(F.col("severity")).alias("_s"), "path", "line", "rule", "fingerprint", "key")
    return findings.select(order.alias("o"), value.alias("v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v")), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)), lambda x: x["v"]).alias("rows"))


def json_rows(findings: DataFrame) -> Column:
    location = F.struct(F.col("path").alias("file"), "line", F.col("end_line").alias("endLine"))
    return F.struct("key", "rule", "name", "category", "severity", tier(F.col("category")).alias("tier"), "confidence", location.alias("location"), "message", "fingerprint")


def to_json(findings: DataFrame, score: DataFrame) -> DataFrame:
    """One row: the report as a document."""
    rows = _ordered(with_keys(findings), json_rows(findings))
    return rows.crossJoin(score).select(F.to_json(F.struct(F.lit(1).alias("schema"), F.struct("score", "band", "penalty", "density").alias("score"), F.size("rows").alias("total"), F.col("rows").alias("findings"))).alias("document"))


def to_sarif(findings: DataFrame, tool: str = "brindle", version: str = "0.1.0") -> DataFrame:
    """One row: SARIF 2.1.0 with the rules seen, sorted, and one result a finding."""
    region = F.struct(F.col("line").alias("startLine"), F.coalesce("end_line", "line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule").alias("ruleId"), choose(F.col("severity"), SARIF_LEVELS).alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place).alias("locations"), F.struct(F.col("key").alias("primary")).alias("partialFingerprints"),
    )
    rules = findings.groupBy("rule").agg(F.min("name").alias("name")).agg(F.sort_array(F.collect_list(F.struct(F.col("rule").alias("id"), "name"))).alias("rules"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), "rules")
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("rows").alias("results"))
    document = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return _ordered(with_keys(findings), result).crossJoin(rules).select(F.to_json(document).alias("document"))


def _escaped(value: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda v, p: F.replace(v, F.lit(p[0]), F.lit(p[1])), pairs, value)


_DATA = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")]
_PROPERTY = [*_DATA, (":", "%3A"), (",", "%2C")]


def to_annotations(findings: DataFrame) -> DataFrame:
    """Workflow commands, one a finding, in canonical order."""
    text = F.concat(
        F.lit("::"), choose(F.col("severity"), ANNOTATION_LEVELS), F.lit(" file="), _escaped(F.coalesce("path", F.lit("")), _PROPERTY), F.lit(",line="), F.coalesce(F.col("line").cast("string"), F.lit("1")),
        F.coalesce(F.concat(F.lit(",endLine="), F.col("end_line").cast("string")), F.lit("")), F.lit(",title="), _escaped(F.concat_ws(" ", "rule", "name"), _PROPERTY), F.lit("::"), _escaped(F.coalesce("message", F.lit("")), _DATA),
    )
    return findings.orderBy(*canonical()).select(text.alias("value"))


def to_code_quality(findings: DataFrame) -> DataFrame:
    """Code Quality issues, one row each, with unique fingerprints."""
    place = F.struct("path", F.struct(F.col("line").alias("begin"), F.coalesce("end_line", "line").alias("end")).alias("lines"))
    issue = F.struct(F.col("message").alias("description"), F.col("rule").alias("check_name"), F.col("key").alias("fingerprint"), choose(F.col("severity"), QUALITY_LEVELS).alias("severity"), place.alias("location"))
    return with_keys(findings).select(F.to_json(issue).alias("value"))


def to_markdown(findings: DataFrame, top: int = 20) -> DataFrame:
    """Table rows of the first findings in canonical order."""
    cell = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", cell("severity"), cell("rule"), F.concat(F.lit("`"), cell("path"), F.lit(":"), cell("line"), F.lit("`")), cell("message")), F.lit(" |"))
    return findings.orderBy(*canonical()).limit(top).select(row.alias("value"))


def to_graph(edges: DataFrame, source: str, target: str, style: str = "mermaid") -> DataFrame:
    """Lines of a graph of role edges, with counts; forbidden edges are marked."""
    forbidden = F.col("n_forbidden") > 0
    if style == "dot":
        line = F.concat(F.lit('  "'), source, F.lit('" -> "'), target, F.lit('" [label="'), F.col("n").cast("string"), F.when(forbidden, '" color=red];').otherwise('"];'))
    else:
        line = F.concat(F.lit("  "), source, F.when(forbidden, " -.->|").otherwise(" -->|"), F.col("n").cast("string"), F.lit("| "), target)
    return edges.orderBy(source, target).select(line.alias("value"))


def to_console(findings: DataFrame, top: int | None = None) -> DataFrame:
    """Lines for a terminal: where, how grave and how certain, what; all of them or the riskiest."""
    line = F.format_string("%s:%d  [%s %d%%] %s %s", F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(1)), "severity", "confidence", "rule", F.coalesce("message", F.lit("")))
    order = by_risk() if "risk" in findings.columns else canonical()
    rows = findings.orderBy(*order)
    return (rows if top is None else rows.limit(top)).select(line.alias("value"))


def to_triage(findings: DataFrame, top: int = 20) -> DataFrame:
    """(path, rule, n_findings, risk, value): the riskiest places, one line each."""
    found = places(findings).orderBy(F.desc("risk"), "path", "rule").limit(top)
    return found.withColumn("value", F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit("  "), F.col("rule"), F.when(F.col("n_findings") > 1, F.concat(F.lit(" x"), F.col("n_findings").cast("string"))).otherwise("")))


def to_diff(compared: DataFrame) -> DataFrame:
    """Lines of a comparison: what is new, then what is resolved; what was there before is only counted."""
    mark = F.when(F.col("state") == "new", "+").when(F.col("state") == "resolved", "-").otherwise(" ")
    rows = compared.where("state <> 'existing'").withColumn("_o", F.when(F.col("state") == "new", 0).otherwise(1))
    line = F.concat(mark, F.lit(" "), F.coalesce("path", F.lit("")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("1")), F.lit(" "), F.col("rule"), F.lit(" "), F.coalesce("message", F.lit("")))
    return rows.orderBy("_o", *canonical()).select(line.alias("value"))


def diff_counts(compared: DataFrame) -> DataFrame:
    """One row: how many are new, existing and resolved."""
    n = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0)).alias(s)
    return compared.agg(*[F.coalesce(n(s), F.lit(0)).alias(s) for s in ("new", "existing", "resolved")])


def diff_document(compared: DataFrame) -> DataFrame:
    """One row: a comparison as JSON, its counts and its new and resolved findings."""
    part = lambda s: _ordered(with_keys(compared.where(F.col("state") == s)), json_rows(compared)).withColumnRenamed("rows", s)
    counts = diff_counts(compared).select(F.struct("new", "existing", "resolved").alias("counts"))
    return counts.crossJoin(part("new")).crossJoin(part("resolved")).select(F.to_json(F.struct(F.lit(1).alias("schema"), "counts", "new", "resolved")).alias("document"))  # one row each


def diff_annotations(compared: DataFrame) -> DataFrame:
    """Workflow commands for what is new."""
    return to_annotations(compared.where("state = 'new'"))


def to_review(compared: DataFrame, top: int = 20) -> DataFrame:
    """A reviewer's table: the riskiest new findings, those in changed lines marked."""
    here = F.when(F.col("in_hunk"), " (changed here)").otherwise("") if "in_hunk" in compared.columns else F.lit("")
    row = F.concat(F.lit("| "), F.round("risk", 1).cast("string"), F.lit(" | `"), F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit("` | "), F.col("rule"), here, F.lit(" |"))
    return review_order(compared).limit(top).select(row.alias("value"))


def to_feedback(compared: DataFrame, edited: DataFrame) -> DataFrame:
    """What an editing agent is told after it changed files: new findings in these files."""
    mine = compared.where("state = 'new'").join(edited.select("path").distinct(), "path", "left_semi")
    return to_console(mine)


def to_fixer(findings: DataFrame, fixable: list[str]) -> DataFrame:
    """One row: the rules that a fixer knows and the files that it should open, both sorted."""
    rows = findings.where(F.col("rule").isin(fixable))
    return rows.agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.array_sort(F.collect_set("path")).alias("paths"))


def graph_document(edges: DataFrame, source: str, target: str) -> DataFrame:
    """One row: role edges as JSON."""
    one = F.struct(F.col(source).alias("from"), F.col(target).alias("to"), "n", "n_forbidden")
    return edges.agg(F.array_sort(F.collect_list(one)).alias("edges")).select(F.to_json(F.struct("edges")).alias("document"))


#: Formats by name: each takes findings and gives rows with ``value`` or one ``document``.
FORMATS = {"console": to_console, "github": to_annotations, "gitlab": to_code_quality, "markdown": to_markdown, "sarif": to_sarif}
