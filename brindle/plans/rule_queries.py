"""Queries over reports as texts and rules of a project's own, over the turns of conversations.

A turn stands for a report: its lines are the findings. A conversation stands for a file that a custom rule reads.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from brindle.operators import custom_rules
from brindle.session import table
from brindle.sources import reports


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, value): every turn as the JSON text of a report. Some are cut short, have no version, a later one,
    or a key that no version knows."""
    c = F.coalesce("conv_id", F.lit(0))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.split(F.coalesce("text", F.lit("")), "\n").alias("_lines"))
    finding = lambda line, i: F.struct(
        F.col("role").alias("rule"), F.struct(F.concat(F.lit("c"), c).alias("file"), i.alias("line")).alias("location"), (F.length(line) % 101).alias("confidence"), line.alias("message"),
        F.struct(F.length(line).alias("chars"), (i % 2 == 0).alias("even")).alias("extra"),
    )
    of = lambda k: F.filter(F.transform("_lines", lambda line, i: F.struct(i.alias("_i"), finding(line, i).alias("_f"))), lambda x: x["_i"] % 3 == k)
    only = lambda k: F.transform(of(k), lambda x: x["_f"])
    version = F.when(c % 13 == 6, None).when(c % 7 == 3, 2).otherwise(1)
    scan = F.struct(version.alias("schema"), F.struct((c % 100).alias("value"), F.lit("healthy").alias("band")).alias("score"), F.transform("_lines", finding).alias("findings"))
    diff = F.struct(version.alias("schema"), F.lit("diff").alias("mode"), F.struct(F.struct((c % 100).alias("value")).alias("current")).alias("score"), only(0).alias("new"), only(1).alias("existing"), only(2).alias("resolved"))
    texts = turns.withColumn("_t", F.when(c % 2 == 0, F.to_json(diff)).otherwise(F.to_json(scan)))
    return texts.select("conv_id", "turn", "role", F.when(c % 11 == 5, F.expr("left(_t, length(_t) - 1)")).otherwise(F.col("_t")).alias("value"))


def reports_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of all reports that can be read, with what their version does not know."""
    read = reports.findings(reports.parsed(_reports(spark, sf_dir)), ["conv_id", "turn"])
    return read.select("conv_id", "turn", "list", "at", "rule", "path", "line", "confidence", "message", F.to_json(F.col("more")["extra"]).alias("extra"), F.size(F.map_keys("more")).alias("n_more"))


REPORTS_CTE = """
WITH r AS (SELECT conv_id, turn, role, coalesce(conv_id, 0) AS c, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations),
s AS (SELECT *, CASE WHEN c % 11 = 5 THEN 'corrupt' WHEN c % 13 = 6 THEN 'foreign' WHEN c % 7 = 3 THEN 'newer' ELSE 'read' END AS state FROM r)
"""
REPORTS_SQL = REPORTS_CTE + """
SELECT conv_id, turn, CASE WHEN c % 2 = 1 THEN 'current' WHEN i % 3 = 0 THEN 'new' WHEN i % 3 = 1 THEN 'existing' ELSE 'resolved' END AS list,
       CAST(CASE WHEN c % 2 = 1 THEN i ELSE i // 3 END AS INT) AS at, role AS rule, 'c' || c AS path, i AS line, CAST(length(m) % 101 AS INT) AS confidence, m AS message,
       '{"chars":' || length(m) || ',"even":' || (i % 2 = 0)::VARCHAR || '}' AS extra, CAST(1 AS INT) AS n_more
FROM (SELECT *, unnest(l) AS m, unnest(range(len(l))) AS i FROM s WHERE state = 'read')
"""


def reports_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reports could be read, by version and mode, with the least and the most score."""
    known = reports.parsed(_reports(spark, sf_dir))
    return known.groupBy("state", "version", "mode").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.count("band").alias("n_banded"))


STATES_SQL = REPORTS_CTE + """
SELECT state, CAST(CASE state WHEN 'newer' THEN 2 WHEN 'read' THEN 1 END AS INT) AS version, CASE WHEN state = 'read' THEN CASE WHEN c % 2 = 0 THEN 'diff' ELSE 'scan' END END AS mode,
       count(*) AS n, CAST(min(CASE WHEN state = 'read' THEN c % 100 END) AS INT) AS least, CAST(max(CASE WHEN state = 'read' THEN c % 100 END) AS INT) AS most,
       count(CASE WHEN state = 'read' AND c % 2 = 1 THEN 1 END) AS n_banded
FROM s GROUP BY ALL
"""


class Surge(custom_rules.Rule):
    """A turn that is much longer than those before it, and conversations that end on the same role as they began."""

    rule, severity = "APP001", "low"
    partition_by, order_by, reads = ("conv_id",), ("turn", "role", "size"), ()
    options = {"percent": 200, "after": 2}

    def __init__(self, options: dict):
        super().__init__(options)
        self.n, self.total, self.first, self.last = 0, 0, None, None

    def see(self, row: Row) -> Iterator[custom_rules.Finding]:
        if self.n >= self.given["after"] and row.size * self.n * 100 > self.given["percent"] * self.total:
            yield custom_rules.Finding(row.turn, f"{row.size} characters after {self.n} turns of {self.total}", confidence=60, fingerprint=row.role or "")
        if self.n == 0:
            self.first = row
        self.n, self.total, self.last = self.n + 1, self.total + row.size, row

    def close(self) -> Iterator[custom_rules.Finding]:
        if self.n > 1 and self.first.role is not None and self.first.role == self.last.role:
            yield custom_rules.Finding(self.last.turn, "ends as it began", "info", 90, self.last.role)


def custom_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of a project's own over all conversations, called as a table function from SQL with an option."""
    custom_rules.register(spark, Surge, "surge_rule")
    sized = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    return spark.sql("SELECT * FROM surge_rule(TABLE(SELECT * FROM {rows}), percent => 150)", rows=sized)


CUSTOM_SQL = """
WITH t AS (SELECT conv_id, turn, role, CAST(coalesce(length(text), 0) AS BIGINT) AS size FROM conversations),
w AS (SELECT *, row_number() OVER o AS k, sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total,
             first_value(role) OVER o AS began, count(*) OVER (PARTITION BY conv_id) AS n
      FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, size))
SELECT conv_id, 'APP001' AS rule, 'low' AS severity, CAST(60 AS INT) AS confidence, CAST(turn AS BIGINT) AS line,
       size || ' characters after ' || (k - 1) || ' turns of ' || CAST(total AS BIGINT) AS message, coalesce(role, '') AS fingerprint
FROM w WHERE k > 2 AND size * (k - 1) * 100 > 150 * total
UNION ALL SELECT conv_id, 'APP001', 'info', CAST(90 AS INT), CAST(turn AS BIGINT), 'ends as it began', role FROM w WHERE k = n AND n > 1 AND role = began
"""

QUERIES = {
    "reports_read": (reports_read, REPORTS_SQL),
    "reports_by_state": (reports_by_state, STATES_SQL),
    "custom_rule_findings": (custom_rule_findings, CUSTOM_SQL),
}
