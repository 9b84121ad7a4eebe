import json

import pytest
from pyspark.sql import functions as F

from brindle.engine import Engine
from brindle.operators import custom_rules, sinks
from brindle.plans.rule_queries import Surge
from brindle.sources import reports


def _parsed(spark, texts):
    return reports.parsed(spark.createDataFrame(list(enumerate(texts)), "id int, value string")).checkpoint()


def test_reports_are_told_apart(spark):
    texts = [None, "", "{", "[1]", "3", "{}", '{"schema": "1"}', '{"schema": 1.5}', '{"schema": 2, "findings": [{}]}', '{"schema": 1}', '{"schema": 1, "findings": 3}', '{"schema": null}']
    found = _parsed(spark, texts)
    states = [r.state for r in found.orderBy("id").collect()]
    assert states == ["corrupt"] * 5 + ["foreign"] * 3 + ["newer", "read", "read", "foreign"]
    assert reports.findings(found, ["id"]).count() == 0
    assert _parsed(spark, []).count() == 0


def test_a_diff_report_keeps_what_it_does_not_know(spark):
    text = json.dumps({
        "schema": 1, "mode": "diff", "score": {"base": {"value": 84}, "current": {"value": 82, "band": "healthy", "penalty": 17.8}, "delta": -2},
        "new": [{"rule": "SL107", "file": "a.php", "line": 3, "end_line": 4, "confidence": 90, "risk": 9.6, "owner": {"team": ["x"]}, "blast_radius": None}, 5, {"line": "seven", "rule": 8}],
        "existing": [], "resolved": [{"rule": "SL101", "file": "b.php", "line": 1}], "errors": {},
    })
    found = _parsed(spark, [text])
    r = found.first()
    assert (r.mode, r.version, r.score, r.band, r.penalty) == ("diff", 1, 82, "healthy", 17.8)
    rows = reports.findings(found, ["id"]).withColumn("more", F.to_json(F.map_values("more"))).orderBy("list", "at").collect()
    assert [(r.list, r.at, r.rule, r.path, r.line, r.risk) for r in rows] == [("new", 0, "SL107", "a.php", 3, 9.6), ("new", 1, None, None, None, None), ("new", 2, "8", None, None, None), ("resolved", 0, "SL101", "b.php", 1, None)]
    assert json.loads(rows[0].more) == [None, {"team": ["x"]}]


def test_a_written_report_is_read_back(spark):
    source = "<?php\nclass A {\n  function f() { try { g(); } catch (\\Throwable $e) { } }\n}\n"
    engine = Engine(spark, _files(spark, "src/A.php", source))
    found = engine.findings()
    text = sinks.to_json(found, engine.score()).first().document
    read = _parsed(spark, [text])
    columns = ["rule", "name", "category", "severity", "confidence", "path", "line", "end_line", "message", "fingerprint"]
    back = reports.findings(read, ["id"])
    assert sorted(map(tuple, back.select(*columns).collect())) == sorted(map(tuple, found.select(*columns).collect())) != []
    assert read.first().score == engine.score().first().score


def _files(spark, path, source):
    return spark.createDataFrame([(path, source, "code", 4)], "path string, source string, kind string, code_lines int")


class Calls(custom_rules.Rule):
    rule, order_by, reads = "APP002", ("pos",), ("text",)
    options = {"name": "dd"}

    def see(self, row):
        if row.text == self.given["name"]:
            yield custom_rules.Finding(row[self.order_by[0]], f"calls {row.text}")


def test_a_rule_is_called_from_sql_and_from_python(spark):
    rows = spark.createDataFrame([("a", 1, "dd"), ("a", 2, "x"), (None, 3, "dd"), (None, 4, "x"), ("b", 5, "y")], "path string, pos long, text string")
    found = sorted(custom_rules.run(rows, Calls).collect(), key=repr)
    assert [(r.path, r.rule, r.severity, r.line, r.message) for r in found] == [("a", "APP002", "medium", 1, "calls dd"), (None, "APP002", "medium", 3, "calls dd")]
    name = custom_rules.register(spark, Calls)
    assert [r.line for r in spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM {{rows}}), name => 'x') ORDER BY line", rows=rows).collect()] == [2, 4]
    assert custom_rules.run(rows.limit(0), Calls).count() == 0
    assert [r.line for r in custom_rules.run(rows.withColumn("path", F.lit(7)), Calls, name="y").collect()] == [5]  # the key keeps its type


@pytest.mark.parametrize(("given", "says"), [({"nam": "x"}, "no option nam"), ({"name": 3}, "must be of type str")])
def test_options_are_checked_when_planned(spark, given, says):
    rows = spark.createDataFrame([("a", 1, "dd")], "path string, pos long, text string")
    with pytest.raises(Exception, match=says):
        custom_rules.run(rows, Calls, **given)


def test_columns_are_checked_when_planned(spark):
    custom_rules.register(spark, Calls)
    with pytest.raises(Exception, match="lacks text"):
        spark.sql("SELECT * FROM app002(TABLE(SELECT 'a' AS path, 1L AS pos))")


def test_a_partition_has_a_rule_of_its_own(spark):
    rows = spark.createDataFrame([(1, 0, "u", 10), (1, 1, "a", 10), (1, 2, "u", 50), (2, 0, "u", 9)], "conv_id long, turn int, role string, size long")
    found = custom_rules.run(rows, Surge).collect()
    assert sorted((r.conv_id, r.line, r.severity) for r in found) == [(1, 2, "info"), (1, 2, "low")]


def test_the_engine_takes_a_custom_rule(spark):
    class Named(Calls):
        order_by, options = ("n",), {"name": "g"}

    engine = Engine(spark, _files(spark, "A.php", "<?php\nfunction f() { return g(1); }\n"), [custom_rules.for_engine(Named)])
    assert [(r.rule, r.path, r.severity) for r in engine.findings().where("rule = 'APP002'").collect()] == [("APP002", "A.php", "medium")]
