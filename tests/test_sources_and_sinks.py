import json

import pytest
from pyspark.sql import functions as F

from brindle.functions.findings import identity
from brindle.operators import sinks
from brindle.sources import files


def findings(spark):
    rows = [
        {"rule": "R1", "name": "One", "category": "performance", "severity": "high", "confidence": 90, "path": "a,b.php", "line": 3, "message": "100% \n x", "fingerprint": "f"},
        {"rule": "R1", "name": "One", "category": "performance", "severity": "high", "confidence": 90, "path": "a,b.php", "line": 9, "message": "again", "fingerprint": "f"},
        {"rule": "R0", "name": "Zero", "category": "naming", "severity": "info", "confidence": 10, "path": "c.php", "line": 1, "end_line": 4, "message": "m|m", "fingerprint": "g"},
    ]
    return files.findings_from(spark, rows).withColumn("identity", identity(F.col("rule"), F.col("path"), F.col("fingerprint")))


def test_formats(spark):
    rows = findings(spark)
    score = spark.createDataFrame([(88, "healthy", 1.0, 1.0)], "score int, band string, penalty double, density double")
    report = json.loads(sinks.to_json(rows, score).first().document)
    assert report["total"] == 3 and [f["location"]["line"] for f in report["findings"]] == [3, 9, 1]
    assert len({f["key"] for f in report["findings"]}) == 3 and report["findings"][0]["tier"] == "defect"
    run = json.loads(sinks.to_sarif(rows).first().document)["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["R0", "R1"] and [r["level"] for r in run["results"]] == ["error", "error", "note"]
    assert sinks.to_annotations(rows).first().value == "::error file=a%2Cb.php,line=3,title=R1 One::100%25 %0A x"
    issues = [json.loads(r.value) for r in sinks.to_code_quality(rows).collect()]
    assert {i["severity"] for i in issues} == {"critical", "info"} and len({i["fingerprint"] for i in issues}) == 3
    assert "m\\|m" in sinks.to_markdown(rows).collect()[2].value


def test_graph_lines(spark):
    edges = spark.createDataFrame([("a", "b", 2, 1)], "s string, t string, n long, n_forbidden long")
    assert sinks.to_graph(edges, "s", "t").first().value == "  a -.->|2| b"
    assert sinks.to_graph(edges, "s", "t", "dot").first().value == '  "a" -> "b" [label="2" color=red];'


def test_name_status_and_hunks(spark):
    raw = spark.createDataFrame([("M\0a.php\0R090\0old.php\0new.php\0A\0c.php\0",)], "raw string")
    assert [tuple(r)[1:] for r in files.name_status(raw).collect()] == [("M", None, "a.php"), ("R", "old.php", "new.php"), ("A", None, "c.php")]
    text = ["--- a/x.php", "+++ b/x.php", "@@ -1 +1,2 @@", "+y", "@@ -9,2 +10,0 @@", "+++ /dev/null", "@@ -1,2 +0,0 @@"]
    found = files.diff_hunks(spark.createDataFrame(list(enumerate(text)), "n long, line string")).collect()
    assert [(r.path, [tuple(h) for h in r.hunks]) for r in found] == [("x.php", [(1, 2), (10, 0)])]


def test_coverage_reports(spark, tmp_path):
    a, b = tmp_path / "clover.xml", tmp_path / "cobertura.xml"
    a.write_text('<coverage><project><file name="/r/a.php"><metrics statements="4" coveredstatements="3"/></file><file name="/r/b.php"><metrics statements="0" coveredstatements="0"/></file></project></coverage>')
    b.write_text('<coverage><packages><package><classes><class filename="a.php" line-rate="1.7"/><class filename="b.php" line-rate="0.25"/></classes></package></packages></coverage>')
    assert {tuple(r) for r in files.clover(spark, str(a), "/r").collect()} == {("a.php", 0.75), ("b.php", 1.0)}
    assert {tuple(r) for r in files.cobertura(spark, str(b)).collect()} == {("a.php", 1.0), ("b.php", 0.25)}


def test_source_tree(spark, tmp_path):
    for path, text in {"app/A.php": "<?php\n// c\n\n$x;\n", "routes/web.php": "<?php", "database/migrations/m.php": "\n", "vendor/v.php": "", ".git/h.php": "", "app/n.txt": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = files.source_tree(spark, str(tmp_path), exclude=["vendor"])
    assert {(r.path, r.kind, r.code_lines) for r in found.collect()} == {("app/A.php", "code", 2), ("routes/web.php", "routes", 1), ("database/migrations/m.php", "migration", 0)}


def test_baseline_round_trip(spark, tmp_path):
    entries = files.baseline_of(findings(spark)).collect()
    assert [(e.path, e["count"]) for e in entries] == [("a,b.php", 2), ("c.php", 1)]
    doc = tmp_path / "baseline.json"
    doc.write_text(json.dumps({"schema": 1, "entries": [{"id": e.id, "rule": e.rule, "file": e.path, "fingerprint": e.fingerprint, "count": e["count"], "message": e.message} for e in entries] + [{"id": None}]}))
    assert files.read_baseline(spark, str(doc)).count() == 2


def test_counted_baseline(spark):
    text = ["parameters:", "  ignoreErrors:", "    -", "      message: '#x#'", "      count: 2", "      path: a.php", "    -", "      count: 3", "      path: a.php"]
    assert [tuple(r) for r in files.counted_baseline(spark.createDataFrame(list(enumerate(text)), "n long, line string")).collect()] == [("a.php", 5)]


def compared(spark):
    rows = files.findings_from(spark, [
        {"rule": "R1", "name": "one", "category": "performance", "severity": "high", "confidence": 90, "path": "a.php", "line": 3, "message": "m1", "fingerprint": "x"},
        {"rule": "R2", "name": "two", "category": "other", "severity": "low", "confidence": 50, "path": "b.php", "line": 1, "message": None, "fingerprint": "y"},
        {"rule": "R2", "name": "two", "category": "other", "severity": "low", "confidence": 60, "path": None, "line": None, "message": "m3", "fingerprint": "z"},
    ])
    state = F.when(F.col("fingerprint") == "x", "new").when(F.col("fingerprint") == "y", "existing").otherwise("resolved")
    return rows.withColumns({"state": state, "identity": F.col("fingerprint"), "risk": F.col("confidence").cast("double"), "in_hunk": F.lit(True)})


def test_diff_and_reading_formats(spark):


    rows = compared(spark)
    assert [r.value for r in sinks.to_diff(rows).collect()] == ["+ a.php:3 R1 m1", "- :1 R2 m3"]
    assert sinks.diff_counts(rows).first().asDict() == {"new": 1, "existing": 1, "resolved": 1}
    document = json.loads(sinks.diff_document(rows).first().document)
    assert (document["counts"]["new"], [f["rule"] for f in document["new"]], [f["fingerprint"] for f in document["resolved"]]) == (1, ["R1"], ["z"])
    assert [r.value for r in sinks.to_review(rows).collect()] == ["| 90.0 | `a.php:3` | R1 (changed here) |"]
    assert sinks.diff_annotations(rows).count() == 1 and all(r.value for r in sinks.to_annotations(rows).collect())
    edited = spark.createDataFrame([("a.php",)], "path string")
    assert [r.value for r in sinks.to_feedback(rows, edited).collect()] == ["a.php:3  [high 90%] R1 m1"]
    assert sinks.to_fixer(rows, ["R2"]).first().asDict() == {"rules": ["R2"], "paths": ["b.php"]}
    assert [r.value for r in sinks.to_triage(rows.where("path IS NOT NULL"), 1).collect()] == ["a.php:3  R1"]
    assert {name: f(rows).count() > 0 for name, f in sinks.FORMATS.items()} == dict.fromkeys(sinks.FORMATS, True)


def test_baselines_coverage_and_settings(spark, tmp_path):
    files.write_baseline(compared(spark).where("path IS NOT NULL"), str(tmp_path / "base"), 90, "2024-01-01T00:00:00Z")
    assert [(r.id, r.path, r["count"]) for r in files.read_baseline(spark, str(tmp_path / "base")).collect()] == [("x", "a.php", 1), ("y", "b.php", 1)]
    assert files.find_coverage(spark, str(tmp_path)) is None
    (tmp_path / "coverage.xml").write_text('<?xml version="1.0"?>\n<coverage line-rate="0.5">\n<class filename="a.php" line-rate="0.25"></class>\n</coverage>')
    assert [tuple(r) for r in files.find_coverage(spark, str(tmp_path)).collect()] == [("a.php", 0.25)]
    with pytest.raises(FileNotFoundError):
        files.find_coverage(spark, str(tmp_path), "none.xml")
    (tmp_path / "composer.json").write_text('{"autoload": {"psr-4": {"App\\\\": "app/"}}, "require": {"php": "^8", "x/y": "1"}, "require-dev": {"x/y": "2", "z/z": "1"}}')
    roots, packages = files.composer(spark, str(tmp_path / "composer.json"))
    assert [tuple(r) for r in roots.collect()] == [("App\\", "app/")] and sorted(r.package for r in packages.collect()) == ["php", "x/y", "z/z"]
    (tmp_path / "psalm.xml").write_text('<files>\n <file src="a.php">\n  <X><code>1</code><code>2</code></X>\n </file>\n <file src="b.php"><Y><code><![CDATA[z]]></code></Y></file>\n</files>')
    assert sorted(tuple(r) for r in files.suppressed_issues(spark, str(tmp_path / "psalm.xml")).collect()) == [("a.php", 2), ("b.php", 1)]
    row = spark.createDataFrame([("app/x.php",), ("app",), ("apple/x.php",), ("app/vendor/y.php",)], "path string")
    assert [r.path for r in row.where(files.covers(F.col("path"), ["app/"], ["vendor"])).collect()] == ["app/x.php", "app"]
    assert files.checked_config({"top": 3}, {"top": int}) == {"top": 3}
    with pytest.raises(ValueError, match="did you mean top"):
        files.checked_config({"tpo": 3}, {"top": int})


def test_facts_are_kept_by_stamp(spark):
    from brindle.streaming.watch import Facts, listing  # noqa: F401

    parsed = []

    def parse(rows):
        parsed.append(sorted(r.path for r in rows.collect()))
        return rows.select("path", F.concat("path", F.lit("!"), "stamp").alias("fact"))

    facts = Facts(parse)
    table = lambda *rows: spark.createDataFrame(list(rows), "path string, stamp string")
    facts.sync(table(("a", "1"), ("b", "1"), ("c", "1")))
    rows = facts.sync(table(("a", "1"), ("b", "2"), ("d", "1"))).collect()
    assert parsed == [["a", "b", "c"], ["b", "d"]] and sorted(r.fact for r in rows) == ["a!1", "b!2", "d!1"]
