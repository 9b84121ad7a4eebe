import pytest
from pyspark.sql import functions as F

from brindle.functions.findings import band, identity, lowered, tier
from brindle.operators import risk, scoring

FIELDS = "rule string, severity string, confidence int, path string, line long, end_line long"


def score_of(spark, findings, lines, settings=scoring.ScoreSettings()):
    return scoring.score(spark.createDataFrame(findings, FIELDS), spark.createDataFrame([(lines,)], "lines long"), [], settings).first()


@pytest.mark.parametrize("second, expected", [("a.php", 80), ("b.php", 79)])
def test_nested_spans_count_once_in_a_file(spark, second, expected):
    rows = [("R1", "high", 90, "a.php", 1, 100), ("R2", "high", 90, second, 20, 69)]
    assert score_of(spark, rows, 1000, scoring.ScoreSettings(rule_cap=0.0)).score == expected


@pytest.mark.parametrize("cap, expected", [(0.0, 0), (30.0, 70)])
def test_one_rule_is_capped(spark, cap, expected):
    rows = [("R1", "high", 100, f"f{k}.php", 1, None) for k in range(30)]
    assert score_of(spark, rows, 1000, scoring.ScoreSettings(rule_cap=cap)).score == expected


def test_no_findings_score_full(spark):
    found = score_of(spark, [], 500)
    assert (found.score, found.band, found.penalty) == (100, "clean", 0.0)


def test_no_lines_divide_by_nothing(spark):
    assert score_of(spark, [("R1", "low", 50, "a", 1, 1)], 0).score == 99


def test_risk_golden(spark):
    row = spark.range(1).select(risk.risk(F.lit("high"), F.lit(76), F.lit(1), F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(True), F.lit(True)).alias("r")).first()
    assert round(row.r, 2) == 9.89


def test_unmeasured_is_not_zero(spark):
    none = spark.range(1).select(risk.risk(F.lit("high"), F.lit(100), F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("int")).alias("a"), risk.risk(F.lit("high"), F.lit(100), F.lit(0), F.lit(0.0), F.lit(0)).alias("b")).first()
    assert (none.a, none.b) == (10.0, 15.0)


def test_vocabulary(spark):
    import hashlib

    row = spark.range(1).select(
        identity(F.lit("R"), F.lit("p"), F.lit("f")).alias("i"), band(F.lit(74)).alias("b"), tier(F.lit("performance")).alias("t"),
        tier(F.lit("x"), F.lit("R"), {"R": "advisory"}).alias("o"), lowered(F.lit("critical"), F.lit("low")).alias("l"),
    ).first()
    assert row.i == hashlib.sha256(b"R\0p\0f").hexdigest()[:16]
    assert (row.b, row.t, row.o, row.l) == ("needs_attention", "defect", "advisory", "low")
