import json
import subprocess

import pytest
from pyspark.sql import functions as F

from brindle.__main__ import options, run
from brindle.engine import FOUND, OK, Engine, assert_clean, assert_score
from brindle.operators.detectors import Policies
from brindle.plans.php_queries import EXPECTED, FILES
from brindle.sources import files, repository


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, source in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(source)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    controller = root / "app/Http/Controllers/OrderController.php"
    controller.write_text(controller.read_text().replace("private function never() { return 0; }\n", "private function unread() { return 0; }\n"))
    (root / "app/Gateways/Stripe.php").rename(root / "app/Gateways/Paying.php")
    git("add", "-A", "app/Gateways")
    (root / "new.php").write_text("<?php\n")
    return str(root)


def test_engine_over_a_tree(spark, project):
    def custom(tokens):
        return tokens.where("text = 'report'").select(F.lit("X1").alias("rule"), F.lit("info").alias("severity"), F.lit(50).alias("confidence"), "path", F.col("line").cast("long"), F.lit("m").alias("message"), F.lit("f").alias("fingerprint"))

    engine = Engine(spark, repository.tree_at(spark, project, "HEAD"), [custom])
    # rules that read code only leave out what lies in migrations and routes
    wanted = {(r, p, f) for r, _, _, p, _, f in EXPECTED}
    assert {(r.rule, r.path, r.fingerprint) for r in engine.findings().where("rule <> 'X1'").collect()} == wanted
    assert [r.rule for r in engine.findings(rules=["x1"]).collect()] == ["X1"]
    assert engine.exit_code("high") == FOUND and engine.exit_code("critical") == OK
    assert engine.score().first().score < 100 and engine.health().first().by_severity["high"] == 7
    risks = [r.risk for r in engine.ranked().collect()]
    assert risks == sorted(risks, reverse=True)
    assert engine.without(files.baseline_of(engine.findings())).count() == 0
    assert_score(engine.score(), 1)
    with pytest.raises(AssertionError):
        assert_clean(engine.findings())


def test_working_copy_against_a_revision(spark, project):
    assert {(r.path, r.status, r.previous_path) for r in repository.changed(spark, project, "HEAD").collect()} == {
        ("app/Http/Controllers/OrderController.php", "M", None), ("app/Gateways/Paying.php", "R", "app/Gateways/Stripe.php"), ("new.php", "A", None),
    }
    found = {r.path: [tuple(h) for h in r.hunks] for r in repository.hunks(spark, project, "HEAD").collect()}
    assert found == {"app/Http/Controllers/OrderController.php": [(22, 1)]}
    assert {r.path: r.changes for r in repository.history(spark, project).collect()} == dict.fromkeys(FILES, 1)
    now, base = (Engine(spark, t) for t in (files.source_tree(spark, f"file://{project}"), repository.tree_at(spark, project, "HEAD")))
    states = {(r.fingerprint, r.state) for r in now.against(base).where("state <> 'existing'").collect()}
    assert states == {("OrderController::unread", "new"), ("OrderController::never", "resolved")}


def _tree(spark, sources):
    return spark.createDataFrame([(p, f"<?php\n{s}\n", "code", 4) for p, s in sources.items()], "path string, source string, kind string, code_lines int")


def test_rules_run_off_or_skipped(spark):
    loop = "class A {\n function f($x) { foreach ($x as $y) { User::find($y); } try { g(); } catch (\\Throwable $e) { } }\n}"
    engine = Engine(spark, _tree(spark, {"a.php": loop}), frameworks=[], disabled=["sl211"])
    assert {r.rule for r in engine.findings().collect()} == {"SL107"}  # plain code has no models, so nothing queries in the loop
    states = lambda e: {r.rule: r.state for r in e.plan().collect()}
    plan = states(engine)
    assert (plan["SL107"], plan["SL204"], plan["SL211"], plan["SL304"]) == ("run", "skipped", "off", "off")
    assert states(Engine(spark, engine.files))["SL204"] == states(Engine(spark, engine.files, frameworks=["laravel"]))["SL204"] == "run"


def test_declared_policies_are_findings_of_a_scan(spark):
    sources = {
        "src/Domain/Order.php": "namespace App\\Domain;\nuse App\\Http\\Page;\nclass Order { function f() { Http::get('x'); } }",
        "src/Billing/Bill.php": "namespace App\\Billing;\nuse App\\Stock\\Inner\\Shelf;\nuse App\\Stock\\Api\\Shop;\nclass Bill { }",
    }
    policies = Policies(layers=(("App\\Domain\\*", "App\\Http\\*"),), module=r"^App\\(Billing|Stock)\\", public=("App\\Stock\\Api\\*",), capabilities=(("Order", ("http",)),))
    found = Engine(spark, _tree(spark, sources), frameworks=[], policies=policies).findings()
    assert {(r.rule, r.name, r.category, r.fingerprint) for r in found.where("rule LIKE 'SL3%'").collect()} == {
        ("SL304", "Layer Violation", "architecture", "App\\Domain\\Order->App\\Http\\Page"),
        ("SL305", "Forbidden Capability", "architecture", "Order::f:http"),
        ("SL306", "Boundary Violation", "architecture", "App\\Billing\\Bill->App\\Stock\\Inner\\Shelf"),
    }


def test_frameworks_of_the_package_file(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert files.frameworks(spark, root) == []
    for text, expected in (('{"require": {"php": "^8"}}', []), ('{"require-dev": {"illuminate/support": "*"}}', ["laravel"])):
        (tmp_path / "composer.json").write_text(text)
        assert files.frameworks(spark, root) == expected


def test_commands(spark, project, tmp_path):
    root, lines = f"file://{project}", []
    ask = lambda *args: run(spark, options([args[0], root, "--framework", "none", *args[1:]]), lines.append)
    accepted = str(tmp_path / "accepted")
    assert ask("baseline", "--baseline", accepted) == OK
    assert ask("scan", "--baseline", accepted, "--fail-on", "info", "--format", "json") == OK
    assert [json.loads(x)["total"] for x in lines] == [0]
    for wrong in (["diff", root, "--format", "sarif"], ["baseline", root]):
        with pytest.raises(SystemExit):
            options(wrong)
