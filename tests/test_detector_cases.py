"""Cases that a detector must tell apart."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import detectors
from brindle.sources import php


def findings(spark, rule, *sources):
    files = spark.createDataFrame([(f"f{k}.php", f"<?php {s}") for k, s in enumerate(sources)], "path string, source string")
    t = detectors.context(php.tokens(files))
    found = {"SL106": detectors.unused_dependencies, "SL107": detectors.swallowed_exceptions, "SL211": lambda t: detectors.missing_actions(detectors.routes(t), t)}[rule](t)
    return [(r.path, r.fingerprint, r.confidence) for r in found.collect()]


def test_catch_blocks_within_catch_blocks(spark):
    nested = r"function f() { try { a(); } catch (\Throwable $e) { try { b(); } catch (\Exception $x) { report($x); } throw $e; } }"
    quiet = r"function g() { try { a(); } catch (\Throwable $e) { try { $y = 1; } catch (\Exception $x) { } $z = 2; } }"
    assert findings(spark, "SL107", nested) == []
    assert sorted(findings(spark, "SL107", quiet)) == [("f0.php", "g:Exception", 96), ("f0.php", "g:Throwable", 84)]


def test_dependencies_by_visibility_and_traits(spark):
    shown = "class A { public function __construct(public Repo $shown, readonly Repo $ro, private readonly ?Repo $hidden, protected Repo $mine) {} }"
    base = "class B { public function __construct(protected Repo $kept) {} } class C extends B {}"
    lent = "trait T { function go() { return $this->tool; } } class D { use T; public function __construct(private Repo $tool, private Repo $idle) {} }"
    dark = "class E { use Unknown; public function __construct(private Repo $x) {} }"
    assert sorted(f for _, f, _ in findings(spark, "SL106", shown, base, lent, dark)) == ["A::hidden", "A::mine", "D::idle"]


@pytest.mark.parametrize("code, n", [
    ("($a ? 1 : 2) + ($b ? 3 : 4)", 0), ("$a ? ($b ? 1 : 2) : 3", 1), ("($a ? $b : $c) ? 1 : 2", 1), ("f($a ? 1 : 2, $b ? 3 : 4)", 0), ("$a ? f($b ? 1 : 2) : 3", 0),
    ("$a ? $b ? 1 : 2 : 3", 1), ("$a ?: ($b ?: $c)", 0), ("$a ? 1 : ($b ? 2 : ($c ? 3 : 4))", 1), ("[$a ? 1 : 2, $b ? 3 : 4]", 0), ("$a ? 1 : ($b ? 2 : 3) + 1", 0),
])
def test_ternaries(spark, code, n):
    tokens = php.tokens(spark.createDataFrame([("a.php", f"<?php function f() {{ return {code}; }}")], "path string, source string"))
    assert detectors.nested_ternaries(detectors.context(tokens)).count() == n


def test_routes_to_methods_of_traits(spark):
    route = "Route::get('a', [{0}::class, 'export']); Route::get('b', [{0}::class, 'gone']);"
    ctrl = "trait Exports { public function export() {} } class OneController { use Exports; public function index() {} }"
    magic = "class MagicController { public function __call($n, $a) {} }"
    twice = ("namespace A; class TwoController { public function index() {} }", "namespace B; class TwoController { public function export() {} }")
    found = findings(spark, "SL211", *[route.format(c) for c in ("OneController", "MagicController", "TwoController")], ctrl, magic, *twice)
    assert [f for _, f, _ in found] == ["OneController::gone"]


UNWRITTEN = ["Not implemented", "not yet implemented.", "This method is not implemented yet!", "Unimplemented", "TODO: wire up refunds", "To be implemented by the next team", "Method export() is not implemented.", "This is just a stub", "stub method", "implement me"]
WRITTEN = ["Method not implemented by Laravel.", "Cannot stub a final class", "Todos are not supported", "The implementation is missing a key", "", "is implemented"]
ELIDED = ["... existing code ...", "... rest", "… unchanged", "rest of the code", "The remainder of your method", "... add your own logic here", "put business logic here", "your implementation goes here", "... handle errors ..."]
PROSE = ["...", "the rest of the code assumes that a tenant is set", "add a row here", "existing rows", "logic", "", "rest of the world", "- rest of code"]


def test_remarks(spark):
    rows = spark.createDataFrame([(t,) for t in [*UNWRITTEN, *WRITTEN, *ELIDED, *PROSE]], "t string").select("t", detectors.unwritten(F.col("t")).alias("u"), detectors.elided(F.col("t")).alias("e")).collect()
    assert {r.t for r in rows if r.u} == set(UNWRITTEN)
    assert {r.t for r in rows if r.e} == set(ELIDED)
