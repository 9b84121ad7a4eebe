from pyspark.sql import functions as F

from brindle.sources import php

SOURCE = '''<p>html</p>
<?php
namespace App; // trailing
#[Attr]
final class Order extends Model
{
    /* if ( { */
    abstract public function sum(array $x): int;
    public function store(int $a, string $b = "{$c}")
    {
        foreach ($a as $k) { if ($k) { while (1) { for (;;) { if ($b && $c) { $x = fn ($y) => $y; } } } } }
        $f = function () use ($a) { if ($a) { return 1; } };
        $o = new class { function inner() { return match (true) { default => 1 }; } };
        return <<<SQL
            select } from
            SQL;
    }
}
function free() { try { x(); } catch (\\Exception $e) { } }
// @phpstan-ignore-line argument.type
// @phpstan-ignore-line argument.type because the driver lies
?> <b>{</b>
'''


def test_lexer_owns_tokens():
    found, error = php.lex(SOURCE)
    assert error is None
    owners = {(t[3], t[4]) for t in found}
    assert owners == {(None, None), ("Order", None), ("Order", "sum"), ("Order", "store"), ("class@anonymous", None), ("class@anonymous", "inner"), (None, "free")}
    assert max(t[6] for t in found if t[4] == "store") == 5
    assert [t[2] for t in found if t[1] == "return"][-1] == 14
    assert php.lex("no code") == ([], None)
    assert php.lex("<?php /* x")[1] and php.lex("<?php function a() {")[1]


def test_units_and_detectors(spark):
    files = spark.createDataFrame([("a.php", SOURCE), ("b.php", None), ("c.php", "")], "path string, source string")
    rows = php.tokens(files)
    measured = {r.unit: r for r in php.units(rows).collect()}
    assert set(measured) == {"sum", "store", "inner", "free"}
    assert (measured["store"].nesting, measured["free"].complexity, measured["free"].statements) == (5, 2, 1)
    assert [(r.rule, r.fingerprint, r.confidence) for r in php.deep_nesting(php.units(rows)).collect()] == [("SL103", "Order::store", 78)]
    assert [r.line for r in php.unexplained_suppressions(rows).collect()] == [20]


GUARDED = '''<?php
class Quiet extends Base
{
    public function __construct(private Clock $clock, protected int $n) {}
    public function __call($name, $args) { return $this->{$name}(...$args); }
    private function reached() { return $this->clock; }
    #[Hook] private function marked() { return 1; }
    public function a($x) { try { $this->run(); } catch (E $e) { $this->failed = true; } return $x ?: 1; }
    public function b(?int $x, ?string $y): ?int { foreach ([1] as $k) { $r = DB::find($k); } return $x ? 1 : 2; }
    public function c() { /* TODO later */ return new static; }
}
'''


def test_guards_stay_silent(spark):
    from brindle.operators import detectors

    files = spark.createDataFrame([("q.php", GUARDED), ("n.php", None), ("t.txt", "no code")], "path string, source string")
    assert detectors.detect(php.tokens(files)).collect() == []


def test_god_methods_and_classes(spark):
    from brindle.operators import detectors

    body = "\n".join(f"if ($a > {k}) {{ $this->step{k}($a); }}" for k in range(20)) + "\n" * 80
    source = "<?php class Big { " + "".join(f"public function m{k}($a) {{ {body if k < 5 else ''} $x = 1; }}\n" for k in range(22)) + "}"
    found = detectors.detect(php.tokens(spark.createDataFrame([("b.php", source)], "path string, source string"))).collect()
    assert {r.fingerprint for r in found if r.rule == "SL101"} == {f"Big::m{k}" for k in range(5)}
    assert [(r.fingerprint, r.confidence) for r in found if r.rule == "SL102"] == [("Big", 82)]


def test_duplicates_drift_and_layers(spark):
    from brindle.operators import detectors

    step = lambda k, v: f"$x{k} = ${v}->run({k}, 'a{k}'); if ($x{k}) {{ $y = Order::find($x{k}); }} "
    body = lambda v, n=30: "".join(step(k, v) for k in range(n)) + "return $y;"
    drifted = body("m").replace("$x3 = $m->run(3, 'a3');", "$x3 = $m->run(3, 'a3', true);")
    files = [
        ("a.php", f"<?php namespace App\\Domain\\Shop; use App\\Http\\Kernel; use App\\Domain\\User\\Internal\\Key; class A {{ function one($m) {{ {body('m')} }} function two($q) {{ {body('q')} }} function few($m) {{ return 1; }} }}"),
        ("b.php", f"<?php namespace App\\Domain\\User; class B {{ function three($m) {{ {drifted} }} function send() {{ Http::get('x'); Http::get('y'); Log::info('z'); }} }}"),
    ]
    t = detectors.context(php.tokens(spark.createDataFrame(files, "path string, source string")))
    found = detectors.bodies(t)
    assert sorted(r.fingerprint for r in detectors.duplicate_bodies(found).collect()) == ["A::one", "A::two"]
    assert {r.confidence for r in detectors.duplicate_bodies(found).collect()} == {77}
    pairs = detectors.drifted_bodies(found).collect()
    assert [(r.rule, r.path, r.confidence) for r in pairs] == [("SL111", "a.php", 76)] and "by 2 of" in pairs[0].message
    refs = detectors.references(t)
    assert [r.fingerprint for r in detectors.layer_violations(refs, [("App\\Domain\\*", "App\\Http\\*")]).collect()] == ["App\\Domain\\Shop\\A->App\\Http\\Kernel"]
    crossing = detectors.boundary_violations(refs, r"^App\\Domain\\(\w+)\\", ["App\\Domain\\*\\Api\\*"], ["Shared"]).collect()
    assert [r.fingerprint for r in crossing] == ["App\\Domain\\Shop\\A->App\\Domain\\User\\Internal\\Key"]
    assert [(r.fingerprint) for r in detectors.forbidden_capabilities(t, [("B", ["http", "mail"])]).collect()] == ["B::send:http"]


def test_files_of_parts_are_dealt_and_written_rows_are_not_broadcast(spark, tmp_path):
    from brindle.plans import php_queries
    from brindle.session import written

    spark.range(50).selectExpr("id AS p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    files = php_queries.php_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism  # a task lexes what it is dealt
    assert files.count() == 17 * 2 + 17 + 16 * 2
    rows = written(files)
    plan = rows.join(rows.groupBy("path").count(), "path")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_parameters_of_all_functions_are_found_at_once(spark):
    from brindle.operators import detectors

    source = "<?php class A { function __construct(private B $b, int $c = 1) {} function m(?X $x = [1, 2], ...$rest) { if ($y) { $z = fn ($q) => 1; } } }\n?>\n<?php\nfunction f($last)\n{}"
    t = detectors.context(php.tokens(spark.createDataFrame([("a.php", source), ("b.php", "<?php f(1);")], "path string, source string")))
    found = detectors.parameters(t).join(detectors.functions(t).select("path", "from", F.col("name").alias("of"), "line"), ["path", "from"]).collect()
    assert sorted((r.of, r.name, r.type, r.promoted, r.line) for r in found) == [
        ("__construct", "b", "B", True, 1), ("__construct", "c", "int", False, 1), ("f", "last", None, False, 4), ("m", "rest", None, False, 1), ("m", "x", "X", False, 1),
    ]


def test_every_pair_of_drifted_bodies_is_found(spark):
    from brindle.operators import detectors

    n = 110  # more pairs than the 5,000 that were compared once
    rows = [(f"b{k:03}", f"f{k}.php", 1, "A", f"m{k:03}", ["a"] * 40 + [f"w{k}"], f"h{k:03}", 41) for k in range(n)]
    found = spark.createDataFrame(rows, "id string, path string, line int, class_name string, unit string, tokens array<string>, hash string, n_tokens int")
    pairs = detectors.drifted_bodies(found).collect()
    assert {r.fingerprint for r in pairs} == {f"A::m{a:03}~b{b:03}" for a in range(n) for b in range(a + 1, n)} and len(pairs) == n * (n - 1) // 2
    assert {(r.message.split(" by ")[1], r.confidence) for r in pairs} == {("1 of 41 tokens", 76)}


def test_what_lies_within_a_file_is_neither_shuffled_nor_sorted(spark):
    from brindle.operators import detectors

    files = spark.createDataFrame([("a.php", SOURCE), ("b.php", GUARDED), ("c.php", None)], "path string, source string")
    t = detectors.context(php.tokens(files))
    for rows in (t, php.units(php.tokens(files)), detectors.functions(t), detectors.calls(t)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not any(step in plan for step in ("Exchange", "Window", "Sort"))


def test_tokens_that_are_asked_for_give_all_facts(spark):
    from brindle.operators import detectors

    long = "class L { use T, \\N\\U { a as b; } function m($a, ?B $b = [1]) { " + "$x = $a ? ($b ? 1 : 2) : K::f('s', [$this, 'g']); " * 9 + "} }"
    files = spark.createDataFrame([("a.php", SOURCE), ("b.php", GUARDED), ("c.php", f"<?php namespace A\\B; use C\\D; {long} class M implements I, \\J {{ }}")], "path string, source string")
    whole, some = detectors.context(php.tokens(files)), detectors.context(php.tokens(files, whole=False))
    assert 0 < some.count() < whole.count()
    facts = (detectors.functions, detectors.parameters, detectors.calls, detectors.class_facts, detectors.trait_uses, detectors.bodies, detectors.references, php.units, detectors.nested_ternaries)
    for make in facts:
        assert sorted(map(str, make(some).collect())) == sorted(map(str, make(whole).collect())) != []
    assert {r.trait for r in detectors.trait_uses(some).collect()} == {"T", "U"}
    assert [r.n_tokens for r in detectors.bodies(some).collect()] == [1 + 9 * 25 + 1]


def test_files_of_a_batch_do_not_touch():
    files = [("a", "<?php class A { function f() { if ("), ("b", "<?php // c\n$x = '"), ("c", None), ("d", "<?php } ) ; g();"), ("e", "<?php catch (E $e) {"), ("f", "<?php } 'a\\")]
    rows, left = php._tokens_of(files)
    got = [tuple(r.values()) for r in rows.select(["path", "kind", "text", "class_name", "unit", "b1", "a1", "paren", "brace", "stops", "held"]).to_pylist()]
    assert left == [0, 4]
    alone = [(p, k, t, c, u) for p, source in files for k, t, _, c, u, *_ in php.lex(source or "")[0]]
    assert [g[:5] for g in got] == alone
    assert [g[1:] for g in got if g[0] == "d"][0] == ("operator", "}", None, None, "", ")", 0, 0, 1, None)
    assert [g[1:3] for g in got if g[0] in "bf"] == [("comment", "// c"), ("variable", "$x"), ("operator", "="), ("string", "'"), ("operator", "}"), ("operator", "'"), ("name", "a"), ("operator", "\\")]
    assert all(g[-1] is None for g in got)
