"""The detectors over PHP files made for every row of ``part``, with what they must find in them.

The supplied tables hold no PHP, so each part stands for a few files, with its key in the names of its classes; the
findings of a set of files are derived by hand, and the oracle joins them with the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.operators import detectors
from brindle.session import dealt, table
from brindle.sources import php

#: ``@`` stands for the part's key; parts of one remainder get the files of one kind.
TEMPLATES = {
    "app/Http/Controllers/Order@Controller.php": """<?php
namespace App\\Http\\Controllers;
class Order@Controller extends Base@
{
    public function __construct(private Repo $repo, private Mailer $mailer, private Clock $clock, private Log $log, private Bus $bus) {}
    public function index() { return $this->repo->all($this->clock, $this->log, $this->bus); }
    public function show($id)
    {
        foreach ($this->ids() as $k) {
            $x = Order::find($k);
            $y = Order::all();
        }
        return $id ? ($x ? 1 : 2) : 3;
    }
    public function risky()
    {
        try { $this->show(1); } catch (\\Exception $e) { }
        try { $this->show(2); } catch (NotFound $e) { return null; }
        try { $this->show(3); } catch (\\Throwable $e) { report($e); }
    }
    private function ids() { return [1, 2]; }
    private function never() { return 0; }
    private function named() { return 0; }
    public function map() { return array_map([$this, 'named'], []); }
    public function many($a, $b, $c, $d, $e, $f, $g, $h = [1, 2]) { return $a; }
    public function later() { throw new \\LogicException('Not implemented yet'); }
    public function part()
    {
        // ... existing code
        return true;
    }
}
class Base@ {}
""",
    "routes/web@.php": """<?php
Route::get('orders', [Order@Controller::class, 'index']);
Route::get('orders/{id}/delete', [Order@Controller::class, 'show']);
Route::get('clear', [Order@Controller::class, 'destroy']);
Route::post('orders/remove', [Order@Controller::class, 'risky']);
""",
    "database/migrations/2024_01_01_orders@.php": """<?php
return new class extends Migration {
    public function up()
    {
        Schema::create('orders', function ($table) {
            $table->foreignId('user_id');
            $table->foreignId('shop_id')->constrained();
        });
        Order::query();
        Order::count();
    }
    public function down() {}
};
""",
    "app/Contracts/Gateway@.php": "<?php interface Gateway@ { public function pay($x); }\n",
    "app/Gateways/Stripe@.php": "<?php final class Stripe@ implements Gateway@ { public function pay($x) { return $x; } }\n",
}


def kind_of(path: str) -> int:
    return 1 if "migrations" in path else 2 if "Gateway" in path else 0


#: One set of the files.
FILES = {path.replace("@", ""): source.replace("@", "") for path, source in TEMPLATES.items()}


def php_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, source): for every part the files of its kind, with its key in their names."""
    templates = spark.createDataFrame([(kind_of(path), path, source) for path, source in TEMPLATES.items()], "kind int, path string, source string")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), (F.col("p_partkey") % 3).cast("int").alias("kind"))
    part = dealt(part, "key")  # a part stands for many tokens, and a file of parts is one task
    return part.join(F.broadcast(templates), "kind").select(*[F.replace(c, F.lit("@"), F.col("key")).alias(c) for c in ("path", "source")])


def php_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.detect(php.tokens(php_files(spark, sf_dir), whole=False)).select("rule", "severity", "confidence", "path", "line", "fingerprint")


_C, _M, _R = "app/Http/Controllers/Order@Controller.php", "database/migrations/2024_01_01_orders@.php", "routes/web@.php"
FINDINGS = [
    ("SL206", "medium", 82, _C, 5, "Order@Controller"),
    ("SL106", "medium", 88, _C, 5, "Order@Controller::mailer"),
    ("SL204", "medium", 84, _C, 10, "Order@Controller::show:Order:find"),
    ("SL210", "medium", 88, _C, 11, "Order@Controller::show:Order"),
    ("SL114", "low", 90, _C, 13, "Order@Controller::show#1"),
    ("SL107", "high", 96, _C, 17, "Order@Controller::risky:Exception"),
    ("SL107", "high", 66, _C, 18, "Order@Controller::risky:NotFound"),
    ("SL105", "medium", 88, _C, 22, "Order@Controller::never"),
    ("SL113", "medium", 78, _C, 25, "Order@Controller::many"),
    ("SL112", "high", 90, _C, 26, "Order@Controller::later:unwritten"),
    ("SL112", "high", 92, _C, 29, "Order@Controller::part:elided"),
    ("SL213", "high", 85, _R, 3, "GET orders/{id}/delete"),
    ("SL213", "high", 90, _R, 4, "GET clear"),
    ("SL211", "high", 92, _R, 4, "Order@Controller::destroy"),
    ("SL215", "medium", 90, _M, 3, "down"),
    ("SL216", "medium", 88, _M, 9, "Order"),
    ("SL217", "low", 78, _M, 6, "user_id"),
    ("SL303", "low", 63, "app/Contracts/Gateway@.php", 1, "Gateway@"),
]
EXPECTED = [(r, s, c, p.replace("@", ""), line, f.replace("@", "")) for r, s, c, p, line, f in FINDINGS]
PHP_SQL = (
    "WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"({kind_of(p)}, '{r}', '{s}', {c}::INT, '{p}', {line}::BIGINT, '{f}')" for r, s, c, p, line, f in FINDINGS)
    + ") AS t(kind, rule, severity, confidence, path, line, fingerprint)) SELECT rule, severity, confidence, replace(path, '@', p_partkey::VARCHAR) AS path, line, replace(fingerprint, '@', p_partkey::VARCHAR) AS fingerprint FROM part JOIN v ON p_partkey % 3 = kind"
)
