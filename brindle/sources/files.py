"""Sources: source trees, coverage reports, baselines and the output of revision control, as DataFrames."""

from __future__ import annotations

from difflib import get_close_matches
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brindle.functions.text import code_lines, excluded, normal_path
from brindle.operators.places import containing
from brindle.operators.ranks import numbered

BASELINE_ENTRY = "id string, rule string, file string, fingerprint string, count long, message string"
BASELINE = f"schema long, tool string, generated_at string, score long, total long, entries array<struct<{', '.join(f.replace(' ', ':') for f in BASELINE_ENTRY.split(', '))}>>"


def source_tree(spark: SparkSession, root: str, suffix: str = ".php", exclude: list[str] | None = None) -> DataFrame:
    """(path, source, code_lines) of the files below a root; hidden and empty files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    base = F.regexp_replace(F.regexp_replace(F.lit(root), "^[a-z]+:/*", "/"), "/+$", "")
    path = F.ltrim(F.replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), base, F.lit("")), F.lit("/"))
    files = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("source"))
    hidden = F.exists(F.split("path", "/"), lambda s: s.startswith("."))
    files = files.where(~hidden & ~excluded(F.col("path"), exclude or []))
    return files.withColumn("code_lines", code_lines(F.col("source"))).withColumn("kind", source_kind(F.col("path")))


def source_kind(path: Column, migrations: tuple[str, ...] = ("database/migrations/",), routes: tuple[str, ...] = ("routes/",)) -> Column:
    """migration, routes or code, by the first that the path begins with or passes through."""
    through = lambda names: reduce(lambda a, b: a | b, [path.startswith(n) | path.contains(f"/{n}") for n in names])
    return F.when(through(migrations), "migration").when(through(routes), "routes").otherwise("code")


def name_status(raw: DataFrame) -> DataFrame:
    """The rows of `--name-status -z` output (column raw) -> (position, status, previous_path, path).

    Renames and copies carry two paths, all others one; the fields are walked with a fold.
    """
    fields = F.filter(F.split("raw", "\0"), lambda x: x != "")
    item = "struct<status:string,previous_path:string,path:string>"
    start = F.from_json(F.lit('{"done":[],"code":null,"from":null}'), f"done array<{item}>, code string, from string")

    def walk(acc: Column, x: Column) -> Column:
        two = acc["code"].rlike("^[RC]")
        make = lambda before: F.struct(F.substring(acc["code"], 1, 1).alias("status"), before.alias("previous_path"), x.alias("path"))
        none = F.lit(None).cast("string")
        keep = lambda code, first: F.struct(acc["done"].alias("done"), code.alias("code"), first.alias("from"))
        add = lambda row: F.struct(F.concat(acc["done"], F.array(row)).alias("done"), none.alias("code"), none.alias("from"))
        return F.when(acc["code"].isNull(), keep(x, none)).when(two & acc["from"].isNull(), keep(acc["code"], x)).when(two, add(make(acc["from"]))).otherwise(add(make(none)))

    found = raw.select(F.aggregate(fields, start, walk)["done"].alias("rows"))
    return found.select(F.posexplode("rows").alias("position", "r")).select("position", "r.status", "r.previous_path", "r.path")


def _headed(lines: DataFrame, header: Column) -> DataFrame:
    """Lines (n, line) with ``head``: the header line at or before each, by its position.

    Headers are few against lines, and each stands for the lines up to the next one: an equi join on
    blocks of line numbers that a header's stretch touches, so no task holds all lines.
    """
    width = 4096
    heads = numbered(lines.where(header).select(F.col("n").alias("from"), F.col("line").alias("head")), ["from"], "k")
    until = heads.select((F.col("k") - 1).alias("k"), (F.col("from") - 1).alias("upto"))
    last = lines.agg(F.max("n").alias("end"))
    spans = heads.join(until, "k", "left").crossJoin(F.broadcast(last)).withColumn("upto", F.coalesce("upto", "end"))
    return containing(lines.withColumn("_all", F.lit(0)), spans.select("head", "from", "upto", F.lit(0).alias("_all")), "_all", "n", "from", "upto", width).drop("_all")


def diff_hunks(lines: DataFrame) -> DataFrame:
    """(n, line) of a unified diff without context -> (path, hunks): the new side's ranges of each file.

    A header belongs to the last file line before it; deleted files have none.
    """
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"  # fixed by the format
    wanted = lines.where(F.col("line").startswith("+++ ") | F.col("line").rlike(hunk))
    path = F.regexp_extract("head", r'^\+\+\+ "?(?:b/)?(.*?)"?\t?$', 1)
    n = F.regexp_extract("line", hunk, 2)
    rows = _headed(wanted, F.col("line").startswith("+++ ")).withColumn("path", path).where(F.col("line").rlike(hunk) & (F.col("path") != "/dev/null"))
    one = F.struct(F.regexp_extract("line", hunk, 1).cast("int").alias("start"), F.when(n == "", 1).otherwise(n.cast("int")).alias("n"))
    return rows.groupBy("path").agg(F.sort_array(F.collect_list(one)).alias("hunks"))


def churn(paths: DataFrame) -> DataFrame:
    """(path) once a change -> (path, changes)."""
    return paths.where("path <> ''").groupBy("path").agg(F.count("*").cast("int").alias("changes"))


def clover(spark: SparkSession, file: str, root: str = "") -> DataFrame:
    """(path, ratio): covered statements of statements; a file without statements is covered."""
    schema = "_name string, metrics struct<_statements:long,_coveredstatements:long>"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "file").load(file)
    ratio = F.when(F.coalesce("metrics._statements", F.lit(0)) <= 0, 1.0).otherwise(F.col("metrics._coveredstatements") / F.col("metrics._statements"))
    return _relative(rows.where("_name IS NOT NULL").select(F.col("_name").alias("path"), ratio.alias("ratio")), root)


def cobertura(spark: SparkSession, file: str, root: str = "") -> DataFrame:
    """(path, ratio): the line rate, kept within 0 and 1. Malformed rates are left out."""
    rows = spark.read.format("xml").schema("_filename string, `_line-rate` string").option("rowTag", "class").load(file)
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr("try_cast(`_line-rate` as double)")))
    return _relative(rows.select(F.col("_filename").alias("path"), ratio.alias("ratio")).where("path IS NOT NULL AND ratio IS NOT NULL"), root)


def _relative(rows: DataFrame, root: str) -> DataFrame:
    path = normal_path(F.col("path"))
    path = F.when(path.startswith(f"{root}/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path) if root else path
    return rows.withColumn("path", path).groupBy("path").agg(F.max("ratio").alias("ratio"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline file; a broken document raises, a malformed entry is skipped."""
    doc = spark.read.schema(BASELINE).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    rows = doc.select(F.explode("entries").alias("e")).select("e.*").withColumnRenamed("file", "path")
    return rows.where("id IS NOT NULL AND rule IS NOT NULL AND path IS NOT NULL AND count > 0")


def baseline_of(findings: DataFrame) -> DataFrame:
    """Entries from findings: identities with their counts and first message, ordered."""
    keys = [F.col("identity").alias("id"), "rule", "path", "fingerprint"]
    return findings.groupBy(*keys).agg(F.count("*").alias("count"), F.min("message").alias("message")).orderBy("path", "rule", "id")


def counted_baseline(lines: DataFrame) -> DataFrame:
    """(n, line) of an indented baseline of another analyser (message, count, path) -> (path, count)."""
    counted = F.col("line").rlike(r"^\s*count:")
    found = _headed(lines.where(counted | F.col("line").rlike(r"^\s*path:")), counted)
    value = lambda c: F.regexp_extract(c, r":\s*['\"]?(.*?)['\"]?\s*$", 1)
    rows = found.where("n > from").select(value("line").alias("path"), F.expr("try_cast(regexp_extract(head, ':\\\\s*([0-9]+)', 1) as long)").alias("count"))
    return rows.groupBy("path").agg(F.sum("count").alias("count"))


def suppressed_issues(spark: SparkSession, file: str) -> DataFrame:
    """(path, count) of an XML baseline with a file element for each path and a code element for each issue."""
    rows = spark.read.format("text").option("wholetext", "true").load(file)
    files = rows.select(F.explode(F.expr(r"regexp_extract_all(value, '(?s)<file\\s[^>]*>.*?</file>', 0)")).alias("part"))
    n = F.size(F.expr(r"regexp_extract_all(part, '<code[\\s/>]', 0)")).cast("long")
    return files.select(F.regexp_extract("part", r'<file\s[^>]*src="([^"]*)"', 1).alias("path"), n.alias("count")).where("path <> ''").groupBy("path").agg(F.sum("count").alias("count"))


FINDINGS = "rule string, name string, category string, severity string, confidence int, path string, line long, end_line long, message string, fingerprint string"


def findings_from(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Findings held in memory."""
    names = [field.split()[0] for field in FINDINGS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FINDINGS)


def covers(path: Column, roots: list[str], exclude: list[str]) -> Column:
    """Whether a path lies below one of the roots (all paths, if there are none) and is not excluded."""
    inside = reduce(lambda a, b: a | b, [(path == r.rstrip("/")) | path.startswith(f"{r.rstrip('/')}/") for r in roots], F.lit(not roots))
    return inside & ~excluded(path, exclude)


def write_baseline(findings: DataFrame, path: str, score: int, generated_at: str) -> None:
    """Write the baseline of findings as one document, entries in their order."""
    entry = F.struct("path", "rule", "id", "fingerprint", "count", "message")
    rows = baseline_of(findings).agg(F.array_sort(F.collect_list(entry)).alias("e"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    named = F.transform("e", lambda x: F.struct(x["id"].alias("id"), x["rule"].alias("rule"), x["path"].alias("file"), x["fingerprint"].alias("fingerprint"), x["count"].alias("count"), x["message"].alias("message")))
    document = F.struct(F.lit(1).cast("long").alias("schema"), F.lit("brindle").alias("tool"), F.lit(generated_at).alias("generated_at"), F.lit(score).cast("long").alias("score"), "total", named.alias("entries"))
    rows.select(F.to_json(document).alias("value")).coalesce(1).write.mode("overwrite").text(path)


# Where coverage reports usually lie.
COVERAGE_FILES = ["coverage.xml", "clover.xml", "build/logs/clover.xml", "build/coverage.xml", "cobertura.xml"]


def _there(spark: SparkSession, file: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def find_coverage(spark: SparkSession, root: str, asked: str | None = None, configured: str | None = None) -> DataFrame | None:
    """(path, ratio) from the asked report, the configured one, or the first usual one; its content tells
    its format. Nothing where there is none; an asked report that is not there raises."""
    there = lambda file: _there(spark, f"{root}/{file}")
    if asked and not there(asked):
        raise FileNotFoundError(asked)
    for file in filter(None, [asked, configured, *COVERAGE_FILES]):
        if there(file):
            head = spark.read.text(f"{root}/{file}").limit(20).agg(F.concat_ws("\n", F.collect_list("value")).alias("h")).first().h
            return (cobertura if "line-rate" in head else clover)(spark, f"{root}/{file}", root)
    return None


def composer(spark: SparkSession, file: str) -> tuple[DataFrame, DataFrame]:
    """(namespace, folder) of the autoload roots and (package) of what is required, from a composer file."""
    kind = "map<string,string>"
    schema = f"autoload struct<`psr-4`:{kind}>, `autoload-dev` struct<`psr-4`:{kind}>, require {kind}, `require-dev` {kind}"
    doc = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(file)
    either = lambda a, b: F.map_concat(F.coalesce(a, F.create_map().cast(kind)), F.map_filter(F.coalesce(b, F.create_map().cast(kind)), lambda k, _: ~F.map_contains_key(F.coalesce(a, F.create_map().cast(kind)), k)))
    roots = doc.select(F.explode(either(F.col("autoload.psr-4"), F.col("autoload-dev.psr-4"))).alias("namespace", "folder"))
    packages = doc.select(F.explode(F.map_keys(either(F.col("require"), F.col("require-dev")))).alias("package"))
    return roots, packages


# Packages that show that a project uses a framework.
EVIDENCE = {"laravel": ["laravel/framework", "illuminate/support", "illuminate/database", "illuminate/contracts"]}


def frameworks(spark: SparkSession, root: str) -> list[str]:
    """The frameworks that a project's own package file asks for; a project without such a file has none."""
    if not _there(spark, f"{root}/composer.json"):
        return []
    _, packages = composer(spark, f"{root}/composer.json")
    asked = packages.where(F.col("package").isin([p for known in EVIDENCE.values() for p in known])).distinct().collect()  # a few names
    return sorted(f for f, known in EVIDENCE.items() if any(r.package in known for r in asked))


def checked_config(given: dict, known: dict[str, type | tuple]) -> dict:
    """The given settings; a wrong type or an unknown name raises, with the nearest known name."""
    for name, value in given.items():
        if name not in known:
            near = get_close_matches(name, known, 1)
            raise ValueError(f"unknown setting {name}" + (f", did you mean {near[0]}?" if near else ""))
        if not isinstance(value, known[name]):
            raise TypeError(f"setting {name} has the wrong type")
    return given
