"""JSON reports read back: each by the version it says it has, with what later versions add kept.

A report is one text. It is parsed once into a VARIANT, so no schema has to fit all reports: fields are looked up by
path and cast one by one, keys that this version does not know stay as they are, and a report that is no JSON object
is set apart instead of failing the job.

Defined results: a null text, text that is no JSON, JSON that is no object and text beyond what a VARIANT holds are
``corrupt``; an object without a version in whole numbers is ``foreign``; a version not in ``VERSIONS`` is ``newer``
(its findings are not guessed at). A field of another type is null; a list that is none holds nothing, and an entry
that is no object is a finding without fields. Everything is a map over rows: no shuffle, and repeated rows repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# By version, the lists of a report, and a finding's fields with their type and where they may lie.
LISTS = {"findings": "current", "new": "new", "existing": "existing", "resolved": "resolved"}
VERSIONS = {
    1: {
        "rule": ("string", ["rule"]), "name": ("string", ["name"]), "category": ("string", ["category"]), "severity": ("string", ["severity"]), "tier": ("string", ["tier"]),
        "confidence": ("int", ["confidence"]), "path": ("string", ["file", "location.file"]), "line": ("long", ["line", "location.line"]),
        "end_line": ("long", ["end_line", "location.endLine"]), "message": ("string", ["message"]), "fingerprint": ("string", ["fingerprint"]),
        "risk": ("double", ["risk"]), "key": ("string", ["key"]),
    },
}
SCORE = {"score": ("int", ["score.value", "score.score", "score.current.value"]), "band": ("string", ["score.band", "score.current.band"]), "penalty": ("double", ["score.penalty", "score.current.penalty"])}
CORRUPT, FOREIGN, NEWER, READ = "corrupt", "foreign", "newer", "read"


def _at(value: Column, paths: list[str], kind: str) -> Column:
    """The first of some paths that holds a value of this type."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{p}", kind) for p in paths])


def parsed(rows: DataFrame, text: str = "value", report: str = "report") -> DataFrame:
    """Rows with ``report`` (a VARIANT), ``state``, ``version``, ``mode`` and the score of each report.

    The text goes; other columns stay.
    """
    value = F.try_parse_json(text)
    whole = F.schema_of_variant(F.col(report)).startswith("OBJECT")
    # a version is a whole number: 1.5 or "1" is none
    version = F.when(F.schema_of_variant(F.try_variant_get(F.col(report), "$.schema", "variant")) == "BIGINT", F.try_variant_get(F.col(report), "$.schema", "int"))
    state = F.when(~F.coalesce(whole, F.lit(False)), CORRUPT).when(F.col("version").isNull(), FOREIGN).when(~F.col("version").isin(list(VERSIONS)), NEWER).otherwise(READ)
    mode = F.coalesce(F.try_variant_get(F.col(report), "$.mode", "string"), F.lit("scan"))
    found = rows.withColumn(report, value).withColumn("version", F.when(whole, version)).withColumn("state", state)
    known = F.col("state") == READ
    found = found.withColumns({"mode": F.when(known, mode), **{name: F.when(known, _at(F.col(report), paths, kind)) for name, (kind, paths) in SCORE.items()}})
    return found.drop(text) if text != report else found


def _entries(report: Column, name: str, state: str) -> Column:
    """The entries of one list of a report; none where it is absent or no list."""
    values = F.try_variant_get(report, f"$.{name}", "array<variant>")
    found = F.transform(values, lambda v, i: F.struct(F.lit(state).alias("list"), i.alias("at"), v.alias("finding")))
    return F.coalesce(found, F.array().cast("array<struct<list:string,at:int,finding:variant>>"))


def _without(entries: Column, known: dict[str, tuple[str, list[str]]]) -> Column:
    """A map without the keys that hold known fields."""
    keys = sorted({path.split(".")[0] for _, paths in known.values() for path in paths})
    return F.map_filter(entries, lambda k, _: ~k.isin(keys))


def findings(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    """One row a finding of the reports that were read: ``keys``, list and place in it, fields, and ``more``.

    ``more`` maps the keys that the version does not know to their values, whatever these are.
    """
    lists = F.concat(*[_entries(F.col(report), name, state) for name, state in LISTS.items()])
    rows = reports.where(F.col("state") == READ).select(*keys, "version", F.explode(lists).alias("_f")).select(*keys, "version", "_f.list", "_f.at", F.col("_f.finding").alias("_f"))
    fields = {}
    for name in dict.fromkeys(n for fields_ in VERSIONS.values() for n in fields_):
        cases = [F.when(F.col("version") == v, _at(F.col("_f"), known[name][1], known[name][0])) for v, known in VERSIONS.items() if name in known]
        fields[name] = F.coalesce(*cases)
    entries = F.try_variant_get(F.col("_f"), "$", "map<string,variant>")
    more = F.coalesce(*[F.when(F.col("version") == v, _without(entries, known)) for v, known in VERSIONS.items()])
    return rows.select(*keys, "list", "at", *[c.alias(n) for n, c in fields.items()], more.alias("more"))
