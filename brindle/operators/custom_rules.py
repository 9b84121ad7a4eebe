"""Rules of a project's own as table functions: written in Python, called from SQL or over a DataFrame.

A rule is a class with the columns it partitions and orders by, its options with their defaults, and two methods that
yield findings: ``see`` for each row of a partition in order, ``close`` at the end of it. ``register`` makes it a
polymorphic table function: the output begins with the partition's own columns, whatever their types are, and the rule
itself asks for the partitioning, so a call cannot get it wrong::

    SELECT * FROM app001(TABLE(calls), least => 3)

Options and columns are checked while the query is planned. Spark deals the partitions; rows stream through a rule, so
a hot partition costs time but no memory beyond what the rule keeps.

Defined results: null keys are one partition; an empty table has no partitions, so no findings; ties in the order
come as Spark sorts them, so a rule that minds them orders by enough columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@dataclass
class Finding:
    line: int
    message: str
    severity: str = ""
    confidence: int = 80
    fingerprint: str = ""


class Rule:
    """The base of custom rules: one instance sees one partition."""

    rule: str = ""
    severity: str = "medium"
    partition_by: tuple[str, ...] = ("path",)
    order_by: tuple[str, ...] = ()
    #: Columns that it reads besides those above.
    reads: tuple[str, ...] = ()
    #: Option names and their defaults; an option has its default's type.
    options: dict[str, Any] = {}

    def __init__(self, options: dict[str, Any]):
        self.given = options

    def see(self, row: Row) -> Iterator[Finding]:
        return iter(())

    def close(self) -> Iterator[Finding]:
        return iter(())


@dataclass
class _Planned(AnalyzeResult):
    options: dict = field(default_factory=dict)


def _check(rule: type[Rule], table: AnalyzeArgument, given: dict[str, AnalyzeArgument]) -> dict[str, Any]:
    if not table.isTable:
        raise ValueError(f"{rule.rule}: the first argument must be a table")
    needed = [*rule.partition_by, *rule.order_by, *rule.reads]
    absent = [c for c in needed if c not in table.dataType.fieldNames()]
    if absent:
        raise ValueError(f"{rule.rule}: the table lacks {', '.join(absent)}")
    values = dict(rule.options)
    for name, argument in given.items():
        if name not in values:
            raise ValueError(f"{rule.rule}: no option {name}; it has {', '.join(sorted(values)) or 'none'}")
        if not argument.isConstantExpression:
            raise ValueError(f"{rule.rule}: option {name} must be a constant")
        if type(argument.value) is not type(values[name]):
            raise ValueError(f"{rule.rule}: option {name} must be of type {type(values[name]).__name__}")
        values[name] = argument.value
    return values


def table_function(rule: type[Rule]):
    """The rule as a table function."""
    width = len(rule.partition_by)

    class Handler:
        @staticmethod
        def analyze(table: AnalyzeArgument, **given: AnalyzeArgument) -> AnalyzeResult:
            values = _check(rule, table, given)
            schema = StructType([table.dataType[c] for c in rule.partition_by])
            for name, kind in (("rule", StringType()), ("severity", StringType()), ("confidence", IntegerType()), ("line", LongType()), ("message", StringType()), ("fingerprint", StringType())):
                schema = schema.add(name, kind)
            return _Planned(schema, partitionBy=[PartitioningColumn(c) for c in rule.partition_by], orderBy=[OrderingColumn(c) for c in rule.order_by], options=values)

        def __init__(self, planned: _Planned):
            self._rule, self._key = rule(planned.options), None

        def _rows(self, found: Iterator[Finding]) -> Iterator[tuple]:
            for f in found:
                yield (*self._key, rule.rule, f.severity or rule.severity, f.confidence, f.line, f.message, f.fingerprint)

        def eval(self, table: Row, **given):
            if self._key is None:
                self._key = tuple(table[c] for c in rule.partition_by)
            yield from self._rows(self._rule.see(table))

        def terminate(self):
            if self._key is not None:
                yield from self._rows(self._rule.close())

    assert width, "a rule has at least one column to partition by"
    return udtf(Handler)


def register(spark: SparkSession, rule: type[Rule], name: str | None = None) -> str:
    """Make a rule callable from SQL; its name there is the rule's in lower case unless another is given."""
    name = name or rule.rule.lower()
    spark.udtf.register(name, table_function(rule))
    return name


def run(rows: DataFrame, rule: type[Rule], **options: Any) -> DataFrame:
    """Findings of a rule over rows. Only the columns that it names reach Python."""
    from pyspark.sql.functions import lit

    needed = list(dict.fromkeys([*rule.partition_by, *rule.order_by, *rule.reads]))
    return table_function(rule)(rows.select(*needed).asTable(), **{k: lit(v) for k, v in options.items()})


def for_engine(rule: type[Rule], **options: Any) -> Callable[[DataFrame], DataFrame]:
    """The rule as ``Engine`` takes it: over the tokens of files, partitioned by ``path``."""
    if tuple(rule.partition_by) != ("path",):
        raise ValueError(f"{rule.rule}: rules over tokens are partitioned by path")
    return lambda tokens: run(tokens, rule, **options)
