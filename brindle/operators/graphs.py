"""Graph operators over facts: closures, role edges, boundaries, roles by first match, votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.text import glob_regex


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, ancestor, depth): every ancestor at its least depth; cycles end where they meet themselves.

    Each round doubles the length of known paths, so a chain of n links takes log n joins; a shuffle of
    the known pairs is all that a round costs. The rounds end when one adds no pair.
    """
    known = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).where("child IS NOT NULL AND ancestor IS NOT NULL AND child <> ancestor").distinct()
    size = known.count()
    while True:
        further = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.child")).select(
            F.col("a.child").alias("child"), F.col("b.ancestor").alias("ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth")
        )
        grown = known.unionByName(further).where("child <> ancestor").groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))
        grown = grown.checkpoint()
        n = grown.count()
        if n == size:
            return grown
        known, size = grown, n


def edge_counts(edges: DataFrame, source: str, target: str, allowed: Column, example: str) -> DataFrame:
    """Counts of role edges, of those that the policy forbids, and the first example."""
    return edges.groupBy(source, target).agg(
        F.count("*").alias("n"),
        F.sum(F.when(allowed, 0).otherwise(1)).alias("n_forbidden"),
        F.min(example).alias("example"),
    )


def first_role(value: Column, roles: list[tuple[str, list[str]]], otherwise: str | None = None) -> Column:
    """The first role, in order, one of whose globs matches."""
    case = None
    for name, globs in roles:
        test = reduce(lambda a, b: a | b, [value.rlike(glob_regex(g)) for g in globs])
        case = F.when(test, name) if case is None else case.when(test, name)
    return case.otherwise(F.lit(otherwise))


def all_roles(value: Column, roles: list[tuple[str, list[str]]]) -> Column:
    """Every role that matches, in order."""
    each = [F.when(reduce(lambda a, b: a | b, [value.rlike(glob_regex(g)) for g in globs]), name) for name, globs in roles]
    return F.array_compact(F.array(*each))


def crosses_boundary(source: Column, target: Column, module: str, public: Column, shared: list[str]) -> Column:
    """Whether a reference enters another module's internals. ``module`` captures a module's name."""
    ours, theirs = F.regexp_extract(source, module, 1), F.regexp_extract(target, module, 1)
    return (ours != "") & (theirs != "") & (ours != theirs) & ~public & ~theirs.isin(shared)


def unused(declared: DataFrame, *uses: DataFrame, on: list[str]) -> DataFrame:
    """Declarations that none of the uses names: one anti-join for each kind of use."""
    return reduce(lambda rows, use: rows.join(use.select(*on).distinct(), on, "left_anti"), uses, declared)


def vote(signals: list[Column], least: int, base: int, step: int, ceiling: int) -> tuple[Column, Column]:
    """(fires, confidence): at least so many signals are true; confidence grows with each up to a ceiling."""
    n = reduce(lambda a, b: a + b, [F.when(s, 1).otherwise(0) for s in signals])
    return n >= least, F.least(F.lit(ceiling), base + n * step)


def nearest_name(wanted: DataFrame, names: DataFrame, on: list[str], name: str, candidate: str, below: int = 3) -> DataFrame:
    """For each wanted name, the candidate of its key with the least edit distance, first one on ties."""
    rows = wanted.join(names, on).withColumn("_d", F.levenshtein(name, candidate, below)).where((F.col("_d") >= 0) & (F.col("_d") < below))
    return rows.groupBy(*on, name).agg(F.min_by(candidate, F.struct("_d", candidate)).alias("nearest"), F.min("_d").alias("distance"))


def counts_filled(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts of every value, zero where none occurs."""
    known = rows.sparkSession.createDataFrame([(v, k) for k, v in enumerate(values)], f"{key} string, place int")
    return known.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, "place", F.coalesce("n", F.lit(0)).alias("n"))
