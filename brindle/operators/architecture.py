"""Facts about classes and roles: implementors, families, layer stacks, dominant names, presets, placement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.functions.text import glob_regex, stripped
from brindle.session import dealt

# Suffixes that name a layer.
LAYERS = [
    "Interface", "Contract", "Repository", "Service", "Manager", "Factory", "Handler", "Provider", "Adapter", "Wrapper",
    "Decorator", "Proxy", "Impl", "Implementation", "Abstract", "Base", "Builder", "Resolver", "Mapper", "Transformer",
]
FAMILY = 3
# Packages that settle a preset.
MODULES_PACKAGE, ACTIONS_PACKAGE = "nwidart/laravel-modules", "lorisleiva/laravel-actions"


def implementors(inherits: DataFrame, child: str, parent: str) -> DataFrame:
    """(parent, implementors): how many classes name each one, and the first of them."""
    return inherits.groupBy(parent).agg(F.countDistinct(child).alias("implementors"), F.min(child).alias("first"))


def family_sizes(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(member, family): distinct partners in either place, and the member itself."""
    both = pairs.select(F.col(a).alias("member"), F.col(b).alias("partner")).unionByName(pairs.select(F.col(b).alias("member"), F.col(a).alias("partner")))
    return both.where("member <> partner").groupBy("member").agg((F.countDistinct("partner") + 1).alias("family"))


def dominant(rows: DataFrame, group: str, value: str, first: str, least: int = 1, share: float = 0.0) -> DataFrame:
    """(group, value, n): a group's commonest value, of equally common ones the one seen first; values must
    occur so often and have such a share of the group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(first).alias("_seen"))
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), "_seen", F.col(value).alias("v"), "n")).alias("b"), F.sum("n").alias("_all"))
    return best.where((F.col("b.n") >= least) & (F.col("b.n") >= share * F.col("_all"))).select(group, F.col("b.v").alias(value), F.col("b.n").alias("n"))


def layer_stacks(classes: DataFrame, name: str, suffixes: list[str] = LAYERS, least: int = 3) -> DataFrame:
    """(noun, members, depth): classes that share a noun once the layer suffixes are stripped, and how many
    different layers they are."""
    noun = stripped(F.col(name), suffixes)
    rows = classes.select(noun.alias("noun"), F.substring(F.col(name), F.length(noun) + 1, F.lit(1 << 30)).alias("layer"))
    return rows.groupBy("noun").agg(F.count("*").alias("members"), F.countDistinct("layer").alias("depth")).where(F.col("depth") >= least)


def segment_facts(classes: DataFrame, name: str, separator: str = "\\") -> DataFrame:
    """(segment, n): how many classes lie in a namespace with each segment."""
    parts = F.split(name, "\\\\" if separator == "\\" else separator)
    return classes.select(F.explode(F.array_distinct(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)))).alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))


def preset(segments: DataFrame, suffixes: DataFrame, modules: int, packages: list[str]) -> DataFrame:
    """One row: the preset that segment and suffix counts speak for, by the first test that holds."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("segment") == s, F.col("n"))), F.lit(0)).alias(s)
    wide = segments.agg(*[n(s) for s in ("Ports", "Adapters", "Domain", "Application", "Infrastructure", "Actions", "Repositories")])
    named = suffixes.agg(F.coalesce(F.sum(F.when(F.col("suffix") == "Repository", F.col("n"))), F.lit(0)).alias("named"))
    choice = (
        F.when(F.lit(modules >= 2 or MODULES_PACKAGE in packages), "modular")
        .when((F.col("Ports") > 0) | ((F.col("Adapters") > 0) & (F.col("Domain") > 0)), "hexagonal")
        .when((F.col("Domain") > 0) & (F.col("Application") + F.col("Infrastructure") > 0), "ddd")
        .when(F.lit(ACTIONS_PACKAGE in packages) | (F.col("Actions") >= FAMILY), "laravel-actions")
        .when((F.col("Repositories") >= 2) | (F.col("named") >= FAMILY), "service-repository")
        .otherwise("laravel")
    )
    return wide.crossJoin(F.broadcast(named)).select(choice.alias("preset"))  # one row each


def placements(asked: DataFrame, roles: DataFrame) -> DataFrame:
    """(id, words) and (role, strong, weak) arrays of words -> id, role, score: 3 for each word among a role's
    strong ones, 1 among its weak ones; pairs without any are left out.

    Words meet words, so a question is never held against every role, and questions of the same words are scored
    once. An id that is asked twice asks with all its words.
    """
    strong = roles.select("role", F.explode(F.array_distinct("strong")).alias("word"), F.lit(3).alias("points"))
    weak = roles.select("role", F.explode(F.array_except("weak", "strong")).alias("word"), F.lit(1).alias("points"))
    asks = asked.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("_asks"))
    words = asks.select("_asks").distinct().select("_asks", F.explode("_asks").alias("word"))
    scores = words.join(strong.unionByName(weak), "word").groupBy("_asks", "role").agg(F.sum("points").alias("score"))
    return asks.join(scores, "_asks").select("id", "role", "score")


def matches(key: str, pattern: str, of: Column | None = None) -> Column:
    """A test on one part of a declaration: globs on names, paths and lists, the end of the short name, the kind."""
    value = F.col(key) if of is None else of
    if key == "suffix":
        return F.substring_index("fqn", "\\", -1).endswith(pattern)
    if key == "kind":
        return value == pattern
    test = lambda x: x.rlike(glob_regex(pattern))
    return F.coalesce(F.exists(value, test), F.lit(False)) if key in ("extends", "implements", "uses", "attribute") else F.coalesce(test(value), F.lit(False))


def matcher(spec: dict | list) -> Column:
    """One condition from a tree: a dict needs all its keys, a list one of its items, ``not`` none.

    A key may carry a list of patterns, any of which will do.
    """
    if isinstance(spec, list):
        return reduce(lambda a, b: a | b, [matcher(s) for s in spec], F.lit(False))
    tests = []
    for key, value in spec.items():
        if key == "not":
            tests.append(~matcher(value))
        elif key in ("any", "all"):
            join = (lambda a, b: a | b) if key == "any" else (lambda a, b: a & b)
            tests.append(reduce(join, [matcher(s) for s in value]))
        else:
            tests.append(reduce(lambda a, b: a | b, [matches(key, p) for p in (value if isinstance(value, list) else [value])]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def roles_of(classes: DataFrame, roles: list[tuple[str, dict | list]]) -> DataFrame:
    """Classes with ``role``, the first that matches, and ``also``, the others in order."""
    each = F.array_compact(F.array(*[F.when(matcher(spec), F.lit(name)) for name, spec in roles]))
    return classes.withColumn("_roles", each).withColumn("role", F.get("_roles", F.lit(0))).withColumn("also", F.slice("_roles", 2, 1 << 30)).drop("_roles")


def mentions(refs: DataFrame, source: str, target: str, position: str) -> DataFrame:
    """Distinct (source, target) references with the first position; a class does not refer to itself."""
    return refs.where(F.col(source) != F.col(target)).groupBy(source, target).agg(F.min(position).alias(position))


def nearest_enclosing(nodes: DataFrame, scopes: DataFrame, key: str, at: str, start: str, end: str, name: str) -> DataFrame:
    """Each node with the innermost scope that begins before it: scopes nest, so the last to begin is it.

    A sweep over begins, ends and nodes of a key replaces the range join; the depth of what is open is a
    running sum, and the scope is the last one begun at the node's depth. Nodes come along, so they are joined with
    nothing.
    """
    rest = [c for c in nodes.columns if c not in (key, at)]
    kind = scopes.schema[name].dataType
    points = nodes.select(key, F.col(at).alias("_p"), F.lit(0).alias("_d"), F.lit(None).cast(kind).alias("_s"), F.lit(1).alias("_o"), F.struct(F.lit(1), *rest).alias("_row"))
    none = F.lit(None).cast(points.schema["_row"].dataType).alias("_row")
    opened = scopes.select(key, F.col(start).alias("_p"), F.lit(1).alias("_d"), F.col(name).alias("_s"), F.lit(0).alias("_o"), none)
    closed = scopes.select(key, F.col(end).alias("_p"), F.lit(-1).alias("_d"), F.lit(None).cast(kind).alias("_s"), F.lit(2).alias("_o"), none)
    order = Window.partitionBy(key).orderBy("_p", "_o").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt(opened.unionByName(closed).unionByName(points), key).withColumn("_depth", F.sum("_d").over(order))
    level = Window.partitionBy(key, "_depth").orderBy("_p", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = swept.withColumn("_in", F.last(F.when(F.col("_d") == 1, F.col("_s")), ignorenulls=True).over(level)).where("_o = 1")
    inside = F.col(key).isNotNull() & F.col("_p").isNotNull() & (F.col("_depth") > 0)
    return found.select(key, F.col("_p").alias(at), *[F.col(f"_row.{c}").alias(c) for c in rest], F.when(inside, F.col("_in")).alias(name))
