"""Trees as intervals: nodes numbered in document order, structural joins and subtree aggregates without recursion.

A node is (key, pre, last, level, parent, ...): its subtree is the numbers ``pre`` to ``last`` of its key. Everything
below is a window over events (where a subtree begins or ends) of one key or one level of it, so work follows the
events and, for ancestors, the rows returned; no pair of nodes is compared that is not an answer. A key is one
document: its events come from one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Elements without an end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
#: Comments, declarations and elements of raw text are one token each, other tags one by one.
TOKEN = r"(?is)<!--.*?-->|<![^>]*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z][^>]*>"


def tags(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, at, tag, turn): the tags of each text in order; turn is 1 for a begin, -1 for an end, 0 for what has
    no content. Comments and declarations are left out."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("at", "_t"))
    tag = F.lower(F.regexp_extract("_t", r"(?i)^</?([a-z][a-z0-9-]*)", 1))
    whole = tag.isin([*VOID, "script", "style"]) | F.col("_t").endswith("/>")
    turn = F.when(F.startswith("_t", F.lit("</")), F.when(tag.isin(VOID), None).otherwise(-1)).when(whole, 0).otherwise(1)
    return rows.select(key, "at", tag.alias("tag"), turn.alias("turn")).where("tag <> '' AND turn IS NOT NULL")


def balanced(events: DataFrame, key: str) -> DataFrame:
    """Events whose begins and ends match by tag: an end without a begin is dropped, a begin without an end has no
    content."""
    along = Window.partitionBy(key, "tag").orderBy("at")
    sofar, later = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(0, Window.unboundedFollowing)
    # an end is surplus where the sum falls below all before it
    rows = events.withColumn("_s", F.sum("turn").over(sofar)).withColumn("_least", F.least(F.lit(0), F.min("_s").over(along.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.where("turn <> -1 OR _s >= coalesce(_least, 0)").withColumn("_d", F.sum("turn").over(sofar))
    # a begin is open for good where the sum never falls below it again
    open_ = (F.col("turn") == 1) & (F.min("_d").over(later) >= F.col("_d"))
    return rows.withColumn("turn", F.when(open_, 0).otherwise(F.col("turn"))).drop("_s", "_least", "_d")


def nodes(events: DataFrame, key: str) -> DataFrame:
    """(key, pre, last, level, slot, parent, tag) from balanced events. An end closes the innermost open node,
    whatever its tag. ``slot`` numbers the children of a node from 0; roots have a null parent."""
    along = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumns({"_n": F.sum(F.when(F.col("turn") >= 0, 1).otherwise(0)).over(along), "_open": F.sum("turn").over(along)})
    # a begin and its end are neighbours among the events of their level
    level = F.col("_open") + F.when(F.col("turn") == 1, 0).otherwise(1)
    beside = Window.partitionBy(key, "level").orderBy("at")
    rows = numbered.withColumn("level", level).withColumn("_last", F.lead("_n").over(beside)).where("turn >= 0")
    rows = rows.select(key, F.col("_n").alias("pre"), F.when(F.col("turn") == 1, F.col("_last")).otherwise(F.col("_n")).alias("last"), "level", "tag")
    return with_parents(rows, key)


def with_parents(rows: DataFrame, key: str) -> DataFrame:
    """The latest node of the level above is the parent."""
    named = rows.withColumn("_as", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_level", F.col("level") + F.col("_as"))
    before = Window.partitionBy(key, "_level").orderBy("pre", "_as")
    found = named.withColumn("parent", F.last(F.when(F.col("_as") == 1, F.col("pre")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0))).where("_as = 0")
    slot = (F.row_number().over(Window.partitionBy(key, "parent").orderBy("pre")) - 1).alias("slot")
    return found.select(key, "pre", "last", "level", slot, "parent", *[c for c in rows.columns if c not in (key, "pre", "last", "level")])


def ancestors(rows: DataFrame, key: str, top: Column | None = None, asks: Column | None = None, carried: list[str] | None = None) -> DataFrame:
    """(key, pre, ancestor, up): the ancestors of every node from level ``top`` down, the closest at 1; nothing above
    that level is made, nor for nodes that do not ask. ``carried`` columns come along, the ancestor's as
    ``ancestor_...``.

    An ancestor is the latest node begun at its level, so a node asks each level above it once.
    """
    with_ = carried or []
    top = F.lit(1) if top is None else top
    levels = F.when(top < F.col("level"), F.sequence(top.cast("long"), F.col("level").cast("long") - 1))
    asked = (rows if asks is None else rows.where(asks)).select(key, "pre", *with_, F.explode(levels).alias("_level"), F.col("level").alias("_of"), F.lit(1).alias("_asks"))
    there = rows.select(key, "pre", *with_, F.col("level").alias("_level"), F.lit(None).cast("long").alias("_of"), F.lit(0).alias("_asks"))
    before = Window.partitionBy(key, "_level").orderBy("pre", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = there.unionByName(asked).withColumn("_up", F.last(F.when(F.col("_asks") == 0, F.struct("pre", *with_)), ignorenulls=True).over(before))
    theirs = [F.col(f"_up.{c}").alias(f"ancestor_{c}") for c in with_]
    return found.where("_asks = 1").select(key, "pre", F.col("_up.pre").alias("ancestor"), (F.col("_of") - F.col("_level")).alias("up"), *with_, *theirs)


def nearest(rows: DataFrame, key: str, covers: Column, carried: Column, name: str) -> DataFrame:
    """The rows with ``name``: what the nearest ancestor carries whose child towards the node ``covers``.

    ``covers`` and ``carried`` are asked of a child and may use its parent's columns, which are named ``of_...``: so a
    slot that a parent does not count, or a property of the parent, is a test on the edge. A sweep over the begins
    and ends of covered subtrees keeps how many are open; the answer is the one begun last at that depth.
    """
    edges = with_parent_columns(rows, key).where(covers)
    kind = edges.select(carried.alias("c")).schema["c"].dataType
    begin = edges.select(key, (3 * F.col("pre")).alias("_p"), F.lit(1).alias("_d"), carried.alias("_c"))
    end = edges.select(key, (3 * F.col("last") + 2).alias("_p"), F.lit(-1).alias("_d"), F.lit(None).cast(kind).alias("_c"))
    fields = F.struct(*[F.col(c) for c in rows.columns if c != key])
    points = rows.select(key, (3 * F.col("pre") + 1).alias("_p"), F.lit(0).alias("_d"), F.lit(None).cast(kind).alias("_c"), fields.alias("_row"))
    along = Window.partitionBy(key).orderBy("_p").rangeBetween(Window.unboundedPreceding, 0)
    none = F.lit(None).cast(points.schema["_row"].dataType)
    swept = begin.unionByName(end).withColumn("_row", none).unionByName(points).withColumn("_open", F.sum("_d").over(along))
    at_depth = Window.partitionBy(key, "_open").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    found = swept.withColumn(name, F.last(F.when(F.col("_d") == 1, F.struct(F.col("_c"))), ignorenulls=True).over(at_depth)[F.lit("_c")])
    return found.where("_d = 0").select(key, *[F.col(f"_row.{c}").alias(c) for c in rows.columns if c != key], F.when(F.col("_open") > 0, F.col(name)).alias(name))


def with_parent_columns(rows: DataFrame, key: str) -> DataFrame:
    """Nodes that have a parent, with its columns as ``of_...``. Files of nodes hold hundreds of times the rows that
    their size suggests, so neither side may go through the driver."""
    above = rows.select(key, F.col("pre").alias("parent"), *[F.col(c).alias(f"of_{c}") for c in rows.columns if c not in (key, "pre")])
    return rows.join(above.hint("merge"), [key, "parent"])


def own(rows: DataFrame, key: str, scope: Column, carried: list[str] | None = None) -> DataFrame:
    """(key, pre, ancestor, up): as ``ancestors``, and each node as its own at 0, but not past a scope: no scope lies
    between the two, and what is found below another node is no scope itself."""
    marked = rows.withColumn("_scope", scope)
    inside = nearest(marked, key, F.col("of__scope"), F.col("of_level"), "_from")
    top = F.when(F.col("_scope"), F.col("level")).otherwise(F.coalesce("_from", F.lit(1)))
    with_ = carried or []
    self_ = rows.select(key, "pre", F.col("pre").alias("ancestor"), F.lit(0).cast("long").alias("up"), *with_, *[F.col(c).alias(f"ancestor_{c}") for c in with_])
    return self_.unionByName(ancestors(inside, key, top, carried=carried))


def subtree_sums(rows: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """The rows with a sum over each subtree, the node included, for every measure.

    A running sum over begins and ends is taken where a node begins and where it ends; their difference is the
    subtree's, and both events are neighbours in the node's level. A test holds for a whole subtree where the sum
    of its failures is 0.
    """
    made = {f"_m{k}": m for k, m in enumerate(measures.values())}
    own_ = rows.withColumns(made)
    fields = F.struct(*[F.col(c) for c in rows.columns if c != key])
    begin = own_.select(key, (2 * F.col("pre")).alias("_p"), F.col("level").alias("_l"), fields.alias("_row"), *made)
    end = own_.select(key, (2 * F.col("last") + 1).alias("_p"), F.col("level").alias("_l"), F.lit(None).cast(begin.schema["_row"].dataType).alias("_row"), *[F.lit(0).cast(own_.schema[c].dataType).alias(c) for c in made])
    along = Window.partitionBy(key).orderBy("_p").rangeBetween(Window.unboundedPreceding, 0)
    run = begin.unionByName(end).withColumns({f"_r{c}": F.sum(c).over(along) for c in made})
    beside = Window.partitionBy(key, "_l").orderBy("_p")
    sums = {name: F.lead(f"_r{c}").over(beside) - F.col(f"_r{c}") + F.col(c) for name, c in zip(measures, made)}
    return run.withColumns(sums).where("_row IS NOT NULL").select(key, *[F.col(f"_row.{c}").alias(c) for c in rows.columns if c != key], *measures)


def deepest(rows: DataFrame, key: str, up: DataFrame, counts: Column) -> DataFrame:
    """(key, ancestor, depth, node): the greatest depth that counting nodes reach below a node, and the first node
    there. ``up`` are the pairs to look at, ``counts`` tells which nodes add to the depth.

    Depths are running sums over begins and ends; pairs meet in a partial maximum.
    """
    marked = subtree_depths(rows, key, counts)
    low = up.join(marked.select(key, "pre", F.col("_depth").alias("_low"), "_counts").hint("merge"), [key, "pre"]).where("_counts")
    high = marked.select(key, F.col("pre").alias("ancestor"), (F.col("_depth") - F.when(F.col("_counts"), 1).otherwise(0)).alias("_high"))
    best = low.groupBy(key, "ancestor").agg(F.max(F.struct("_low", (-F.col("pre")).alias("_first"))).alias("_b"))
    return best.join(high.hint("merge"), [key, "ancestor"]).select(key, "ancestor", (F.col("_b._low") - F.col("_high")).alias("depth"), (-F.col("_b._first")).alias("node"))


def subtree_depths(rows: DataFrame, key: str, counts: Column) -> DataFrame:
    """The rows with ``_depth``, how many nodes of the path from the root to a node, itself included, count."""
    marked = rows.withColumn("_counts", counts)
    begin = marked.select("*", (2 * F.col("pre")).alias("_p"), F.col("_counts").cast("int").alias("_d"), F.lit(True).alias("_node"))
    end = marked.select("*", (2 * F.col("last") + 1).alias("_p"), (-F.col("_counts").cast("int")).alias("_d"), F.lit(False).alias("_node"))
    along = Window.partitionBy(key).orderBy("_p").rangeBetween(Window.unboundedPreceding, 0)
    return begin.unionByName(end).withColumn("_depth", F.sum("_d").over(along)).where("_node").drop("_p", "_d", "_node")
