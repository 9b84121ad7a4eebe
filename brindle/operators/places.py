"""Joins on ranges and positions: innermost spans, hunks, nearest earlier rows, guards between rows.

Spark has no range join, so ranges are cut at multiples of a width and joined by the cell they touch; the
exact condition follows. A cell keeps both sides of the equi join small, whatever the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def cells(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def containing(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Each point joined with every span of its key that contains it."""
    left = points.withColumn("_cell", F.floor(F.col(point) / width))
    right = spans.withColumn("_cell", cells(F.col(start), F.col(end), width))
    return left.join(right, [key, "_cell"]).where(F.col(point).between(F.col(start), F.col(end))).drop("_cell")


def innermost(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, id_: list[str], tie: str, width: int = 64) -> DataFrame:
    """Each point with its smallest span; points outside all spans have nulls."""
    size = F.col(end) - F.col(start)
    held = containing(points, spans, key, point, start, end, width)
    first = held.withColumn("_r", F.row_number().over(Window.partitionBy(*id_).orderBy(size, tie))).where("_r = 1")
    extra = [c for c in spans.columns if c != key]
    return points.join(first.select(*id_, *extra), id_, "left")


def in_hunk(hunks: Column, line: Column) -> Column:
    """Whether a hunk (start, n) of the array holds the line."""
    return F.exists(hunks, lambda h: (h["n"] > 0) & line.between(h["start"], h["start"] + h["n"] - 1))


def latest_before(rows: DataFrame, key: list[str], order: list[str], value: str, keep: Column, name: str) -> DataFrame:
    """As-of: the last ``value`` of a row that passes ``keep``, strictly before each row of the key."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(keep, F.col(value)), ignorenulls=True).over(before))


def repeated_guards(guards: DataFrame, writes: DataFrame, scope: str, subject: str, pos: str) -> DataFrame:
    """Guards with an earlier equal guard in the scope and no write to the subject between the two.

    It suffices to look at the latest equal guard, so the join stays linear: writes and guards are one
    ordered run, in which a write forgets the guard before it.
    """
    run = guards.select(scope, subject, pos, F.lit(1).alias("_g")).unionByName(writes.select(scope, subject, pos, F.lit(0).alias("_g")))
    before = Window.partitionBy(scope, subject).orderBy(pos, "_g")
    return run.withColumn("_last", F.lag("_g").over(before)).withColumn("earlier", F.lag(pos).over(before)).where("_g = 1 AND _last = 1").select(scope, subject, pos, "earlier")


def runs(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Adjacent ranges of a key in one run get the same ``run``: a range starts the line after another ends."""
    order = Window.partitionBy(key).orderBy(start, end)
    fresh = (F.col(start) > F.coalesce(F.lag(end).over(order), F.lit(-2)) + 1).cast("int")
    return rows.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
