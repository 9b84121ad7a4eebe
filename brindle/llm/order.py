"""Places and running sums inside groups of any size, without one task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from brindle.llm.common import staged


def placed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows in the order of the keys, with ``part`` and ``place``: the partition and the place in it.

    Rows are dealt by ranges of the keys and written to the shared folder, which fixes the boundaries: a lost
    executor cannot deal them anew in another way. The rows should come from a written table, for they are read
    twice.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return staged(dealt.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), f"{name}-placed")


def before(rows: DataFrame, group: list[str], measure) -> DataFrame:
    """(part, group, before, total, first): what a group has in earlier partitions and in all, and its first place
    here. One row a partition and group; a group has at most one row a partition."""
    here = rows.groupBy("part", *group).agg(measure.alias("_here"), F.min("place").alias("first"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_here").over(Window.partitionBy(*group))
    return here.select("part", *group, F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("before"), total.alias("total"), "first")


def numbered(rows: DataFrame, group: list[str], keys: list[str], name: str) -> DataFrame:
    """The rows with ``idx``, their gapless place from 0 in their group in the order of the keys, and ``n``, the
    group's size. The columns of ``group`` hold no nulls."""
    dealt = placed(rows, [*group, *keys], name)
    offsets = before(dealt, group, F.count("*"))
    return dealt.join(offsets, ["part", *group]).select(*rows.columns, (F.col("before") + F.col("place") - F.col("first")).alias("idx"), F.col("total").alias("n"))
