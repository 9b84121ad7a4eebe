"""Numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.session import checkpoint_dir


def numbered(rows: DataFrame, keys: list, name: str) -> DataFrame:
    """The rows with ``name``: 1, 2, ... in the order of the keys, which should have no ties.

    Rows are dealt by ranges of the keys and counted within a partition; the partitions' totals, one row
    each, give every partition its start. The dealt rows are cut from their lineage, so that a lost
    executor cannot deal them anew in another way.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    mine = dealt.withColumns({"_part": F.shiftright(F.monotonically_increasing_id(), 33), "_at": F.monotonically_increasing_id() % (1 << 33)}).checkpoint()
    totals = sorted((r["_part"], r["n"]) for r in mine.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for part, n in totals:
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    return mine.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")
