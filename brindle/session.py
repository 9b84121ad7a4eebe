"""Session construction and table access shared by every entry point."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", memory: str = "8g", partitions: int = 8, more: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.config(map=more or {})
        .master(f"local[{cpus}]")
        .appName("brindle")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables; a file or a directory of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's own, or a local one where none is set.

    The setting ``spark.checkpoint.dir`` names a folder that driver and executors share. Only a
    session without it (a test on one machine) gets a folder of its own under the warehouse.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = os.path.join(os.path.abspath("spark-warehouse"), "checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def written(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder by column and read again: each later step reads the columns that it asks for.
    Files are far smaller than their rows, so Spark would broadcast what is no small table: joins are told not to."""
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path).hint("merge")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many partitions as the session has set, at least four a core: a number that is asked for
    is kept, where Spark would gather up to 64 MB of packed rows, often a gigabyte once sorted, in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a context: they import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_brindle_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "brindle.zip"  # the driver's copy, which Spark sends to the executors
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    context._brindle_shipped = True
