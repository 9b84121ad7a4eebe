"""What the operators of this package share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from brindle.session import checkpoint_dir, ship, table

#: Rows of an Arrow batch that goes to Python. Texts can be long, so batches are short.
BATCH_ROWS = 1024
#: Bytes of an Arrow batch that goes to Python; Spark closes a batch at either bound.
BATCH_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds at once, whatever the length of the texts. Plans are lazy, so the session
    keeps these bounds."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read again: later steps then neither repeat the work nor
    depend on the executors that did it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has; case does not count."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, may_learn: Callable[[Column], Column], most: int, name: str) -> DataFrame:
    """doc_id, text and y of at most about ``most`` labelled rows, staged; a null text is empty.

    Ids with their label are taken by their hash, and repeated ones once. Where ids repeat among the
    documents and bring more rows than asked for, rows are taken by the hash of id, text and label, so that
    neither step gathers rows in one task and both give the same rows on every run.
    """
    known = labels.where("doc_id IS NOT NULL AND y IS NOT NULL").where(may_learn(F.col("doc_id"))).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = staged(rows, name)
    n = found.count()
    if n <= most:
        return found
    fewer = staged(found.where(F.pmod(F.xxhash64("doc_id", "text", "y"), F.lit(1 << 40)) < F.lit((1 << 40) * most // n)), name)
    drop_staged(docs.sparkSession, found)
    return fewer


def with_fields(rows: DataFrame, fields: str) -> T.StructType:
    """The schema of ``rows`` and further fields; names may be any."""
    return T.StructType([*rows.schema.fields, *T.StructType.fromDDL(fields).fields] if fields else rows.schema.fields)


#: What a worker keeps between tasks: one thing at a time, by its name.
_kept: dict[tuple, object] = {}


def kept(name: tuple, make: Callable[[], object]) -> object:
    """A worker's own copy of something costly, made once. Workers outlive tasks and stages, so what
    another step has left there is let go first."""
    if name not in _kept:
        let_go()
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """Free what a worker keeps."""
    if _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, keeps: bool = False) -> DataFrame:
    """Apply ``step`` to each Arrow batch. An empty partition gives no rows. ``keeps``: the step uses
    ``kept``; other steps begin with an empty worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            let_go()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)
