"""Sharding by Hilbert-curve order.

Four metadata dimensions (language, source, size, id) are quantised to a grid by quantiles, so that each
cell of a dimension holds about as many rows, names in the order of their first letters; each row gets the index of
its cell along a Hilbert curve, the rows are sorted by that index, and the sorted run is cut into shards
of equal counts (law ``rows``). Rows near in all dimensions lie in one shard, so the minima and maxima of
a shard prune reads on any of the dimensions. Rows with equal texts take the place of one of them (the
least language, source and id of the group), so a group is one stretch of the run and only the cuts
between shards, at most one less than there are shards, can part one.

Native: column expressions, a partial aggregation and a join of narrow rows by (size, crc), whose hot
groups Spark splits, one range exchange of narrow rows (no text), and a broadcast of one row per
partition. The exchange sorts by (index, size, crc, id), so a hot source, which is a third of one
dimension, is still split by the others and by the id; only rows equal in every column shown can meet.
The ranked rows are written to the shared folder, which fixes the partition boundaries: a lost
executor cannot change a rank afterwards.

Defined results: a null text has size 8 and the crc of the empty string; a null id sorts first and
keeps its row; repeated rows get slots of their own; an empty table gives no rows. Other columns of
the input than the named dimensions are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from brindle.llm.common import documents, staged

SHARDS = 24
#: Bytes that a row's header takes in a shard file.
HEADER = 8
#: Bits of each dimension; four dimensions give an index of 24 bits.
BITS = 6


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """The index along the Hilbert curve of a cell given by ``dims``, each in [0, 2^bits).

    Skilling's transposition: rotate and reflect from the top bit down, Gray-encode, and interleave
    the bits. Each pass is a fold over an array of the coordinates, so the expression does not grow
    with the number of bits.
    """
    n, top = len(dims), 1 << (bits - 1)
    start = F.array(*[d.cast("int") for d in dims])
    steps = F.array(*[F.struct(F.lit(top >> b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1) for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        low, i = step["q"] - 1, step["i"]
        here = F.get(x, i)
        swap = F.get(x, F.lit(0)).bitwiseXOR(here).bitwiseAND(low)
        return F.when(
            here.bitwiseAND(step["q"]) != 0,
            F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)),
        ).otherwise(F.transform(x, lambda v, k: F.when((k == 0) | (k == i), v.bitwiseXOR(swap)).otherwise(v)))

    turned = F.aggregate(steps, start, turn)
    # Gray encoding is a running xor over the coordinates
    gray = lambda x: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.aggregate(F.slice(x, 1, k + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

    def mend(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        flips = [F.when(last.bitwiseAND(F.lit(top >> b)) != 0, F.lit((top >> b) - 1)).otherwise(F.lit(0)) for b in range(bits - 1)]
        flip = reduce(lambda a, v: a.bitwiseXOR(v), flips)
        return _let(flip, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    def interleave(x: Column) -> Column:
        places = [(b, i) for b in range(bits - 1, -1, -1) for i in range(n)]
        parts = [F.shiftleft(F.shiftright(F.get(x, F.lit(i)), b).bitwiseAND(F.lit(1)).cast("long"), len(places) - 1 - k) for k, (b, i) in enumerate(places)]
        return reduce(lambda a, v: a.bitwiseOR(v), parts)

    return _let(_let(_let(turned, gray), mend), interleave)


def letters(name: Column) -> Column:
    """A number that orders names by their first six bytes; null counts as the empty name."""
    first = F.hex(F.substring(F.encode(F.coalesce(name, F.lit("")), "UTF-8"), 1, 6))
    return F.conv(F.rpad(first, 12, "0"), 16, 10).cast("long")


def cell(value: Column, bounds: list) -> Column:
    """How many of a dimension's quantiles lie below the value: its cell, 0 for a null."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.coalesce(b < value, F.lit(False)))) if bounds else F.lit(0)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source) -> the narrow rows that are ranked."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", "lang", "source",
        (F.octet_length(text) + HEADER).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = staged(rows, "described")  # narrow: the text is read once
    values = [letters(F.col("lang")), letters(F.col("source")), F.col("size"), F.col("doc_id")]
    shares = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    quantiles = rows.agg(*[F.percentile_approx(v, shares).alias(f"q{k}") for k, v in enumerate(values)]).first()
    firsts = rows.groupBy("size", "text_crc32").agg(*[F.min(c).alias(c) for c in ("lang", "source", "doc_id")])
    dims = [cell(v, list(bounds or [])) for v, bounds in zip(values, quantiles)]
    placed = firsts.select("size", "text_crc32", hilbert_index(dims, BITS).alias("curve"))
    return rows.join(placed, ["size", "text_crc32"]).select(*rows.columns, "curve")


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``rank``, their gapless place in the order of ``keys``, and the ``total``.

    A range exchange sorts the rows; a row's place in its partition is added to the count of the
    partitions before. The counts are one row a partition, which bounds the broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    local = staged(placed.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "ranked")
    counts = local.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select(
        "part",
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    return local.join(F.broadcast(before), "part").select(*rows.columns, (F.col("before") + F.col("place")).alias("rank"), "total")


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """Each row's shard and its gapless slot there. Counts of shards differ by one at most."""
    rows = ranked(described(docs), ["curve", "size", "text_crc32", "doc_id", "lang", "source"])
    shard = F.expr(f"(rank * {n}) div total")
    start = F.expr(f"(shard * total + {n - 1}) div {n}")
    return rows.withColumn("shard", shard).withColumn("slot", F.col("rank") - start).withColumn("shard", F.col("shard").cast("int"))


def write_shards(docs: DataFrame, path: str, n: int = SHARDS) -> DataFrame:
    """Write one folder a shard, with the texts, in curve order; return the manifest.

    The text joins its place by (doc_id, size, crc); repeated rows are alike, so any pairing of them
    is right. The shuffle deals by (shard, slot range), so a shard may have several files.
    """
    keys = ["doc_id", "size", "text_crc32", "lang", "source"]
    again = Window.partitionBy(*keys).orderBy(F.lit(0))
    text = F.coalesce("text", F.lit(""))
    full = docs.select(
        "doc_id", "lang", "source", "text",
        (F.octet_length(text) + HEADER).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("copy", F.row_number().over(again))
    places = shards(docs, n).withColumn("copy", F.row_number().over(again))
    same = reduce(lambda a, b: a & b, [full[k].eqNullSafe(places[k]) for k in [*keys, "copy"]])
    rows = full.join(places, same).select(*[full[k] for k in ("doc_id", "lang", "source", "text", "size")], "shard", "slot")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(max(parts, n), "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return manifest(docs.sparkSession.read.parquet(path))


def manifest(rows: DataFrame) -> DataFrame:
    """One row a shard: count, bytes, and the least and greatest value of each dimension."""
    return rows.groupBy("shard").agg(
        F.count("*").alias("n_rows"),
        F.sum("size").alias("n_bytes"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("lang", "source", "size") for f in (F.min, F.max)],
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards cut from the curve."""
    rows = shards(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
