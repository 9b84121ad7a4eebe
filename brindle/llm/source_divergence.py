"""Source divergence audit: how the words of a language's sources differ, by sums over DuckDB shards.

Each group (language and source) and each language gives every kept term of the language a smoothed share; two
groups differ by the chi-square distance of their shares, a group from its language term by term. All sums are
exact.

The work is SQL inside Spark's tasks. A first query counts terms in a batch of texts; partial counts gather in the
task and leave it as compressed column blocks, one for each shard, which is the hash of language and term. A
second merges the blocks of a shard and keeps the terms with enough documents. A third, over shards of kept counts
with their groups' totals, sums what pairs of groups share. Terms that only one of two groups has, nearly all of
them, need no pair: their part depends on the group's count alone, so a histogram of counts gives it, and terms that
neither has have one value each. Spark merges sums and ranks. So a shard's work follows the counts that occur, never
terms times pairs of groups; only pairs of groups that share a term are joined, which the result lists anyway.

A shard is a share of all terms, whatever the language, so a language or source with most rows is spread over all
shards. Databases are bounded in memory and write what exceeds it to a folder of their own, which goes with them.
What the second step keeps is written to the shared folder; a lost executor repeats its own shards.

Defined results: null texts, languages and sources count as empty strings; an empty text makes its group occur, with
shares of unseen terms; repeated rows count each; a language without kept terms has pairs of value 0; a language of
one source has no pairs. Texts are read whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brindle.llm.common import documents, let_go, short_batches, staged

#: Documents of its language that a kept term is in; shares are out of so many.
LEAST_DOCUMENTS, WHOLE = 3, 1_000_000_000
#: Ranks of terms that are reported.
TOP_TERMS = 200
#: Partial counts that a task gathers before they leave it; memory of a database.
PARTIAL_ROWS, MEMORY = 1_000_000, "400MB"
#: What parts terms; only these letters change case.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: An empty term stands for the group itself.
COUNT = f"""
INSERT INTO partial
WITH t AS (SELECT i, lang, source, unnest(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '{SEPARATORS}')) AS term FROM batch),
d AS (SELECT lang, source, term, count(*) AS n FROM t WHERE term <> '' GROUP BY i, lang, source, term)
SELECT lang, source, term, sum(n)::BIGINT, count(*) FROM d GROUP BY ALL
UNION ALL SELECT DISTINCT lang, source, '', 0, 0 FROM batch
"""
DEALT = "SELECT (hash(lang, term) % {shards})::INTEGER AS shard, lang, source, term, sum(n)::BIGINT AS n, sum(df)::BIGINT AS df FROM partial GROUP BY ALL ORDER BY shard, lang, source, term"
KEEP = f"""
WITH c AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(df) AS df FROM partial GROUP BY ALL),
a AS (SELECT *, sum(df) OVER w AS docs, sum(n) OVER w AS all_n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS leads FROM c WINDOW w AS (PARTITION BY lang, term))
SELECT lang, source, term, n, all_n::BIGINT AS all_n, leads FROM a WHERE term = '' OR docs >= {LEAST_DOCUMENTS}
"""
#: Distances are whole numbers below 2^63 each, sums are wider.
DISTANCE = "((({0}) - ({1})) * (({0}) - ({1}))) // ({1})"
SHARES = f"""
CREATE TABLE shares AS SELECT lang, source, term, n, all_n,
  (1 + {WHOLE}::HUGEINT * (n + 1) // (of_source + of_terms))::BIGINT AS p, (1 + {WHOLE}::HUGEINT // (of_source + of_terms))::BIGINT AS p0,
  (1 + {WHOLE}::HUGEINT * (all_n + 1) // (of_lang + of_terms))::BIGINT AS q
FROM counts
"""
SUMS = f"""
SELECT 'both' AS kind, a.lang, a.source, b.source AS item, 0::BIGINT AS n,
  sum(({DISTANCE.format("a.p", "b.p")} - {DISTANCE.format("a.p", "b.p0")} - {DISTANCE.format("a.p0", "b.p")} + {DISTANCE.format("a.p0", "b.p0")})::HUGEINT)::DECIMAL(38, 0) AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
UNION ALL SELECT 'one', lang, source, '', n, count(*)::DECIMAL(38, 0) FROM shares GROUP BY ALL
UNION ALL (SELECT 'term', lang, source, term, n, ({DISTANCE.format("p", "q")})::DECIMAL(38, 0) AS value FROM shares WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {TOP_TERMS})
"""


class Database:
    """A database of one task, with a folder for what exceeds its memory."""

    def __enter__(self) -> duckdb.DuckDBPyConnection:
        self.folder = tempfile.mkdtemp()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder, "preserve_insertion_order": False})
        return self.db

    def __exit__(self, *_) -> None:
        self.db.close()
        shutil.rmtree(self.folder, ignore_errors=True)


PARTIAL = "CREATE OR REPLACE TABLE partial (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, df BIGINT)"


def batches_of(db: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a query in the types of the schema."""
    for batch in db.sql(sql).to_arrow_reader(100_000):
        yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in schema], schema=schema)


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def blocks(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, block): partial counts of terms; a block is a table (lang, source, term, n, df) in columns."""
    short_batches(docs.sparkSession)
    empty = F.lit("")
    rows = docs.select(F.monotonically_increasing_id().alias("i"), *[F.coalesce(c, empty).alias(c) for c in ("lang", "source", "text")])

    def leave(db: duckdb.DuckDBPyConnection) -> Iterator[pa.RecordBatch]:
        found = db.sql(DEALT.format(shards=shards)).to_arrow_table()
        db.execute(PARTIAL)
        shard = found.column("shard").to_numpy()
        cuts = [0, *((shard[1:] != shard[:-1]).nonzero()[0] + 1).tolist(), len(shard)]
        body = found.drop_columns(["shard"])
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int32()), pa.array([packed(body.slice(a, b - a))], pa.binary())], ["shard", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        with Database() as db:
            db.execute(PARTIAL)
            for batch in batches:
                db.register("batch", pa.Table.from_batches([batch]))
                db.execute(COUNT)
                db.unregister("batch")
                if db.sql("SELECT count(*) FROM partial").fetchall()[0][0] > PARTIAL_ROWS:
                    yield from leave(db)
            yield from leave(db)

    return rows.mapInArrow(run, "shard int, block binary")


def kept_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, all_n, leads): counts of kept terms by group and in the language; one row of a term
    leads. A row of the empty term stands for each group that occurs."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = "lang string, source string, term string, n long, all_n long, leads boolean"
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("all_n", pa.int64()), ("leads", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        with Database() as db:
            db.execute(PARTIAL)
            for batch in batches:
                for block in batch.column("block"):
                    table = pa.ipc.open_stream(block.as_buffer()).read_all()
                    db.register("block", table)
                    db.execute("INSERT INTO partial SELECT lang, source, term, n, df FROM block")
                    db.unregister("block")
            yield from batches_of(db, KEEP, schema)

    return staged(blocks(docs, shards).repartition(shards, "shard").mapInArrow(run, fields), "kept-terms")


def shard_sums(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(kind, lang, source, item, n, value): partial sums of pairs that share terms, how many terms a group has so
    often, and the leading terms of a shard, staged."""
    rows = counts.join(totals, ["lang", "source"]).repartition("lang", "term")
    columns = ["lang", "source", "term", "n", "all_n", "of_source", "of_terms", "of_lang"]
    schema = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("n", pa.int64()), ("value", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        with Database() as db:
            db.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, all_n BIGINT, of_source BIGINT, of_terms BIGINT, of_lang BIGINT)")
            for batch in batches:
                db.register("batch", pa.Table.from_batches([batch]))
                db.execute("INSERT INTO counts FROM batch")
                db.unregister("batch")
            db.execute(SHARES)
            yield from batches_of(db, SUMS, schema)

    return staged(rows.select(*columns).mapInArrow(run, "kind string, lang string, source string, item string, n long, value decimal(38,0)"), "shard-sums")


def share(n: str, whole: str, terms: str) -> F.Column:
    return F.expr(f"1 + CAST({WHOLE} AS DECIMAL(20,0)) * CAST({n} + 1 AS DECIMAL(18,0)) div CAST({whole} + {terms} AS DECIMAL(19,0))")


def distance(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` holds a group's distance from each other source of its
    language, part ``term`` its leading terms against the language."""
    kept = kept_counts(docs)
    real = F.col("term") != ""
    count = F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0))
    groups = kept.groupBy("lang", "source").agg(count.alias("of_source"), F.sum(F.when(real & F.col("leads"), 1).otherwise(0)).alias("_terms"))
    langs = groups.groupBy("lang").agg(F.sum("_terms").alias("of_terms"), F.sum("of_source").alias("of_lang"))
    totals = staged(groups.drop("_terms").join(langs, "lang"), "group-totals")
    sums = shard_sums(kept.where(real), totals)

    other = totals.select("lang", F.col("source").alias("item"), F.col("of_source").alias("of_item"))
    unseen = [F.when(F.col("of_terms") > 0, share("0", "of_source", "of_terms")).alias("p0"), F.when(F.col("of_terms") > 0, share("0", "of_item", "of_terms")).alias("q0")]
    pairs = totals.join(other, "lang").where("source <> item").select("lang", "source", "item", "of_terms", *unseen)
    neither = pairs.select("lang", "source", "item", F.coalesce(F.col("of_terms") * distance("p0", "q0"), F.lit(0)).cast("decimal(38,0)").alias("value"))
    # a group's terms against the unseen share of every other, both ways round
    often = sums.where("kind = 'one'").groupBy("lang", "source", "n").agg(F.sum("value").alias("terms"))
    held = often.join(totals, ["lang", "source"]).join(other, "lang").where("source <> item").select("lang", "source", "item", "terms", share("n", "of_source", "of_terms").alias("p"), *unseen)
    ours = held.select("lang", "source", "item", (F.col("terms") * (distance("p", "q0") - distance("p0", "q0"))).cast("decimal(38,0)").alias("value"))
    theirs = held.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("terms") * (distance("q0", "p") - distance("q0", "p0"))).cast("decimal(38,0)").alias("value"))
    both = sums.where("kind = 'both'").select("lang", "source", "item", "value")
    summed = neither.unionByName(ours).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = sums.where("kind = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    return ranked(summed, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= TOP_TERMS))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return divergence(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k USING (lang) GROUP BY g.lang),
t AS (SELECT g.lang, g.source, v.v, v.n AS of_lang, coalesce(sum(c.n), 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (t.n + t.v)::HUGEINT)::BIGINT AS p,
        (1 + 1000000000::HUGEINT * (k.n + 1) // (t.of_lang + t.v)::HUGEINT)::BIGINT AS q
      FROM t JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
z AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
x AS (SELECT lang, source, 'pair' AS part, item, value FROM z UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM y WHERE part = 'pair' OR rank <= 200
"""
