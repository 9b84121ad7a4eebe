"""The corpus pipeline: raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in the shared
folder and read again as the next stage's documents, so a lost executor repeats work of one stage only.
All stages but the last return the columns of ``documents``, also further ones, whatever their names are.

Defined results: a null text counts as empty: the classifier gives it the score of no words, near-dedup
keeps one empty document, it holds no passage and no secret, and it has no ids. Long texts are read whole.
Of a class of near copies, repeated rows included, one row with its least id stays; a class of null ids
alone keeps a row with a null id. Rows alike in id and text count as equal. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm import bpe, decontamination, near_dedup, quality_classifier, secret_scans
from brindle.llm.common import documents, drop_staged, map_batches, remainder, short_batches, staged, unused
from brindle.session import table

#: SQL can express neither the trained network nor the sketches; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"), "quality", lambda i: remainder(i, 5) != 0)
    shared = spark.sparkContext.broadcast(model)
    (score,) = unused(docs, "score")
    scored = quality_classifier.classify(docs, shared, docs.columns, score)
    return scored.where(F.col(score) >= quality_classifier.THRESHOLD).drop(score)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id."""
    return near_dedup.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; n_chars follows the new text."""
    clean = secret_scans.redact(docs, docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, their digest, and the digest of what they decode to."""
    short_batches(spark)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        mine = bpe.codec(bpe.RANKS)
        ids = mine.encode([t or "" for t in batch.column("text").to_pylist()])
        digests = [pa.array([hashlib.sha256(x).hexdigest() for x in rows]) for rows in (ids, mine.decode(ids))]
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
        arrays = [batch.column("doc_id"), batch.column("lang"), batch.column("source"), pa.array(np.diff(offsets).astype(np.int64)), lists, *digests]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "lang", "source", "text")
    return map_batches(rows, step, "doc_id long, lang string, source string, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string", keeps=True)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("byte-level bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    before = None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            drop_staged(spark, before)
        before = docs
    return docs
