"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word of the vocabulary has a sparse ternary index vector made from its hash. Its context vector
is the sum of the index vectors of the words within two places of it, over *all* documents; the worker
sums a partition, and sums of partitions are added in two levels by blocks of words, so what is shuffled
is bounded by partitions x vocabulary and no task adds more than a share of the partitions. A document is pooled to the mean and the deviation of its word vectors and
the mean change between neighbours. A network with one hidden layer, in numpy, is trained on a bounded
sample of labelled rows, and a temperature fitted on a part held back calibrates its probabilities.

Bounds of what is fitted on the driver: ``SAMPLE_ROWS`` labelled rows, of which only pooled vectors
are collected; the ``VOCABULARY`` commonest words of these rows, and the ``SHAPES`` commonest shapes of
their other words. Words outside the vocabulary count under their shape. Scoring is one pass without a
shuffle.

Defined results: null and empty texts pool to zeros and get the network's score for that. Without any
labelled row every score is 0.5. A row labelled twice alike counts once, one with both labels once for
each. Words equally common are taken in their own order. Repeated rows give repeated rows; an
empty table gives no rows; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm.common import documents, drop_staged, labelled_sample, let_go, map_batches, remainder, short_batches, with_fields
from brindle.session import table

#: Labelled rows that are fitted.
SAMPLE_ROWS = 6000
#: Words with vectors of their own; shapes for the others; dimensions; places that count as context.
VOCABULARY = 3584
SHAPES = 511
DIMS = 32
NEAR = 2
#: Non-zero entries of an index vector, in different dimensions.
ENTRIES = 2
#: Hidden units, passes over the sample, and the part that is held back for the temperature.
HIDDEN, EPOCHS, HELD_BACK = 32, 40, 0.2
#: Words whose vectors are gathered at once.
CHUNK = 100_000
#: Blocks of words in which partitions' sums are added, and partitions added at first.
BLOCKS, ADDED = 32, 256
THRESHOLD = 0.3

_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+")
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits become A, a and 0; other runs one character."""
    form = _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word))) if word.isascii() else _wide_shape(word)
    return _RUN.sub(r"\1", form)[:8]


def _wide_shape(word: str) -> str:
    return "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)


class Vocabulary:
    """Ids of words: 0 is unknown, then the words, then the shapes."""

    def __init__(self, words: list[str], shapes: list[str]):
        self.words = {w: k + 1 for k, w in enumerate(words)}
        self.shapes = {s: k + 1 + len(words) for k, s in enumerate(shapes)}
        self.size = 1 + len(words) + len(shapes)
        self.seen: dict[str, int] = {}

    def ids(self, text: str) -> list[int]:
        seen = self.seen
        if len(seen) > 200_000:
            seen.clear()
        out = []
        for w in text.split():
            k = seen.get(w)
            if k is None:
                k = self.words.get(w) or self.shapes.get(shape(w), 0)
                seen[w] = k
            out.append(k)
        return out

    def index_vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs of the non-zero entries, by id."""
        names = ["", *self.words, *(f"\0{s}" for s in self.shapes)]
        hashes = np.array([[xxhash.xxh64_intdigest(w, seed=k) for k in range(ENTRIES)] for w in names], dtype=np.uint64)
        # each entry is placed by its hash among the dimensions that follow the one before: none twice
        share = DIMS // ENTRIES
        place = (hashes[:, :1] % DIMS + np.arange(ENTRIES, dtype=np.uint64) * np.uint64(share) + hashes % np.uint64(share) * (np.arange(ENTRIES) > 0)) % DIMS
        return place.astype(np.int64), np.where(hashes >> np.uint64(63), 1.0, -1.0)


def contexts(ids: np.ndarray, place: np.ndarray, sign: np.ndarray, size: int) -> np.ndarray:
    """Sums of the neighbours' index vectors by id; negative ids part documents."""
    total = np.zeros(size * DIMS)
    for off in range(1, NEAR + 1):
        left, right = ids[:-off], ids[off:]
        both = (left >= 0) & (right >= 0)
        if off == 2:
            both &= ids[1:-1] >= 0
        left, right = left[both], right[both]
        for a, b in ((left, right), (right, left)):
            for k in range(ENTRIES):
                total += np.bincount(a * DIMS + place[b, k], weights=sign[b, k], minlength=size * DIMS)
    return total.reshape(size, DIMS)


def word_vectors(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The unit context vectors over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    width = -(-vocabulary.size // BLOCKS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        words = shared.value
        place, sign = words.index_vectors()
        total = np.zeros((words.size, DIMS))
        for batch in batches:
            flat: list[int] = []
            for text in batch.column("text").to_pylist():
                flat += words.ids(text or "")
                flat.append(-1)
                if len(flat) > 4 * CHUNK:
                    total += contexts(np.array(flat), place, sign, words.size)
                    flat = []
            if len(flat) > 2:
                total += contexts(np.array(flat), place, sign, words.size)
        if total.any():
            parts = [total[k * width : (k + 1) * width].astype(np.int64).tobytes() for k in range(BLOCKS)]
            group = [TaskContext.get().partitionId() // ADDED] * BLOCKS
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(group, pa.int32()), pa.array(parts, pa.binary())], ["block", "part", "sums"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, dtype=np.int64) for b in rows["sums"])
        return pd.DataFrame({"block": [key[0]], "part": [key[-1]], "sums": [total.tobytes()]})

    fields = "block int, part int, sums binary"
    partial = docs.select("text").mapInArrow(gather, fields).groupBy("block", "part").applyInPandas(add, fields)
    blocks = {r.block: r.sums for r in partial.groupBy("block").applyInPandas(add, fields).collect()}
    parts = [np.frombuffer(blocks[k], dtype=np.int64) for k in sorted(blocks)]
    sums = np.concatenate(parts).reshape(-1, DIMS).astype(np.float64) if parts else np.zeros((vocabulary.size, DIMS))
    sums -= sums.mean(axis=0)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(texts: list[str | None], vocabulary: Vocabulary, vectors: np.ndarray) -> np.ndarray:
    """Mean, deviation and mean change of the word vectors of each text, and log of its words."""
    out = np.zeros((len(texts), 3 * DIMS + 1), dtype=np.float32)
    for k, text in enumerate(texts):
        ids = np.array(vocabulary.ids(text or ""), dtype=np.int64)
        n = len(ids)
        if not n:
            continue
        total, square, change, last = np.zeros(DIMS), np.zeros(DIMS), np.zeros(DIMS), None
        for at in range(0, n, CHUNK):
            v = vectors[ids[at : at + CHUNK]]
            total += v.sum(axis=0)
            square += np.einsum("ij,ij->j", v, v)
            change += np.abs(np.diff(v, axis=0)).sum(axis=0)
            if last is not None:
                change += np.abs(v[0] - last)
            last = v[-1]
        mean = total / n
        out[k, :DIMS] = mean
        out[k, DIMS : 2 * DIMS] = np.sqrt(np.maximum(square / n - mean * mean, 0))
        out[k, 2 * DIMS : 3 * DIMS] = change / max(1, n - 1)
        out[k, -1] = np.log1p(n)
    return out


class Network:
    """One hidden layer of tanh units and a logit; Adam on the log loss; a temperature at the end."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.temperature = 1.0
        x = self._scaled(x)
        back = rng.random(len(x)) < HELD_BACK
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self._train(x[~back], y[~back], rng)
        if back.any():
            self._calibrate(x[back], y[back])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float64)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def _train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                hidden = np.tanh(x[rows] @ self.w[0] + self.w[1])
                error = (_sigmoid(hidden @ self.w[2] + self.w[3]) - y[rows]) / max(1, len(rows))
                back = np.outer(error, self.w[2]) * (1 - hidden**2)
                grads = [x[rows].T @ back + 1e-4 * self.w[0], back.sum(axis=0), hidden.T @ error + 1e-4 * self.w[2], np.array([error.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        logit = self._logit(x)
        loss = lambda t: float(np.mean(np.logaddexp(0, np.where(y > 0, -logit, logit) / t)))
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logit(self._scaled(x)) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    def __init__(self, vocabulary: Vocabulary, vectors: np.ndarray, network: Network | None):
        self.vocabulary, self.vectors, self.network = vocabulary, vectors, network

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), 0.5)
        return self.network.predict(pool(texts, self.vocabulary, self.vectors))


def commonest(sample: DataFrame, things: Callable[[str], list[str]], most: int, least: int) -> list[str]:
    """What the texts of the sample have most often, in all at least ``least`` times; ties in the things' own order."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Counter(chain.from_iterable(map(things, batch.column("text").to_pylist())))
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["w", "n"])

    counts = map_batches(sample.select("text"), count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r.w for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(most).collect()]


def learn(docs: DataFrame, labels: DataFrame, label: str, may_learn) -> Model:
    """Fit on rows (doc_id, ``label``) whose id passes ``may_learn``; vectors on all documents."""
    spark = docs.sparkSession
    short_batches(spark)
    sample = labelled_sample(docs, labels.select("doc_id", F.col(label).cast("double").alias("y")), may_learn, SAMPLE_ROWS, "quality-sample")
    words = commonest(sample, lambda text: text.split(), VOCABULARY, 3)
    known = set(words)
    vocabulary = Vocabulary(words, commonest(sample, lambda text: [shape(w) for w in text.split() if w not in known], SHAPES, 1))
    vectors = word_vectors(docs, vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, vectors))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pool(batch.column("text").to_pylist(), *shared.value)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    found = map_batches(sample, features, "doc_id long, y double, x binary").orderBy("doc_id", "y").collect()
    drop_staged(spark, sample)
    if not found:
        return Model(vocabulary, vectors, None)
    x = np.stack([np.frombuffer(r.x, dtype=np.float32) for r in found])
    return Model(vocabulary, vectors, Network(x, np.array([r.y for r in found])))


def classify(docs: DataFrame, model: Broadcast, columns: list[str], name: str = "score") -> DataFrame:
    """The named columns and the score as ``name``. ``text`` must be among the columns of ``docs``."""
    short_batches(docs.sparkSession)
    rows = docs.select(*columns, *([] if "text" in columns else ["text"]))
    schema = with_fields(docs.select(*columns), f"`{name}` double")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = pa.array(model.value.score(batch.column("text").to_pylist()), pa.float64())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), score], [*columns, name])

    return map_batches(rows, step, schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from labels whose id's crc is no multiple of 5."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = spark.sparkContext.broadcast(learn(docs, labels, "quality", lambda i: remainder(i, 5) != 0))
    return classify(docs, model, ["doc_id"]).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
