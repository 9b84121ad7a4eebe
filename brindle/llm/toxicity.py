"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Labelled examples, a bounded sample, are vectors over a vocabulary of terms: tf is 1 + log of the count,
idf comes from the documents of the whole corpus that hold the term. A term is a word, or the beginning of
words in 4, 6 or 8 letters, which also catches forms that no example has. The vocabulary has the
``VOCABULARY`` terms of the sample that are most dependent on the label, whichever label they speak for.
A block-max inverted index answers a query exactly: like examples lie in one block, each term's postings
keep their greatest weight in each block, and blocks are scored in the order of their upper bounds until
the bound falls below the k-th best cosine. Neighbours vote with their cosine as weight, and isotonic
regression of leave-one-out votes turns the vote into a probability. The neighbours are the evidence.

Bounds of what is fitted on the driver: ``SAMPLE_ROWS`` labelled rows, of which only term counts are
collected, and ``VOCABULARY`` terms. Corpus counts cover every document. Scoring is one pass without a
shuffle.

Defined results: a text without a term of the vocabulary, empty and null texts included, gets the rate
of such texts among the examples. Without any labelled row every score is 0. Equal cosines go to the
example with the least id. A row labelled twice alike counts once, one with both labels once for each. Repeated rows give
repeated rows; an empty table gives no rows; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm.common import documents, drop_staged, labelled_sample, map_batches, remainder, short_batches
from brindle.session import table

#: Labelled rows that are fitted.
SAMPLE_ROWS = 6_000
#: Terms of the vocabulary at most, in at least so many examples.
VOCABULARY, LEAST_EXAMPLES = 4096, 3
#: Neighbours that vote, and the weight of the base rate beside them.
NEIGHBOURS, PRIOR = 15, 0.25
#: Examples in a block of the index, and blocks that a query scores first.
BLOCK, FIRST = 64, 4
#: A term that more than one in so many examples hold is kept as a row a block instead of postings.
COMMON = 8
THRESHOLD = 0.7
#: Neighbours given as evidence.
EVIDENCE = 3

_WORD = re.compile(r"\w+")


#: Letters of the beginnings that are terms.
STEMS = (4, 6, 8)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def terms(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


class TermCounter:
    """Counts of the known terms of texts; each distinct word is looked up once in a worker."""

    def __init__(self, known):
        self.known, self.seen = known, {}

    def __call__(self, text: str | None) -> Counter:
        found: Counter = Counter()
        seen = self.seen
        if len(seen) > 200_000:
            seen.clear()
        for w, n in Counter(tokens(text)).items():
            mine = seen.get(w)
            if mine is None:
                mine = seen[w] = tuple(t for t in terms(w) if t in self.known)
            for t in mine:
                found[t] += n
        return found


def alike(vectors: list[dict[int, float]], n_words: int) -> np.ndarray:
    """The numbers of vectors in an order that brings like ones together, in runs of ``BLOCK``.

    A set is halved along the direction in which its vectors differ most, and its halves likewise.
    """
    rows = np.zeros((len(vectors), n_words), dtype=np.float32)
    for k, v in enumerate(vectors):
        rows[k, list(v)] = list(v.values())
    left, found = [np.arange(len(vectors))], []
    while left:
        part = left.pop()
        if len(part) <= BLOCK:
            found.append(part)
            continue
        apart = rows[part] - rows[part].mean(axis=0)
        along = apart[np.argmax((apart**2).sum(axis=1))]
        for _ in range(8):  # power iteration
            along = apart.T @ (apart @ along)
            along /= max(float(np.linalg.norm(along)), 1e-12)
        half = -(-len(part) // (2 * BLOCK)) * BLOCK
        by = np.argsort(apart @ along, kind="stable")
        left += [part[by[half:]], part[by[:half]]]
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


class BlockMaxIndex:
    """Postings of unit vectors by word and block, with the greatest weight of each.

    Like vectors share a block of ``BLOCK``, so that a query's bounds differ between blocks. The postings of
    a word are in the order of the blocks; ``spans`` gives where those of a word in a block begin. Words of more than
    one in ``COMMON`` examples, few but with nearly all of the postings that queries meet, have rows in ``common`` instead,
    which take at most that many times their postings' room and are multiplied as they lie. Blocks are scored in waves by their bounds: the first is the ``FIRST`` best ones, each later one has four times as many, of
    those that the k-th best cosine so far, or of equal ones the least number in the block, leaves open. Weights are kept in single precision. ``scored`` counts
    the blocks that queries have scored.
    """

    def __init__(self, vectors: list[dict[int, float]], n_words: int):
        self.n_blocks, self.scored = -(-len(vectors) // BLOCK), 0
        self.order = alike(vectors, n_words)
        self.least = np.minimum.reduceat(self.order, np.arange(0, len(vectors), BLOCK)) if vectors else np.zeros(1, np.int64)
        held = [(w, place, weight) for place, k in enumerate(self.order.tolist()) for w, weight in vectors[k].items()]
        word, place = (np.array([x[k] for x in held], dtype=np.int64) for k in (0, 1))
        weight = np.array([x[2] for x in held], dtype=np.float32)
        self.ceilings = np.zeros((n_words, max(1, self.n_blocks)))
        np.maximum.at(self.ceilings, (word, place // BLOCK), weight)
        held_by = np.bincount(word, minlength=n_words)
        often = np.flatnonzero(held_by * COMMON > len(vectors))
        self.row = np.full(n_words, -1, dtype=np.int64)
        self.row[often] = np.arange(len(often))
        self.common = np.zeros((self.n_blocks, BLOCK, len(often)))
        row = self.row[word]
        self.common[place[row >= 0] // BLOCK, place[row >= 0] % BLOCK, row[row >= 0]] = weight[row >= 0]
        by = np.lexsort((place, word))
        by = by[row[by] < 0]
        self.places, self.weights = place[by], weight[by]
        cell = (word * self.n_blocks + place // BLOCK)[by]
        self.spans = np.searchsorted(cell, np.arange(n_words * self.n_blocks + 1))

    def _cosines(self, words: np.ndarray, q: np.ndarray, often: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines of all places, of which those in the blocks are whole: ``words`` have postings, ``often`` is over the rows."""
        cells = (words[:, None] * self.n_blocks + blocks[None, :]).reshape(-1)
        start, end = self.spans[cells], self.spans[cells + 1]
        some = np.flatnonzero(end > start)
        start, n = start[some], end[some] - start[some]
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        found = np.bincount(self.places[at], self.weights[at] * np.repeat(q[some // len(blocks)], n), self.n_blocks * BLOCK)
        of_common = np.zeros((self.n_blocks, BLOCK))
        for b in blocks.tolist():
            np.dot(self.common[b], often, out=of_common[b])
        return (found + of_common.reshape(-1))[: len(self.order)]

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of the greatest positive cosine, exactly; equal ones by their number."""
        words, q = np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), float, len(query))
        # rounded as cosines are; the margin is for the order of the sums
        bounds = np.round(q @ self.ceilings[words] + 1e-12, 9)
        row, often = self.row[words], np.zeros(self.common.shape[2])
        often[row[row >= 0]] = q[row >= 0]
        words, q = words[row < 0], q[row < 0]
        scores, numbers = np.empty(0), np.empty(0, dtype=np.int64)
        blocks, wave = np.lexsort((self.least, -bounds)), FIRST
        blocks = blocks[bounds[blocks] > 0]
        while len(blocks):
            self.scored += len(blocks[:wave])
            found = self._cosines(words, q, often, blocks[:wave])
            some = np.flatnonzero(found > (scores[-1] - 1e-8 if len(scores) == k else 0.0))
            found = np.round(found[some], 9)
            fresh = self.order[some]
            other = (fresh != without) & (found > 0)
            scores, numbers = np.concatenate([scores, found[other]]), np.concatenate([numbers, fresh[other]])
            best = np.lexsort((numbers, -scores))[:k]
            scores, numbers = scores[best], numbers[best]
            blocks, wave = blocks[wave:], 4 * wave
            if len(scores) == k:
                blocks = blocks[(bounds[blocks] > scores[-1]) | ((bounds[blocks] == scores[-1]) & (self.least[blocks] < numbers[-1]))]
        return list(zip(scores.tolist(), numbers.tolist()))


class Model:
    """Vocabulary, idf, the index over the examples, and the calibration."""

    def __init__(self, words: list[str], idf: np.ndarray, examples: list[tuple[int, dict[str, int], int]]):
        self.words, self.idf = {w: k for k, w in enumerate(words)}, idf
        self.counter = None
        vectors = [(i, self.vector(counts), y) for i, counts, y in examples]
        blank = [y for _, v, y in vectors if not v]
        held = [x for x in vectors if x[1]]
        self.ids, self.labels = [i for i, _, _ in held], [y for _, _, y in held]
        self.base = sum(y for _, _, y in vectors) / max(1, len(vectors))
        self.blank = (sum(blank) + self.base) / (len(blank) + 1)
        self.index = BlockMaxIndex([v for _, v, _ in held], len(words))
        self.raw, self.level = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        if held:
            votes = [self.vote(self.index.nearest(v, NEIGHBOURS, without=k)) for k, (_, v, _) in enumerate(held)]
            self.raw, self.level = isotonic(np.array(votes), np.array(self.labels, dtype=float))

    def vector(self, counts: dict[str, int]) -> dict[int, float]:
        found = {self.words[w]: (1 + np.log(n)) * self.idf[self.words[w]] for w, n in counts.items() if w in self.words}
        norm = sum(x * x for x in found.values()) ** 0.5
        return {w: float(x / norm) for w, x in found.items()}

    def vote(self, found: list[tuple[float, int]]) -> float:
        weight = sum(s for s, _ in found)
        return (PRIOR * self.base + sum(s * self.labels[row] for s, row in found)) / (PRIOR + weight)

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        if self.counter is None:
            self.counter = TermCounter(self.words)
        vector = self.vector(self.counter(text))
        if not vector:
            return self.blank, []
        found = self.index.nearest(vector, NEIGHBOURS)
        evidence = [{"doc_id": self.ids[row], "similarity": s, "label": self.labels[row]} for s, row in found[:EVIDENCE]]
        return float(np.interp(self.vote(found), self.raw, self.level)), evidence


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit, each pool shrunk towards the next by one vote."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of labels, count, sum of raw
    for x, y in zip(raw[order], label[order]):
        pools.append([y, 1, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    knots = np.array([p[2] / p[1] for p in pools])
    level = np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])
    return knots, np.maximum.accumulate(level)


def word_counts(docs: DataFrame, words: list[str]) -> tuple[np.ndarray, int]:
    """Documents that hold each word, and all documents."""
    shared = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(shared.value), dtype=np.int64), 0
        counter = TermCounter(shared.value)
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column("text").to_pylist():
                for w in counter(text):
                    total[shared.value[w]] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([rows, *total[some].tolist()], pa.int64())], ["word", "n"])

    counts, n = np.zeros(len(words), dtype=np.int64), 0
    for r in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r.word < 0:
            n = r.n
        else:
            counts[r.word] = r.n
    return counts, n


def presence(sample: DataFrame) -> DataFrame:
    """(w, n, ones): the rows of the sample that hold each term, and those with label 1."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                here, ones = Counter(), Counter()
                for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist()):
                    found = {t for w in set(tokens(text)) for t in terms(w)}
                    here.update(found)
                    if y:
                        ones.update(found)
                arrays = [pa.array(list(here), pa.string()), pa.array(list(here.values()), pa.int64()), pa.array([ones[w] for w in here], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["w", "n", "ones"])

    rows = sample.select("text", "y").mapInArrow(distinct, "w string, n long, ones long")
    return rows.groupBy("w").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))


def vocabulary(sample: DataFrame) -> list[str]:
    """The terms whose presence depends most on the label, by chi-square; ties by the term."""
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones")).first()
    a, df = F.col("ones").cast("double"), F.col("n").cast("double")
    b, c = df - a, total.ones - a
    d = total.n - df - c
    chi2 = total.n * (a * d - b * c) ** 2 / F.greatest(F.lit(1.0), (a + b) * (c + d) * (a + c) * (b + d))
    chosen = presence(sample).where(F.col("n") >= LEAST_EXAMPLES).select("w", chi2.alias("chi2"))
    return [r.w for r in chosen.orderBy(F.desc("chi2"), "w").limit(VOCABULARY).collect()]


def learn(docs: DataFrame, labels: DataFrame, label: str, may_learn) -> Model:
    """Fit on rows (doc_id, ``label``) whose id passes ``may_learn``; corpus counts on all documents."""
    spark = docs.sparkSession
    short_batches(spark)
    sample = labelled_sample(docs, labels.select("doc_id", F.col(label).cast("int").alias("y")), may_learn, SAMPLE_ROWS, "toxicity-sample")
    words = vocabulary(sample)
    shared = spark.sparkContext.broadcast(set(words))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(map(TermCounter(shared.value), batch.column("text").to_pylist()))
        kind = pa.map_(pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([list(c.items()) for c in found], kind)], ["doc_id", "y", "counts"])

    examples = [(r.doc_id, r.counts, r.y) for r in map_batches(sample, count, "doc_id long, y int, counts map<string,int>").collect()]
    drop_staged(spark, sample)
    examples.sort(key=lambda x: (x[0], x[2]))
    counts, n = word_counts(docs, words)
    return Model(words, np.log((1 + n) / (1 + counts)) + 1, examples)


def score(docs: DataFrame, model: Broadcast) -> DataFrame:
    """(doc_id, text) -> doc_id, score, evidence: the nearest examples with cosine and label."""
    short_batches(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.value.score(t) for t in batch.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], kind)], ["doc_id", "score", "evidence"])

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,label:int>>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learned from labels whose id's crc leaves 0 or 2 by 3."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = spark.sparkContext.broadcast(learn(docs, labels, "toxic", lambda i: remainder(i, 3) != 1))
    return score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence",
    )
