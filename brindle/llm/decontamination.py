"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A test item is a row of words (lower-cased, letters and digits). Its seeds are its three-word n-grams that
at most ``RARE`` items of the benchmark hold; an item with fewer than ``LEAST_SEEDS`` such places takes its
rarest n-grams up to that number, and all that are as rare as the last of them. So the opening that a
template gives to thousands of items points to none of them, while an item that is nearly all template
keeps its seeds. Rarity is counted over the benchmark: copies in the documents cannot change it.

Seeds join the documents' n-grams; hits of one item that lie on near diagonals form a passage; the passage,
with a margin, is aligned with the item by Smith-Waterman (match 2, mismatch -1, gap -1), and its score over
the best possible tells exact, edited and paraphrased copies from chance. Before hits are expanded, an item
goes if too few of its seeds, or fewer than half its words, occur in the document, and a passage goes if
fewer than half the item's words occur in it: a score of ``CONTAMINATED`` needs that many matches. Nothing
caps hits, passages or documents.

Scale: the benchmark's seeds go to the workers if there are at most ``BROADCAST_SEEDS`` of them, whose
arrays have a fixed size each; a larger benchmark is split into parts of that many (rarity is counted within
a part), one pass for each, and the parts' results are united. The documents are never shuffled: a pass is a
map that emits one row a contaminated (document, item). A task holds the hits of ``CHUNK`` or of one item,
and each distinct passage of an item is aligned once a document.

``LEAST_HITS`` and ``DRIFT`` cost recall where few words in a row survive: of passages with three tenths of
their words replaced at least nine in ten are found (test).

Defined results: null and empty texts and items hold nothing. An item with fewer than three words has one
n-gram, all its words. Ids of items that repeat are reported once for each of their texts. Repeated rows
give repeated rows; empty tables give no rows; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import documents, let_go, short_batches
from brindle.session import table

NGRAM = 3
#: Items that may hold an n-gram that counts as rare.
RARE = 8
#: Places of an item that seeds cover at least, if it has as many.
LEAST_SEEDS = 20
#: Hits that are expanded at once, unless one item has more.
CHUNK = 1 << 18
#: Seeds that are sent to the workers at once (about 60 bytes each).
BROADCAST_SEEDS = 1_000_000
#: Hits of one passage: at least this many, unless the item has fewer.
LEAST_HITS = 2
#: Words that a diagonal may drift within a passage, for edits.
DRIFT = 12
MATCH, MISMATCH, GAP = 2, -1, -1
#: The least score over the score of a perfect copy.
CONTAMINATED = 0.5

_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Items:
    """The test items as arrays of word codes, and their n-grams as sorted keys.

    Word codes start at 1; a word that no item has is 0, so an n-gram with it is no key.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        words = [tokens(text) for _, text in rows]
        self.ids = [i for (i, _), w in zip(rows, words) if w]
        self.code: dict[str, int] = {}
        self.words = [np.array([self.code.setdefault(x, len(self.code) + 1) for x in w], dtype=np.int64) for w in words if w]
        self.base = len(self.code) + 1
        grams = [(key, item, at) for item, w in enumerate(self.words) for at, key in enumerate(self.keys(w).tolist())]
        self.grams = np.array(sorted(grams) or np.empty((0, 3)), dtype=np.int64).reshape(-1, 3)
        self.distinct = np.unique(self.grams[:, 0])
        self.choose()

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """The n-gram key at each place. The base is small enough for 63 bits up to 2 million words."""
        if len(codes) < NGRAM:
            short = np.zeros(NGRAM, dtype=np.int64)
            short[: len(codes)] = codes
            codes = short
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        return (a * self.base + b) * self.base + c

    def encode(self, text: str | None) -> np.ndarray:
        get = self.code.get
        return np.array([get(w, 0) for w in tokens(text)], dtype=np.int64)

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a document and the distinct n-grams (by index) that start there."""
        known = codes > 0
        if len(codes) >= NGRAM:
            places = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
            keys = (codes[places] * self.base + codes[places + 1]) * self.base + codes[places + 2]
        else:
            places, keys = (np.zeros(1, np.int64), self.keys(codes)) if len(codes) and known.all() else (np.empty(0, np.int64),) * 2
        at = np.searchsorted(self.distinct, keys)
        hit = at < len(self.distinct)
        hit[hit] = self.distinct[at[hit]] == keys[hit]
        return places[hit], at[hit]

    def choose(self) -> None:
        """The seeds: n-grams that few items hold, and the rarest of items that have too few of those."""
        gram, item = np.searchsorted(self.distinct, self.grams[:, 0]), self.grams[:, 1]
        held = np.unique(gram * len(self.words) + item)
        rarity = np.bincount(held // max(1, len(self.words)), minlength=len(self.distinct))[gram]
        order = np.lexsort((rarity, item))
        size = np.bincount(item, minlength=len(self.words))
        last = np.cumsum(size) - size + np.minimum(size, LEAST_SEEDS) - 1
        bound = np.maximum(RARE, rarity[order][last]) if len(order) else np.empty(0, np.int64)
        kept = rarity <= bound[item]
        # seeds by n-gram lead from a document to its items, seeds by item to the places of the hits
        self.gram, self.item, self.offset = gram[kept], item[kept], self.grams[kept, 2]
        self.span = np.searchsorted(self.gram, np.arange(len(self.distinct) + 1))
        self.by_item = np.lexsort((self.offset, self.item))
        self.item_span = np.searchsorted(self.item[self.by_item], np.arange(len(self.words) + 1))
        self.least = np.minimum(LEAST_HITS, np.diff(self.item_span))
        self.flat = np.concatenate(self.words) if self.words else np.empty(0, np.int64)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The Smith-Waterman score and where, in the passage, the alignment ends (exclusive).

    Each row is one vector operation: gaps along the passage are a running maximum.
    """
    slope = -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range of n, one range after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def candidates(items: Items, codes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Items that have enough seeds among these n-grams and half of their words in the document.

    The work is bounded by the benchmark, however often the document repeats an n-gram.
    """
    seeds = _ranges(items.span[grams], items.span[grams + 1] - items.span[grams])
    hits = np.bincount(items.item[seeds], minlength=len(items.words))
    able = np.flatnonzero((hits > 0) & (hits >= items.least))
    if not len(able):
        return able
    here = np.zeros(items.base, dtype=bool)
    here[codes] = True
    here[0] = False
    there = here[items.flat[_ranges(items.start[able], items.size[able])]]
    matches = np.add.reduceat(there.astype(np.int64), np.cumsum(items.size[able]) - items.size[able])
    return able[matches >= CONTAMINATED * items.size[able]]


def passages(items: Items, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of the passages of a document that seeds of an item point to, item by item."""
    places, grams = items.found(codes)
    if not len(places):
        return
    order = np.argsort(grams, kind="stable")
    places = places[order]
    distinct, first, n = np.unique(grams[order], return_index=True, return_counts=True)
    able = candidates(items, codes, distinct)
    at = items.by_item[_ranges(items.item_span[able], items.item_span[able + 1] - items.item_span[able])]
    index = np.minimum(np.searchsorted(distinct, items.gram[at]), len(distinct) - 1)
    met = distinct[index] == items.gram[at]
    at, index = at[met], index[met]
    # chunks of whole items, each of CHUNK hits unless its last item has more
    total = np.cumsum(n[index])
    begins = np.flatnonzero(np.diff(items.item[at], prepend=-1))
    before = np.append(total, 0)[begins - 1]  # the first item's is the 0 at the end
    cuts = begins[np.flatnonzero(np.diff(before // CHUNK, prepend=-1))]
    for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
        many = n[index[lo:hi]]
        place, seed = places[_ranges(first[index[lo:hi]], many)], np.repeat(at[lo:hi], many)
        item, diagonal = items.item[seed], place - items.offset[seed]
        by = np.lexsort((diagonal, item))
        item, diagonal, seed = item[by], diagonal[by], seed[by]
        starts = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (np.diff(diagonal) > DRIFT)))
        ends = np.append(starts[1:], len(item))
        group = np.repeat(np.arange(len(starts)), ends - starts)
        hits = np.bincount(np.unique(group * len(items.gram) + seed) // len(items.gram), minlength=len(starts))
        for g in np.flatnonzero(hits >= items.least[item[starts]]).tolist():
            k = int(item[starts[g]])
            yield k, max(0, int(diagonal[starts[g]]) - DRIFT), int(diagonal[ends[g] - 1]) + len(items.words[k]) + DRIFT


def contaminated(items: Items, text: str | None) -> list[tuple[int, float, int, int]]:
    """(item, score, start, end) of the best passage of each item in a text, in words."""
    codes = items.encode(text)
    best: dict[int, tuple[float, int, int]] = {}
    last, seen = -1, set()
    for k, start, end in passages(items, codes):
        words, passage = items.words[k], codes[start:end]
        if k != last:
            last, seen = k, set()
        key = hashlib.sha256(passage.tobytes()).digest()
        if key in seen or np.isin(words, passage).sum() < CONTAMINATED * len(words):
            continue
        seen.add(key)
        score, upto = align(words, passage)
        share = score / (MATCH * len(words))
        if share >= CONTAMINATED and share > best.get(k, (0.0, 0, 0))[0]:
            best[k] = (share, start, start + upto)
    return [(items.ids[k], *found) for k, found in sorted(best.items())]


def _parts(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in parts of a bounded number of seeds. Rows come one by one, not all at once."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(tokens(r.text))
        if rows and size + n > BROADCAST_SEEDS:
            yield Items(rows)
            rows, size = [], 0
        rows.append((r.item_id, r.text))
        size += n
    if rows:
        yield Items(rows)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, start and end (in words) of the contaminated documents."""
    spark = docs.sparkSession
    short_batches(spark)
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    result = None
    for items in _parts(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            let_go()
            for batch in batches:
                found = [(i, *x) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for x in contaminated(shared.value, text)]
                columns = zip(*found) if found else [()] * 5
                arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "score", "start_word", "end_word"])

        part = docs.select("doc_id", "text").mapInArrow(search, schema)
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], schema) if result is None else result


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no passage of the benchmark, with all their columns.

    A map for each part of the benchmark, without a join, so rows that share an id are judged alone.
    """
    spark = docs.sparkSession
    short_batches(spark)
    kept = docs
    for items in _parts(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            let_go()
            for batch in batches:
                yield batch.filter(pa.array([not contaminated(shared.value, t) for t in batch.column("text").to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(keep, docs.schema)
    return kept


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) of all documents and the whole benchmark that aligns."""
    return find(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
