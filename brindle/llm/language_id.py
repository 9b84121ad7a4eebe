"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text. A document is parsed
greedily against each automaton into phrases, every phrase being the longest match from where it
starts; the language whose parse needs the fewest phrases, times log2 of its sample's length for each
character (the Ziv-Merhav estimate of the cross entropy), wins.

A parse is a walk over transitions, and all documents of a batch walk in lockstep for all languages: one
gather per character and language. The commonest letters of the samples have a dense table, all others
sorted edges that are searched, so any script can be learned. The longest documents of a batch, when few
of them are left, finish their walk one by one.

The sample is bounded: about ``SAMPLE_DOCS`` distinct texts a language, taken by their hash against
the language's count of them, long ones too. Each gives a slice, and the slices share ``SAMPLE_CHARS``
characters; ``Model.documents`` has their number. Only that sample reaches the driver, and the
tables go to the workers as arrays of at most four edges a character. Scoring is one pass over the
text without a shuffle, so no key or source can skew.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Without any labelled
row every text is ``und`` with score 0. Ties go to the language first in the alphabet. A
character that the language's sample lacks counts as two phrases, so that a foreign script costs more than
known letters in an unknown order. Repeated rows give repeated rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm.common import documents, map_batches, remainder, short_batches

#: Bounds of the sample of a language: documents, and characters of all.
SAMPLE_DOCS = 200
SAMPLE_CHARS = 20_000
#: Letters with a column in the dense table. Code 0 is a letter that no sample has, code 1 a separator.
DENSE = 126
OTHER, SEPARATOR = 0, 1
#: Documents that walk in lockstep at least.
TOGETHER = 8

_LETTER = regex.compile(r"\p{L}")


class Alphabet:
    """Codes of the lower-cased characters: letters by frequency in the samples, all else a separator."""

    def __init__(self, texts: list[str]):
        points, counts = np.unique(np.concatenate([_points(t) for t in texts] or [np.empty(0, np.uint32)]), return_counts=True)
        letters = [(-n, p) for p, n in zip(points.tolist(), counts.tolist()) if chr(p).isalpha()]
        self.points = [p for _, p in sorted(letters)]
        self.size = len(self.points) + 2
        self.table = None

    def encode(self, text: str) -> np.ndarray:
        """The codes of a text; runs of separators count as one."""
        if self.table is None:
            self.table = np.array([OTHER if chr(p).isalpha() else SEPARATOR for p in range(0x110000)], dtype=np.int32)
            self.table[self.points] = np.arange(2, self.size)
        codes = self.table[_points(text)]
        gap = codes == SEPARATOR
        return codes[~(gap & np.r_[False, gap[:-1]])] if len(codes) else codes


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``codes``; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Model:
    """The learned languages, the alphabet, and the edges of their automata."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        self.documents = {lang: len(samples[lang]) for lang in self.langs}
        self.alphabet = Alphabet([t for lang in self.langs for t in samples[lang]])
        self.weights, self.edges, self.roots, states = [], [], [], 0
        for lang in self.langs:
            codes = self.alphabet.encode(" ".join(samples[lang])[:SAMPLE_CHARS])
            steps = suffix_automaton(codes.tolist())
            self.weights.append(math.log2(max(2, len(codes))))
            self.roots.append(states)
            found = [(states + s, c, states + to) for s, step in enumerate(steps) for c, to in step.items()]
            self.edges.append(np.array(found or np.empty((0, 3)), dtype=np.int32).reshape(-1, 3))
            states += len(steps) + 1  # the last has no edges: after a character that the sample lacks
        self.states = states
        self.width = min(self.alphabet.size, DENSE + 2)
        edges = np.concatenate(self.edges) if self.edges else np.empty((0, 3), np.int32)
        rare = edges[edges[:, 1] >= self.width].astype(np.int64)
        rare = rare[np.lexsort((rare[:, 1], rare[:, 0]))]
        self.rare_keys, self.rare_to = rare[:, 0] * self.alphabet.size + rare[:, 1], rare[:, 2]
        self.dead = np.array([*self.roots[1:], self.states], dtype=np.int64) - 1
        self.table = self.rare = None

    def walk_table(self) -> np.ndarray:
        """Entry (state, code) is four times the next state's row, plus the phrases that end before the code."""
        if self.table is None:
            width = self.width
            table = np.empty((self.states, width), dtype=np.int64)
            for root, dead, edges in zip(self.roots, self.dead, self.edges):
                edges = edges[edges[:, 1] < width]
                fresh = np.full(width, dead * width * 4 + 2, dtype=np.int64)
                mine = edges[edges[:, 0] == root]
                fresh[mine[:, 1]] = mine[:, 2].astype(np.int64) * width * 4 + 1
                table[root : dead + 1] = fresh
                table[edges[:, 0], edges[:, 1]] = edges[:, 2].astype(np.int64) * width * 4
            kind = np.int32 if 4 * self.states * width < 2**31 else np.int64
            self.table = table.astype(kind).ravel()
        return self.table

    def _rare(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the phrases that ended, for codes without a column; a row for each language."""
        size = self.alphabet.size

        def look(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys = states * size + codes
            at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
            return self.rare_to[at], self.rare_keys[at] == keys

        to, known = look(states)
        fresh, begins = look(np.repeat(np.array(self.roots, dtype=np.int64)[:, None], len(codes), axis=1))
        return np.where(known, to, np.where(begins, fresh, self.dead[:, None])), np.where(known, 0, np.where(begins, 1, 2))

    def _alone(self, codes: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Phrases that end in the rest of one document, by language."""
        table, width, size, ended = memoryview(self.walk_table()), self.width, self.alphabet.size, []
        listed = codes.tolist()
        if self.rare is None and codes.max(initial=0) >= width:
            self.rare = dict(zip(self.rare_keys.tolist(), self.rare_to.tolist()))
        for root, dead, state in zip(self.roots, self.dead.tolist(), states.tolist()):
            row, n = state * width, 0
            for c in listed:
                if c < width:
                    step = table[row + c]
                    n += step & 3
                    row = step >> 2
                elif (to := self.rare.get(row // width * size + c)) is not None:
                    row = to * width
                else:
                    to = self.rare.get(root * size + c)
                    n += 1 if to is not None else 2
                    row = (dead if to is None else to) * width
            ended.append(n)
        return np.array(ended, dtype=np.int64)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each encoded text (rows) for each language (columns)."""
        table, width, n_langs = self.walk_table(), self.width, len(self.langs)
        counts = np.zeros((len(texts), n_langs), dtype=np.int64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if not sizes.sum():
            return counts
        flat = np.concatenate(texts)
        order = np.argsort(-sizes, kind="stable")
        start, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
        steps = int(length[TOGETHER - 1]) if len(length) >= TOGETHER else 0
        active = np.searchsorted(-length, -np.arange(steps), side="left")  # texts longer than t
        # the first character begins a phrase
        state = np.repeat((self.dead * width).astype(table.dtype)[:, None], len(order), axis=1)
        ended = np.zeros((n_langs, len(order)), dtype=np.int64)
        some_rare = len(self.rare_keys) and bool((flat >= width).any())
        for t in range(steps):
            n = int(active[t])
            code = flat[start[:n] + t]
            rare = np.flatnonzero(code >= width) if some_rare else ()
            to = table[state[:, :n] + (np.minimum(code, width - 1) if len(rare) else code)]
            ends, to = to & 3, to >> 2
            if len(rare):
                states, over = self._rare(state[:, rare].astype(np.int64) // width, code[rare].astype(np.int64))
                to[:, rare], ends[:, rare] = states * width, over
            ended[:, :n] += ends
            state[:, :n] = to
        for k in np.flatnonzero(length > steps).tolist():
            ended[:, k] += self._alone(flat[start[k] + steps : start[k] + length[k]], state[:, k].astype(np.int64) // width)
        counts[order] = ended.T
        return counts

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, score, fewest phrases) of each text."""
        known = [k for k, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        out: list[tuple[str, float, int]] = [("und", 0.0, 0)] * len(texts)
        counts = self.phrases([self.alphabet.encode(texts[k]) for k in known])
        bits = counts * np.array(self.weights)
        for k, row, n in zip(known, bits, counts):
            best = int(np.argmin(row))
            share = 1.0 / float(np.exp2(np.maximum((row[best] - row) / self.weights[best], -60.0)).sum())
            out[k] = (self.langs[best], share, int(n[best]))
        return out


def slices(texts: list[tuple[int, str]]) -> list[str]:
    """A slice of every (hash, text), of one length but for shorter texts; the hash says where it begins."""
    room, length = SAMPLE_CHARS - len(texts) + 1, 0  # a space between any two
    for k, size in enumerate(sorted(len(t) for _, t in texts)):
        length = min(size, room // (len(texts) - k))
        if size > length:
            break
        room -= size
    starts = [at % (max(0, len(t) - length) + 1) for at, t in texts]
    return [t[start : start + length] for start, (_, t) in zip(starts, texts)]


def learn(rows: DataFrame) -> Model:
    """Fit on rows (doc_id, text, lang); the sample's bounds are those above."""
    known = rows.select("text", "lang").where("lang IS NOT NULL AND length(text) > 0").withColumn("hash", F.xxhash64("text"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n"))
    place = F.pmod("hash", F.lit(1 << 40)) / F.lit(float(1 << 40))
    at = F.xxhash64("text", F.lit(1))
    start = F.pmod(at, F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    some = known.join(F.broadcast(counts), "lang").where(place * F.col("n") < SAMPLE_DOCS)
    some = some.select("lang", "hash", at.alias("at"), F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text")).distinct()
    samples: dict[str, list[tuple[int, str]]] = {}
    for lang, _, at, text in sorted(map(tuple, some.toLocalIterator())):
        samples.setdefault(lang, []).append((at, text))
    return Model({lang: slices(texts) for lang, texts in samples.items()})


def identify(docs: DataFrame, model: Broadcast) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score, phrases."""
    short_batches(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = model.value.predict(batch.column("text").to_pylist())
        columns = [pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.float64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "phrases"])

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, lang_pred string, score double, phrases long")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose id's crc leaves 0, 1 or 3 by 4."""
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = spark.sparkContext.broadcast(learn(docs.where(~held_out)))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "phrases")
