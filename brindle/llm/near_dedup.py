"""Near-duplicate detection with ProbMinHash.

A text's distinct five-word shingles, weighted by 1 + log of their counts, are elements whose arrivals form Poisson
processes of rates equal to the weights. Each arrival falls on one of 252 registers and the earliest
keeps it; an element stops as soon as its next arrival is later than every register. The registers of
two texts agree with their probability Jaccard; those drawn with weights of 1 agree with the plain
Jaccard. Bands of seven registers of either kind give candidates, which are verified on the shingles
themselves: a link needs a probability Jaccard (over weights) or a plain Jaccard (over the sets) of at
least 0.8. A text without a repeated shingle has one signature for both.

Scale: equal texts are one node (partial minimum by digest before the shuffle), so a group of exact
copies of any size is one row afterwards. The text itself is never shuffled: only texts that share a
bucket are read again, found by a bitmap of their ids, and give their shingles and a sketch of 1024
registers in two bits each, weighted and plain. A band bucket is never expanded into all its pairs: its
members are compared with one leader, the text that shares most with others, which links a family of
near copies in linear work; then members outside a bucket's largest component are held against those of
other components, sketch by sketch, and only pairs whose sketches are near go on to the shingles. Pairs
within a component are not needed for classes, and no pair that may join two is left out. Buckets, links
and components stay in DataFrames; each step is written to the shared folder, so a lost executor repeats
one step.

Defined results: a null text equals the empty text; texts without a word have no shingle and are grouped
by equality alone; texts of one to four words have one shingle, the whole text. The class of a document
is the least id among its class. Repeated rows are in one class; null ids keep their rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brindle.llm.common import documents, drop_staged, map_batches, short_batches, staged, unused

SHINGLE = 5
SIMILAR = 0.8
#: Bands, registers in a band. At a Jaccard of 0.8 a pair is missed with a chance of 2 in 10,000.
BANDS, ROWS = 36, 7
REGISTERS = BANDS * ROWS
#: Registers of the sketch, the longs that hold two bits of each, and the most registers that may differ:
#: at 0.8 the mean is 153.6 and the deviation 11.4, so a pair at the very bound is missed with a chance of
#: 2 in 10,000, as by the bands; of pairs at 0.72 one in 20 passes.
SKETCHED, LONGS, MOST_APART = 1024, 32, 195
BITS = [f"bits{k}" for k in range(LONGS)]
#: The sketch with weights of 1; null where it is the same.
PLAIN = [f"plain{k}" for k in range(LONGS)]
SKETCHES = (*BITS, *PLAIN)

#: Draws at once of all elements of a chunk, and places of the bitmap of ids (8 MB when all are in use).
DRAWS, PLACES = 1 << 15, 1 << 26

# Multipliers of the polynomial and of the finaliser (splitmix64).
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown when a longer buffer comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self.up, self.down


_powers = _Powers()
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at once; longer texts go alone.
_CHUNK = 4 << 20


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    up, down = _powers.upto(len(data) + 1)
    gap = _GAP[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)]) + 1
    return hashes, np.diff(np.searchsorted(start, bounds))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles, ordered by text and hash."""
    hashes, counts = words(texts)
    n = len(hashes)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(n) - np.repeat(first, counts)
    left = np.repeat(counts, counts) - place  # words from here to the end of the text
    code = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[: max(0, n - k)] = hashes[k:]
        code = np.where(left > k, mix(code + shifted + np.uint64(k + 1)), code)
    whole = (left >= SHINGLE) | (place == 0)
    owner, code = owner[whole], code[whole]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        code[a:b].sort()
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], code[at], np.diff(np.append(at, len(code)))


def weights(counts: np.ndarray) -> np.ndarray:
    """The weight of a shingle that occurs so often: a repeated line counts more, but not in proportion."""
    return 1 + np.log(counts)


def signatures(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The element that holds each register, for ``n`` texts. Texts without elements hold 0.

    Few elements draw many arrivals in a turn; how many does not change the result.
    """
    best = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, dtype=np.uint64)
    latest = np.full(n, np.inf)
    time, rate, done = np.zeros(len(code)), 1.0 / weight, 0
    while len(code):
        many = max(1, min(256, DRAWS // len(code)))
        turns = np.arange(done + 1, done + 1 + many, dtype=np.uint64) * np.uint64(_BASE)
        done += many
        draw = mix(code[:, None] + turns[None, :])
        times = time[:, None] - np.cumsum(np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52), axis=1) * rate[:, None]
        early = times < latest[owner][:, None]
        element = np.nonzero(early)[0]
        slot = owner[element] * registers + (mix(draw[early]) % np.uint64(registers)).astype(np.int64)
        at = times[early]
        np.minimum.at(best, slot, at)
        won = best[slot] == at
        held[slot[won]] = code[element[won]]
        live = np.unique(owner)
        latest[live] = best.reshape(n, registers)[live].max(axis=1)
        still = times[:, -1] < latest[owner]
        owner, code, rate, time = owner[still], code[still], rate[still], times[still, -1]
    return held.reshape(n, registers)


def bands(held: np.ndarray) -> np.ndarray:
    """Keys of the bands, distinct between bands."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(_BASE)
    parts = held.reshape(len(held), BANDS, ROWS)
    for k in range(ROWS):
        keys = mix(keys + parts[:, :, k])
    return keys.astype(np.int64)


def sketches(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Longs with two bits from each of the sketch's own registers."""
    part = (mix(signatures(owner, code, weight, n, SKETCHED)) >> np.uint64(17)).astype(np.uint8) & 3
    packed = part[:, ::4] | part[:, 1::4] << 2 | part[:, 2::4] << 4 | part[:, 3::4] << 6
    return packed.copy().view(np.int64)


def _chunks(texts: list[bytes]):
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > _CHUNK:
            yield at, k
            at, size = k, 0
        size += len(t)
    yield at, len(texts)


def _raw(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


def node_column(text: str = "text"):
    """The same digest as a column expression."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)), 1, 16)


def repeating(owner: np.ndarray, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with repeated shingles, and the elements (numbered by these texts) of all of them."""
    texts = np.unique(owner[count > 1])
    mine = np.isin(owner, texts)
    return texts, np.searchsorted(texts, owner[mine]), code[mine]


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, the digest of the text and its band keys, of each row."""
    short_batches(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = _raw(batch.column("text"))
        keys: list[list[int]] = []
        for a, b in _chunks(texts):
            owner, code, count = shingles(texts[a:b])
            some = np.bincount(owner, minlength=b - a) > 0
            of = [k if any_ else [] for k, any_ in zip(bands(signatures(owner, code, weights(count), b - a)).tolist(), some)]
            again, its, codes = repeating(owner, code, count)
            for k, more in zip(again.tolist(), bands(signatures(its, codes, np.ones(len(codes)), len(again))).tolist()):
                of[k] = list(dict.fromkeys(of[k] + more))
            keys += of
        arrays = [batch.column("doc_id"), pa.array([digest(t) for t in texts], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "node", "keys"])

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, node binary, keys array<long>")


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """Probability Jaccard over the weights, and Jaccard over the sets; hashes ascend."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    common = int(same.sum())
    plain = common / (len(a) + len(b) - common)
    # sum over common d of 1 / sum over all d' of max(A(d')/A(d), B(d')/B(d)); the inner sum needs only
    # the order of the ratios B/A, so prefix sums answer it
    wa, wb = weights(wa), weights(wb)
    x, y = wa, np.where(same, wb[at], 0.0)
    only_b = max(0.0, float(wb.sum() - y.sum()))
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    below = np.cumsum(x)
    above = float(y.sum()) - np.cumsum(y) + only_b
    upto = np.searchsorted(ratio, ratio, side="right") - 1
    inside = y > 0
    parts = below[upto] / x + above[upto] / np.where(inside, y, 1)
    return float((1.0 / parts[inside]).sum()), plain


def _judge(batch: pa.RecordBatch) -> pa.RecordBatch:
    pick = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in batch.column(name).to_pylist()]
    sides = []
    for x in "ab":
        codes = pick(f"codes_{x}", np.uint64)
        sides += [codes, [n if len(n) else np.ones(len(c), np.int32) for c, n in zip(codes, pick(f"counts_{x}", np.int32))]]
    found = [similarity(*row) for row in zip(*sides)]
    arrays = [batch.column("a"), batch.column("b"), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))]
    return pa.RecordBatch.from_arrays(arrays, ["a", "b", "probability_jaccard", "jaccard"])


def verified(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are similar, with both measures."""
    side = lambda x: contents.select(F.col("node").alias(x), F.col("codes").alias(f"codes_{x}"), F.col("counts").alias(f"counts_{x}"))
    rows = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    judged = map_batches(rows.select("a", "b", "codes_a", "counts_a", "codes_b", "counts_b"), _judge, "a binary, b binary, probability_jaccard double, jaccard double")
    return judged.where((F.col("probability_jaccard") >= SIMILAR) | (F.col("jaccard") >= SIMILAR))


def _slot(doc_id: str):
    return F.pmod(F.xxhash64(doc_id), F.lit(PLACES))


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """One bit for each place that an id of ``wanted`` (least) falls on: of a fixed size, however many there are."""
    bits = wanted.select(_slot("least").alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    rows = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(PLACES // 64, dtype=np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def contents_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingles and sketches of the wanted nodes (node, least): each read from one row, the one with the least id.

    ``counts`` is empty where every shingle occurs once; the plain sketch is null there.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot = batch.column("slot").to_numpy()
        batch = batch.filter(pa.array((shared.value[slot >> 6] >> (slot & 63)) & 1 == 1))
        texts = _raw(batch.column("text"))
        codes, counts, bits, plain = [], [], [], []
        for a, b in _chunks(texts):
            owner, code, count = shingles(texts[a:b])
            cuts = np.searchsorted(owner, np.arange(b - a + 1)).tolist()
            codes += [code[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
            counts += [count[i:j].astype(np.int32).tobytes() if (count[i:j] > 1).any() else b"" for i, j in zip(cuts[:-1], cuts[1:])]
            bits += sketches(owner, code, weights(count), b - a).tolist()
            again, its, other = repeating(owner, code, count)
            rows: list = [[None] * LONGS] * (b - a)
            for k, sketch in zip(again.tolist(), sketches(its, other, np.ones(len(other)), len(again)).tolist()):
                rows[k] = sketch
            plain += rows
        arrays = [batch.column("doc_id"), pa.array([digest(t) for t in texts], pa.binary()), pa.array(codes, pa.binary()), pa.array(counts, pa.binary())]
        arrays += [pa.array([b[k] for b in x], pa.int64()) for x in (bits, plain) for k in range(LONGS)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "node", "codes", "counts", *SKETCHES])

    schema = f"doc_id long, node binary, codes binary, counts binary, {', '.join(f'{b} long' for b in SKETCHES)}"
    found = map_batches(docs.select("doc_id", "text", _slot("doc_id").alias("slot")), step, schema)
    asked = wanted.select("node", F.col("least").alias("from"))
    return found.join(asked, "node").where(F.col("doc_id").eqNullSafe(F.col("from"))).drop("doc_id", "from").dropDuplicates(["node"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of the links (a, b): the least node of their component.

    Least labels spread along the links and then jump to the label of the label, until none changes;
    stars, which leaders make, settle in two rounds.
    """
    edges = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dedup-edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "dedup-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = staged(moved.join(jump, "label").select("node", F.least("label", "further").alias("label"), (F.least("label", "further") != F.col("old")).alias("changed")), "dedup-labels")
        drop_staged(labels.sparkSession, labels)
        labels = new
        if labels.where("changed").isEmpty():
            drop_staged(labels.sparkSession, edges)
            return labels.select("node", "label")


def _labelled(inside: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with the component that their node is in so far."""
    if labels is None:
        return inside.withColumn("label", F.col("node"))
    return inside.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(placed: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with the bucket's largest one."""
    groups = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = groups.groupBy("key").agg(F.count("*").alias("groups"), F.max_by("label", F.struct("n", "label")).alias("largest"))
    return placed.join(staged(largest.where("groups > 1").drop("groups"), "dedup-largest"), "key")


def _near(a: str, b: str):
    """Whether two sketches, weighted or plain, are near enough for a similarity that counts: few registers may differ."""
    apart = []
    for one in (lambda k, x: f"bits{k}_{x}", lambda k, x: f"coalesce(plain{k}_{x}, bits{k}_{x})"):
        differ = []
        for k in range(LONGS):
            pairs = f"({one(k, a)} ^ {one(k, b)})"
            differ.append(F.expr(f"bit_count(({pairs} | shiftrightunsigned({pairs}, 1)) & {0x5555555555555555}L)"))
        apart.append(sum(differ))
    return (apart[0] <= MOST_APART) | (apart[1] <= MOST_APART)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sketched(sketch: DataFrame, x: str) -> DataFrame:
    return sketch.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in SKETCHES])


def linked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """All links that join classes, for nodes (node, least, keys)."""
    spark = docs.sparkSession
    held: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        held.append(staged(df, f"dedup-{name}"))
        return held[-1]

    # only keys and nodes are shuffled by bucket; sketches follow for the few members of shared buckets
    members = nodes.select("node", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keep(members.join(keep(shared, "buckets"), "key"), "met")
    # a text in the middle of a family shares more and larger buckets than those around it
    mass = met.groupBy("node").agg(F.sum("n").alias("mass"))
    candidates = keep(nodes.select("node", "least").join(mass, "node"), "candidates")
    inside = keep(met.select("key", "node").join(candidates.select("node", "mass"), "node"), "members")
    contents = keep(contents_of(docs, candidates), "contents")
    sketch = contents.select("node", *SKETCHES)

    # every member meets its bucket's leader
    leaders = inside.groupBy("key").agg(F.max(F.struct("mass", "node")).alias("l")).select("key", F.col("l.node").alias("a"))
    meeting = _ordered(inside.select("key", F.col("node").alias("b")).join(leaders, "key").where("a != b"))
    both = meeting.join(_sketched(sketch, "b"), "b").join(_sketched(sketch, "a"), "a")
    judged = keep(both.where(_near("a", "b")).select("a", "b"), "pairs")
    first = keep(verified(judged, contents), "links")
    labels = components(first)

    # where a bucket still holds several components, those outside the largest meet the others
    opened = keep(_open(_labelled(inside.select("key", "node"), labels)).join(sketch, "node"), "open")
    side = lambda df, x: df.select("key", F.col("node").alias(x), F.col("label").alias(f"label_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in SKETCHES])
    crossing = side(opened.where("label != largest"), "a").join(side(opened, "b"), "key").where((F.col("label_a") != F.col("label_b")) & _near("a", "b"))
    others = keep(_ordered(crossing).join(judged, ["a", "b"], "left_anti"), "pairs")
    links = staged(first.unionByName(verified(others, contents)), "dedup-links")
    for df in (*held, labels):
        drop_staged(spark, df)
    return links


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, label and class_id of every row: label is the least digest of the class, class_id its least id."""
    spark = docs.sparkSession
    rows = staged(signed(docs), "dedup-signed")
    nodes = staged(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.any_value("keys").alias("keys")), "dedup-nodes")
    links = linked(docs, nodes)
    labels = components(links)
    named = nodes.select("node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    class_ids = named.groupBy("label").agg(F.min("least").alias("class_id"))
    by_node = staged(named.join(class_ids, "label").select("node", "label", "class_id"), "dedup-classes")
    for df in (nodes, links, labels):
        drop_staged(spark, df)
    return rows.select("doc_id", "node").join(by_node, "node").select("doc_id", "node", "label", "class_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: a row with the class's least id.

    Rows join their class by (id, digest), which no group of copies can make hot, and of rows alike in
    both one stays. A class with that id on different texts keeps the text whose digest comes first; a class
    of null ids alone keeps a row with a null id.
    """
    id_, digest_, copy_, node_ = unused(docs, "class", "digest", "copy", "node")
    found = classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = found.groupBy("label").agg(F.min("node").alias(node_), F.any_value("class_id").alias(id_)).drop("label")
    rows = docs.withColumn(digest_, node_column())
    same = rows.join(first, (F.col(digest_) == F.col(node_)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
    alike = Window.partitionBy(digest_, "doc_id").orderBy(F.lit(0))
    return same.withColumn(copy_, F.row_number().over(alike)).where(F.col(copy_) == 1).drop(digest_, copy_)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of all documents."""
    return classes(documents(spark, sf_dir)).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
