"""Token ids in files of static range asymmetric numeral system (rANS) blocks.

One frequency table, counted over all documents and scaled to 2^20, serves every block. A block holds
whole documents of about a million ids: the ids are dealt to lanes in turn, each lane is a 64-bit rANS
coder, and all lanes step together, so that a step is a few vector operations. The lanes' 32-bit words
are interleaved in the order in which the decoder asks for them. Checkpoints keep the lanes' states and
the place among the words every 256 steps, so a block can be decoded from several places at once, and
blocks are independent of each other. Two checksums guard a block: of its words and of its ids.

Writing: documents are dealt and sorted by id (one shuffle of the text), encoded to ids, and staged in
that order in the shared folder; a partition's running count and the partitions' totals (one row each,
on the driver) give each document its place; then a map turns staged ids into block rows. Reading is a
map over the block rows. Nothing but the frequency table and the totals reaches the driver.

Defined results: a null or empty text has the end id alone. Null ids come first; rows that share an id
are ordered by a hash of their text and the text. Repeated rows are written each. An empty table gives
no rows. Other columns are ignored. A document longer than a block joins the block that it is found in.
"""

from __future__ import annotations

import codecs
import gc
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm.common import documents, drop_staged, kept, let_go, short_batches, staged
from brindle.session import checkpoint_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The id that ends each document.
END = 0
#: Ids after which a block is closed; lanes at most, and ids for each lane at least.
BLOCK, LANES, LEAST_PER_LANE = 1 << 20, 2048, 128
#: Steps between checkpoints.
CHECKPOINT = 256
SCALE_BITS = 20
#: Least state of a lane between steps.
LOW = 1 << 31
MAGIC = b"RANS0001"
#: Chunks of a generation that a worker remembers (about 100 MB): when the young one is full it becomes the
#: old one and the one before is forgotten; chunks found in the old one become young again. Longer ones are
#: not remembered. Chunks that the library encodes together.
CHUNKS, LONGEST_KEPT, TOGETHER = 500_000, 64, 4096
#: Texts that are encoded together, unless their bytes end the batch before.
ENCODED_ROWS = 8192
#: Pieces of a generation that a worker remembers, like chunks.
PIECES = 250_000
# Letters that have been letters in every version of Unicode an engine may know, and signs that never
# join letters (the apostrophe does).
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u021f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_PLAIN = re.compile(rf"[{_LETTERS}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+|\n")
# Bytes as a byte-level vocabulary writes them: those that print as themselves, the others as letters from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = sorted({*range(256)} - _PRINTED)
_WRITTEN = "".join(chr(b) if b in _PRINTED else chr(256 + _OTHERS.index(b)) for b in range(256))
# White space by Unicode, and the separators that only some engines count.
_SPACES = "\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_HEAD = struct.Struct("<8sQIIIIII")  # magic, ids, lanes, checkpoints, words, documents, crc of words, crc of ids


# --- the coder --------------------------------------------------------------------------------------


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE_BITS; every id that occurs keeps at least 1."""
    total, out = int(counts.sum()), np.zeros(len(counts), dtype=np.int64)
    seen = np.flatnonzero(counts)
    if not total:
        return out
    out[seen] = np.maximum(1, (counts[seen].astype(object) * (1 << SCALE_BITS) // total).astype(np.int64))
    rest = (1 << SCALE_BITS) - int(out.sum())
    order = seen[np.argsort(-out[seen], kind="stable")]
    if rest > 0:
        out[order[0]] += rest
    for k in order:
        if rest >= 0:
            break
        take = min(-rest, int(out[k]) - max(1, int(out[k]) // 2))
        out[k] -= take
        rest += take
    return out


class Table:
    """Frequencies, their running sum, and the id of each slot."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = frequencies.astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.uint64)
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.frequencies), dtype=np.uint32), self.frequencies.astype(np.int64))
        return self._slots

    def __getstate__(self):
        return self.frequencies

    def __setstate__(self, frequencies):
        self.__init__(frequencies.astype(np.int64))


_BITS, _LOW, _WORD = np.uint64(SCALE_BITS), np.uint64(LOW), np.uint64(32)
_MASK = np.uint64((1 << SCALE_BITS) - 1)


def encode_block(ids: np.ndarray, documents_: int, table: Table) -> bytes:
    """Header, checkpoints and words of a block of ids."""
    n = len(ids)
    lanes = max(1, min(LANES, n // LEAST_PER_LANE))
    steps = -(-n // lanes)
    frequency, before = table.frequencies[ids], table.before[ids]
    most = ((_LOW >> _BITS) << _WORD) * frequency
    state = np.full(lanes, LOW, dtype=np.uint64)
    chunks, checkpoints = [], []
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x = state[: b - a]
        full = x >= most[a:b]
        chunks.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> _WORD, x)
        f = frequency[a:b]
        quotient = x // f
        state[: b - a] = (quotient << _BITS) + (x - quotient * f) + before[a:b]
        if step % CHECKPOINT == 0:
            checkpoints.append((step, state.copy()))
    chunks.reverse()
    place = np.concatenate([[0], np.cumsum([len(c) for c in chunks])]).astype(np.int64) if chunks else np.zeros(1, np.int64)
    words = b"".join(c.tobytes() for c in chunks)
    marks = b"".join(struct.pack("<IQ", s, int(place[s])) + x.astype("<u8").tobytes() for s, x in reversed(checkpoints))
    head = _HEAD.pack(MAGIC, n, lanes, len(checkpoints), len(words) // 4, documents_, zlib.crc32(words), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + marks + words


def checkpoints(block: bytes) -> int:
    """How many places a block can be decoded from."""
    return _HEAD.unpack_from(block)[3]


def decode_block(block: bytes, table: Table, first: int = 0, upto: int | None = None) -> np.ndarray:
    """The ids between two checkpoints, by default of the whole block; damage raises ValueError."""
    magic, n, lanes, marks, size, _, crc_words, crc_ids = _HEAD.unpack_from(block)
    width = 12 + 8 * lanes
    at = _HEAD.size + marks * width
    if magic != MAGIC or len(block) != at + 4 * size or zlib.crc32(block[at:]) != crc_words:
        raise ValueError("damaged block of token ids")
    words = np.frombuffer(block, dtype="<u4", offset=at)
    upto = marks if upto is None else upto
    if first >= upto:
        return np.empty(0, dtype=np.uint32)
    step, place = struct.unpack_from("<IQ", block, _HEAD.size + first * width)
    state = np.frombuffer(block, dtype="<u8", count=lanes, offset=_HEAD.size + first * width + 12).astype(np.uint64)
    end = min(-(-n // lanes), upto * CHECKPOINT)
    out = np.empty(min(n, end * lanes) - step * lanes, dtype=np.uint32)
    base, slots = step * lanes, table.slots
    for s in range(step, end):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        x = state[: b - a]
        slot = x & _MASK
        ids = slots[slot]
        x = table.frequencies[ids] * (x >> _BITS) + slot - table.before[ids]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << _WORD) | words[place : place + len(low)]
        place += len(low)
        state[: b - a] = x
        out[a - base : b - base] = ids
    if first == 0 and upto == marks and zlib.crc32(out.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("decoded ids differ from those written")
    return out


# --- from documents to ids --------------------------------------------------------------------------


class Encoder:
    """The tokenizer of a vocabulary file, with a memory of chunks.

    The library splits a text by a pattern and merges each match on its own. Where no two white spaces are
    adjacent, a space always begins a match, so a text can be cut at its spaces, and chunks that are not
    remembered are encoded together, each behind a space: the tokens that begin with a space part them
    again. A chunk of plain letters, digits, signs and line breaks is cut into the pattern's matches here, and the
    library's model merges each, remembered as well: most new chunks are known words with another sign behind them, and
    the library's own cutting, which keeps track of places, takes twice as long as its merges. Texts with adjacent white spaces, or with the string of an added token, which the library takes
    out before it splits a text, are encoded by it as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        added = {k: t.content for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.whole = "|".join([f"[{_SPACES}]{{2}}", *map(re.escape, added.values())])
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0][0]  # as the vocabulary writes it
        self.spaced = np.zeros(self.size, dtype=bool)
        self.spaced[[k for t, k in self.tokenizer.get_vocab().items() if t[0] == space and k not in added]] = True
        setup = json.loads(self.tokenizer.to_str())
        cutter = setup["pre_tokenizer"] or {}
        self.cuts = setup["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the library gives them for the whole text."""
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[i:j] for i, j in zip([0, *ends[:-1]], ends)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; a null counts as empty.

        The batch's chunks are numbered, each number's ids looked up once, and all ids gathered at once.
        """
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole)
        parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        offsets, coded = parts.offsets.to_numpy().astype(np.int64), parts.values.dictionary_encode()
        firsts, index = offsets[:-1], coded.indices.to_numpy().astype(np.int64)
        behind = np.ones(len(index), dtype=bool)  # a space stands before the chunk
        behind[firsts] = False
        used = np.zeros(len(coded.dictionary), dtype=bool)
        used[index[behind]] = True
        ids = self._chunks(coded.dictionary.filter(pa.array(used)).to_pylist())
        heads = pc.if_else(whole, texts, parts.values.take(pa.array(firsts))).to_pylist()
        index = (np.cumsum(used) - 1)[index]
        index[firsts] = len(ids) + np.arange(len(firsts))
        ids += [x.tobytes() for x in self._library(heads)]
        found = pa.array(ids, pa.large_binary()).take(pa.array(index))
        ends = np.frombuffer(found.buffers()[1], np.int64, len(index) + 1) // 4
        flat = found.buffers()[2]
        return np.frombuffer(flat, "<u4", int(ends[-1])) if ends[-1] else np.empty(0, "<u4"), np.diff(ends[offsets])

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks, each behind a space."""
        if len(self.young) > CHUNKS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = [x for x in chunks if x not in young]
        young.update((x, old[x]) for x in missing if x in old)
        new = [x for x in missing if x not in old]
        whole = self._by_piece(new) if self.cuts else new
        for at in range(0, len(whole), TOGETHER):
            part = whole[at : at + TOGETHER]
            ids = self._library(["".join([f" {x}" for x in part])])[0]
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(self.spaced[ids])).tolist()
            young.update((x, raw[i:j]) for x, i, j in zip(part, cuts, [*cuts[1:], len(raw)], strict=True))
        out = list(map(young.__getitem__, chunks))
        for x in new:
            if len(x) > LONGEST_KEPT:
                young.pop(x)
        return out

    def _by_piece(self, chunks: list[str]) -> list[str]:
        """Remember the ids of chunks that are plain, each behind a space; the others are returned."""
        if len(self.pieces) > PIECES:
            self.pieces, self.old_pieces = {}, self.pieces
        young, known, old, merge, cut, spell = self.young, self.pieces, self.old_pieces, self.model.tokenize, _PLAIN.findall, codecs.charmap_decode

        def ids_of(piece: str) -> bytes:
            return array("I", [t.id for t in merge(spell(piece.encode(), "strict", _WRITTEN)[0])]).tobytes()

        rest = []
        for x in chunks:
            parts = cut(x)
            if len(x) > LONGEST_KEPT or not parts or parts[0] == "\n" or len("".join(parts)) != len(x):
                rest.append(x)
            elif len(parts) == 1:
                young[x] = ids_of(f" {x}")
            else:
                first = parts[0]  # a chunk itself
                ids = young.get(first)
                if ids is None:
                    ids = young[first] = self.old.get(first) or ids_of(f" {first}")
                row = [ids]
                for p in parts[1:]:
                    ids = known.get(p)
                    if ids is None:
                        ids = known[p] = old.get(p) or ids_of(p)
                    row.append(ids)
                young[x] = b"".join(row)
        return rest

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))


def _ids(docs: DataFrame, path: str, kind: str) -> DataFrame:
    """(part, before, doc_id, n, ids): each partition's documents in order, and the ids before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, sizes = encoder(path).encode_column(batch.column("text"))
            raw = np.insert(ids, np.cumsum(sizes), END).astype(kind)
            sizes = sizes + 1
            ends = np.cumsum(sizes)
            starts = before + ends - sizes
            before += int(sizes.sum())
            cuts = np.concatenate([[0], ends * raw.dtype.itemsize]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
            arrays = [pa.array(np.full(len(sizes), part), pa.int32()), pa.array(starts, pa.int64()), batch.column("doc_id"), pa.array(sizes, pa.int64()), binary]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "before", "doc_id", "n", "ids"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "tie", "text"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions(*keys)
    return dealt.select("doc_id", "text").mapInArrow(run, "part int, before long, doc_id long, n long, ids binary")


def count_ids(rows: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id occurs; a partition sends at most one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=kind)
            total += np.bincount(flat, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["id", "n"])

    counts = np.zeros(size, dtype=np.int64)
    for r in rows.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the files of shuffles that no frame refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """Write the ids of all documents: ``path``/blocks and ``path``/table."""
    spark = docs.sparkSession
    size = encoder(vocabulary).size
    kind = "<u2" if size <= 1 << 16 else "<u4"
    short_batches(spark, ENCODED_ROWS)  # chunks that texts share are looked up once a batch
    rows = staged(_ids(docs, vocabulary, kind), "token-ids")
    short_batches(spark)
    release_shuffles(spark)
    table = Table(scaled(count_ids(rows, size, kind)))
    totals = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, at = {}, 0
    for part, n in totals:
        starts[part] = at
        at += n
    shared = spark.sparkContext.broadcast((table, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, offsets = shared.value
        held: list[tuple[int, int, bytes]] = []  # start, document, ids
        size = 0
        upto, stretch = None, ""  # where the last document ends, and the name of what has no gap
        for batch in batches:
            for part, before, doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "doc_id", "n", "ids"))):
                start = offsets[part] + before
                if held and (size >= BLOCK or start != upto):
                    yield _block(held, mine, kind, stretch)
                    held, size = [], 0
                if start != upto:
                    stretch = f"{start:018}"
                held.append((start, doc, ids))
                size, upto = size + n, start + n
        if held:
            yield _block(held, mine, kind, stretch)

    fields = "stretch string, start long, n_ids long, n_docs int, doc_ids array<long>, sizes array<long>, block binary"
    # splits are read in an order of Spark's choice, so each stretch of blocks without a gap gets a folder that its start
    # names: files in the order of their paths hold ascending ids
    blocks = rows.mapInArrow(run, fields).sortWithinPartitions("stretch", "start")
    blocks.write.option("compression", "none").partitionBy("stretch").parquet(f"{path}/blocks")
    seen = np.flatnonzero(table.frequencies)
    frequencies = pa.table({"id": pa.array(seen, pa.int32()), "frequency": pa.array(table.frequencies[seen].astype(np.int64)), "size": pa.array(np.full(len(seen), size), pa.int32())})
    spark.createDataFrame(frequencies.to_pandas(), "id int, frequency long, size int").coalesce(1).write.parquet(f"{path}/table")
    drop_staged(spark, rows)


def _block(held: list[tuple[int, int, bytes]], table: Table, kind: str, stretch: str) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(x for _, _, x in held), dtype=kind).astype(np.int64)
    width = np.dtype(kind).itemsize
    values = [[stretch], [held[0][0]], [len(ids)], [len(held)], [[d for _, d, _ in held]], [[len(x) // width for _, _, x in held]], [encode_block(ids, len(held), table)]]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["stretch", "start", "n_ids", "n_docs", "doc_ids", "sizes", "block"])


def read_table(spark: SparkSession, path: str) -> Table:
    rows = spark.read.parquet(f"{path}/table").collect()
    frequencies = np.zeros(rows[0]["size"] if rows else 1, dtype=np.int64)
    for r in rows:
        frequencies[r.id] = r.frequency
    return Table(frequencies)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (uint32, little-endian) and their crc32, from the files.

    A batch holds few blocks, since a block is about a million ids.
    """
    short_batches(spark)
    shared = spark.sparkContext.broadcast(read_table(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, sizes, block in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_ids", "sizes", "block"))):
                raw = decode_block(block, shared.value).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                rows = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes)]
                arrays = [pa.array(docs, pa.int64()), pa.array(start + ends - np.array(sizes), pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([zlib.crc32(x) for x in rows], pa.int64())], ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    blocks = spark.read.schema("start long, doc_ids array<long>, sizes array<long>, block binary").parquet(f"{path}/blocks")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents, written to files and read from them."""
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
