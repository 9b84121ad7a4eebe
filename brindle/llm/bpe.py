"""Byte-level BPE encoding and decoding in DuckDB, by recursive queries inside each partition.

Encoding: the pattern splits a text into words, and the distinct words of a batch become rows (word,
position, id), one for each byte. A recursive query joins rows and their neighbours with the merge table,
takes each word's leftmost pair of least rank and contracts it, until no pair of a word can merge; a word
that has settled leaves the working set. The merge table has every way to write a token as two tokens, which is
what "the pair's bytes have a rank" means. A word that is itself a token gets its id directly, as the
library does.

Decoding: ids become rows (document, position, id), join the vocabulary, and an ordered aggregation
puts the bytes of a document together.

A word contracts one pair a round, so the rows of all its rounds grow with the square of its length. One
query takes words up to ``QUERY_ROWS`` such rows, which bounds its memory whatever the words are; words
of more than ``LONGEST_RECURSIVE`` bytes are contracted with a heap instead, with the same result.

Each worker has its own in-memory database with one thread and a bounded memory; nothing is shuffled or
written, so a lost executor repeats its batches alone. Defined results: a null or empty text has no ids
and the hashes of the empty string. Repeated rows give repeated rows; an empty table gives no rows;
other columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import documents, kept, map_batches, short_batches, with_fields
from brindle.llm.pieces import PieceEncoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONGEST_RECURSIVE = 128
#: Rows of all rounds of one recursive query (48 bytes each at most), and tokens of one decoding query.
QUERY_ROWS, QUERY_TOKENS = 2_000_000, 500_000
MEMORY = "250MB"

ENCODE = """
WITH RECURSIVE run(round, word, pos, id, next_id) AS (
  SELECT 0, word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos) FROM start_rows
  UNION ALL
  SELECT round, word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos)
  FROM (
    SELECT r.round + 1 AS round, r.word, r.pos - (r.pos > b.pair & 4294967295)::INTEGER AS pos,
           CASE WHEN r.pos = b.pair & 4294967295 THEN (b.pair >> 32)::INTEGER ELSE r.id END AS id
    FROM run r JOIN (
      SELECT q.word, min((m.merged::BIGINT << 32) | q.pos) AS pair
      FROM run q JOIN merges m ON m.left_id = q.id AND m.right_id = q.next_id GROUP BY q.word
    ) b USING (word)
    WHERE r.pos <> (b.pair & 4294967295) + 1
  )
)
SELECT word, id FROM run JOIN (SELECT word, max(round) AS round FROM run GROUP BY word) USING (word, round) ORDER BY word, pos
"""

DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS text
FROM token_rows JOIN vocabulary USING (id) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """A vocabulary in a database of its own."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        splits = [(self.ranks[t[:k]], self.ranks[t[k:]], rank) for t, rank in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, merged = (pa.array(x, pa.int32()) for x in zip(*splits))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.db.register("merge_rows", pa.table({"left_id": left, "right_id": right, "merged": merged}))
        self.db.execute("CREATE TABLE merges AS FROM merge_rows")
        # bytes as the code points below 256, since only text can be aggregated to one string
        pieces = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in self.ranks])})
        self.db.register("piece_rows", pieces)
        self.db.execute("CREATE TABLE vocabulary AS FROM piece_rows")
        self.encoder = PieceEncoder(public_tokenizers.PATTERN, self.encode_words)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[bytes | None] = [None] * len(raw)
        waiting: list[int] = []
        size = 0
        for k, b in enumerate(raw):
            if (rank := self.ranks.get(b)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(b) > LONGEST_RECURSIVE:
                out[k] = self.contract(b)
            else:
                rows = len(b) * (len(b) + 1) // 2
                if waiting and size + rows > QUERY_ROWS:
                    self._recurse(raw, waiting, out)
                    waiting, size = [], 0
                waiting.append(k)
                size += rows
        if waiting:
            self._recurse(raw, waiting, out)
        return out

    def _recurse(self, raw: list[bytes], which: list[int], out: list) -> None:
        data = np.frombuffer(b"".join([raw[k] for k in which]), dtype=np.uint8)
        sizes = np.array([len(raw[k]) for k in which])
        word = np.repeat(np.arange(len(which), dtype=np.int32), sizes)
        pos = (np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self.db.register("start_rows", pa.table({"word": word, "pos": pos, "id": self.bytes[data]}))
        found = self.db.execute(ENCODE).fetchnumpy()
        self.db.unregister("start_rows")
        cuts = np.searchsorted(np.asarray(found["word"]), np.arange(len(which) + 1))
        ids = np.asarray(found["id"]).astype("<u4").tobytes()
        for k, a, b in zip(which, cuts[:-1].tolist(), cuts[1:].tolist()):
            out[k] = ids[4 * a : 4 * b]

    def contract(self, raw: bytes) -> bytes:
        """The same fixpoint for one long word: a heap of (rank, position) over a linked list."""
        n = len(raw)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 if it was merged away
        before = list(range(-1, n - 1))

        def rank(i: int):
            j = end[i]
            return self.ranks.get(raw[i : end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, upto = heapq.heappop(heap)
            if not end[i] or end[i] >= n or end[end[i]] != upto or rank(i) != r:
                continue
            j = end[i]
            end[i], end[j] = end[j], 0
            if end[i] < n:
                before[end[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[end[k]]))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encoder(texts)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids."""
        out = [b""] * len(ids)
        group: list[int] = []
        size = 0
        for k, row in enumerate(ids):
            group.append(k)
            size += len(row) // 4
            if size >= QUERY_TOKENS:
                self._join(ids, group, out)
                group, size = [], 0
        if group:
            self._join(ids, group, out)
        return out

    def _join(self, ids: list[bytes], group: list[int], out: list[bytes]) -> None:
        sizes = np.array([len(ids[k]) // 4 for k in group])
        flat = np.frombuffer(b"".join([ids[k] for k in group]), dtype="<u4").astype(np.int32)
        if not len(flat):
            return
        doc = np.repeat(np.array(group, dtype=np.int32), sizes)
        self.db.register("token_rows", pa.table({"doc": doc, "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        for k, text in self.db.execute(DECODE).fetchall():
            out[k] = text.encode("latin-1")
        self.db.unregister("token_rows")


def codec(path: str) -> Codec:
    return kept(("codec", path), lambda: Codec(path))


def encode(docs: DataFrame, columns: list[str], path: str = RANKS) -> DataFrame:
    """The named columns, and ``ids`` of ``text`` as little-endian unsigned 32-bit integers."""
    short_batches(docs.sparkSession)
    rows = docs.select(*columns, *([] if "text" in columns else ["text"]))
    schema = with_fields(docs.select(*columns), "n_tokens long, ids binary")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(path).encode([t or "" for t in batch.column("text").to_pylist()])
        arrays = [*(batch.column(c) for c in columns), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, [*columns, "n_tokens", "ids"])

    return map_batches(rows, step, schema, keeps=True)


def decode(rows: DataFrame, columns: list[str], path: str = RANKS) -> DataFrame:
    """The named columns, and ``decoded``: the bytes of ``ids``. Null ids decode to nothing."""
    short_batches(rows.sparkSession)
    given = rows.select(*columns, *([] if "ids" in columns else ["ids"]))
    schema = with_fields(rows.select(*columns), "decoded binary")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = codec(path).decode([x or b"" for x in batch.column("ids").to_pylist()])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.binary())], [*columns, "decoded"])

    return map_batches(given, step, schema, keeps=True)


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of all documents, as digests.

    Both directions run in one pass over a batch, so that neither ids nor bytes leave the worker.
    """
    short_batches(spark)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        mine = codec(RANKS)
        ids = mine.encode([t or "" for t in batch.column("text").to_pylist()])
        decoded = mine.decode(ids)
        digests = [pa.array([hashlib.sha256(x).hexdigest() for x in rows]) for rows in (ids, decoded)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(documents(spark, sf_dir).select("doc_id", "text"), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True)
