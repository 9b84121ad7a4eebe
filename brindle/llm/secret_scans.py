"""Secret scans through a trigram inverted index.

Each rule is a regular expression. Its syntax tree gives a Boolean query over trigrams that every
match must contain: AND over the parts of a sequence, OR over alternatives. A block of documents (one
Arrow batch, bounded in rows and bytes) is indexed once: its postings map a trigram to the sorted
documents that hold it. The query of a rule is answered by intersecting and uniting postings; only
the documents found are verified with the expression itself. Rules without a mandatory trigram, such
as a run of hexadecimal digits, verify every document.

Postings hold only the trigrams that the rules ask for. No shuffle: blocks are independent, so a hot
source or group of copies costs what its rows cost, and a lost executor repeats its blocks alone.

Defined results: a null or empty text has no spans (count 0, the hash of the empty string). Offsets
are code points. Repeated rows give repeated rows; an empty table gives no rows; other columns are
ignored. A text of any length is scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import documents, kept, map_batches, short_batches

try:
    from re import _constants as ops, _parser as parser
except ImportError:  # Python before 3.11
    import sre_constants as ops
    import sre_parse as parser

#: Strings of a part that is known exactly; beyond this it counts as unknown.
MOST_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and a least length of one of its groups."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)


# The base rules first, in the order that breaks ties; then the rules that this method adds.
BASE = [
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 0, 24),
]
ADDED = [
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]{20,}"),
]
RULES = BASE + ADDED


# --- from an expression to a Boolean trigram query -------------------------------------------------
# A query is True (no condition), a 3-byte string, ("and", (...)) or ("or", (...)).


def both(a, b):
    if a is True or b is True:
        return b if a is True else a
    return a if a == b else ("and", (a, b))


def either(queries):
    queries = list(dict.fromkeys(queries))
    if not queries or any(q is True for q in queries):
        return True
    return queries[0] if len(queries) == 1 else ("or", tuple(queries))


def trigrams_of(strings: set[str]):
    """What holds for a text that contains at least one of the strings."""
    parts = []
    for s in sorted(strings):
        raw = s.encode()
        grams = [raw[i : i + 3] for i in range(len(raw) - 2)]
        parts.append(reduce(both, grams, True))
    return either(parts)


def derive(pattern: str, flags: int = 0):
    """The trigram query of an expression, over lower-cased ASCII: every match satisfies it."""
    tree = parser.parse(pattern, flags)
    return _sequence(tree)


def _strings(node):
    """The lower-cased strings that a node can match, or None if they are too many or unknown."""
    op, arg = node
    if op is ops.LITERAL:
        return {_lower(chr(arg))}
    if op is ops.IN:
        found = set()
        for kind, value in arg:
            if kind is ops.LITERAL:
                found.add(_lower(chr(value)))
            elif kind is ops.RANGE and value[1] - value[0] < 16:
                found |= {_lower(chr(c)) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 16 else None
    if op is ops.SUBPATTERN:
        return _all_strings(arg[-1])
    if op is ops.BRANCH:
        found = set()
        for branch in arg[1]:
            part = _all_strings(branch)
            if part is None:
                return None
            found |= part
        return found if len(found) <= MOST_EXACT else None
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        low, high, body = arg
        part = _all_strings(body)
        if part is None or high is ops.MAXREPEAT or high > 3:
            return None
        found = set()
        for n in range(low, high + 1):
            found |= reduce(lambda a, b: {x + y for x in a for y in b}, [part] * n, {""})
            if len(found) > MOST_EXACT:
                return None
        return found
    if op is ops.AT:
        return {""}
    return None


def _all_strings(nodes):
    found = {""}
    for node in nodes:
        part = _strings(node)
        if part is None or len(found) * len(part) > MOST_EXACT:
            return None
        found = {a + b for a in found for b in part}
    return found


def _sequence(nodes):
    """AND over the exact runs of a sequence and the queries of its other parts."""
    query, run = True, {""}
    for node in nodes:
        part = _strings(node)
        if part is not None and len(run) * len(part) <= MOST_EXACT:
            run = {a + b for a in run for b in part}
            continue
        query = both(query, trigrams_of(run))
        if part is not None:
            run = part
            continue
        run = {""}
        query = both(query, _inner(node))
    return both(query, trigrams_of(run))


def _inner(node):
    op, arg = node
    if op is ops.SUBPATTERN:
        return _sequence(arg[-1])
    if op is ops.BRANCH:
        return either([_sequence(b) for b in arg[1]])
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[0] >= 1:
        return _sequence(arg[2])
    return True


def _lower(c: str) -> str:
    return c.lower() if c.isascii() else c


# --- the index of a block ---------------------------------------------------------------------------


def codes_of(query) -> set[int]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {int.from_bytes(query, "big")}
    return set().union(*map(codes_of, query[1]))


#: Lower-case forms of the ASCII capitals; other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


@dataclass
class BlockIndex:
    """Postings of a block: for each wanted trigram, the sorted rows that contain it."""

    rows: int
    postings: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def build(cls, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> BlockIndex:
        """``data`` is the UTF-8 of all rows, cut at ``offsets``; ``wanted`` flags 2^24 trigrams."""
        index = cls(len(offsets) - 1)
        if len(data) < 3:
            return index
        low = FOLD[data]
        code = low[:-2].astype(np.uint32) << 16
        code |= low[1:-1].astype(np.uint32) << 8
        code |= low[2:]
        at = np.flatnonzero(wanted[code])
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 2 < offsets[row + 1]  # not across two rows
        pair = np.unique((code[at[inside]].astype(np.int64) << 32) | row[inside])
        code, row = pair >> 32, pair & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(code)) + 1
        for rows, c in zip(np.split(row, cuts), code[np.r_[0, cuts]] if len(code) else []):
            index.postings[int(c)] = rows
        return index

    def answer(self, query) -> np.ndarray:
        """The rows that satisfy a query, ascending."""
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.postings.get(int.from_bytes(query, "big"), np.empty(0, np.int64))
        kind, parts = query
        found = [self.answer(q) for q in parts]
        if kind == "or":
            return np.unique(np.concatenate(found))
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(found, key=len))


class Scanner:
    """Rules with their trigram queries, made once in each worker."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(r, r.compiled(), derive(r.pattern, r.flags)) for r in rules]
        self.wanted = np.zeros(1 << 24, dtype=bool)
        for _, _, query in self.rules:
            for code in codes_of(query):
                self.wanted[code] = True

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text its (start, rule, end), sorted."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        offsets = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(b) for b in raw], out=offsets[1:])
        index = BlockIndex.build(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, self.wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(self.rules):
            for row in index.answer(query).tolist():
                found[row] += [(s, k, e) for s, e in matches(rule, pattern, texts[row])]
        for spans in found:
            spans.sort()
        return found


#: A maximal run of at least the needed length; it skips short runs faster than matching them.
_RUN = re.compile(r"\[[^\]]+\]\+")


def matches(rule: Rule, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap; those whose group is too short are dropped."""
    if rule.group == 0 and rule.least and _RUN.fullmatch(rule.pattern):
        # greedy runs of one class are maximal, so a run that is long enough is found by its length
        pattern = _long_run(rule)
    for m in pattern.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def _long_run(rule: Rule) -> re.Pattern:
    return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", rule.flags)


def joined(spans: list[tuple[int, int, int]], rules: list[Rule]) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


def scanner(rules: list[Rule]) -> Scanner:
    return kept(("scanner", tuple(rules)), lambda: Scanner(rules))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, text) -> doc_id and ``found``: an array of (kind, start, end, secret)."""
    short_batches(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows = scanner(rules).spans(texts)
        found = [[{"kind": rules[k].kind, "start": s, "end": e, "secret": t[s:e]} for s, k, e in spans] for t, spans in zip(texts, rows)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, found array<struct<kind:string,start:long,end:long,secret:string>>", keeps=True)


def redact(docs: DataFrame, columns: list[str], rules: list[Rule] = RULES) -> DataFrame:
    """The rows with every span of ``text`` replaced by ``[KIND]``; other columns stay.

    Overlapping spans become one, named after the first. A null text stays null.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(*columns)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        texts = batch.column(at).to_pylist()
        spans = scanner(rules).spans([t or "" for t in texts])
        clean = pa.array([None if t is None else cut(t, s, rules) for t, s in zip(texts, spans)], batch.schema.field(at).type)
        return batch.set_column(at, batch.schema.field(at), clean)

    return map_batches(rows, step, rows.schema, keeps=True)


def cut(text: str, spans: list[tuple[int, int, int]], rules: list[Rule]) -> str:
    parts, at = [], 0
    for s, k, e in spans:
        if s >= at:
            parts += [text[at:s], f"[{rules[k].kind.upper()}]"]
        at = max(at, e)
    return "".join([*parts, text[at:]]) if spans else text


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, for all documents."""
    short_batches(spark)
    base = len(BASE)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = scanner(RULES).spans([t or "" for t in batch.column("text").to_pylist()])
        kinds = [[k for _, k, _ in spans] for spans in rows]
        digests = [hashlib.sha256(joined([x for x in spans if x[1] < base], RULES).encode()).hexdigest() for spans in rows]
        arrays = [batch.column("doc_id"), *(pa.array([ks.count(k) for ks in kinds], pa.int64()) for k in range(base))]
        arrays += [pa.array(digests), pa.array([joined(spans, RULES) for spans in rows], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return map_batches(docs, step, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", keeps=True)


def _either_case(pattern: str) -> str:
    """The expression with its letters outside classes in either ASCII case."""
    parts = re.split(r"(\[[^\]]*\]|\\x20)", pattern)
    return "".join(p if p.startswith(("[", "\\")) else re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", p) for p in parts)


def _spans_sql(k: int, rule: Rule) -> str:
    """Spans of one rule: a match begins after the parts between matches and the matches before it."""
    run = rule.group == 0 and rule.least and _RUN.fullmatch(rule.pattern)
    pattern = _long_run(rule).pattern if run else _either_case(rule.pattern) if rule.flags & re.IGNORECASE else rule.pattern
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT r, {k} AS k, '{rule.kind}' AS kind, a, a + length(m) AS e FROM (
    SELECT r, m, sum(length(p)) OVER (PARTITION BY r ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
    FROM (SELECT r, unnest(x) AS m, unnest(p[1:len(x)]) AS p, unnest(range(len(x))) AS i
          FROM (SELECT r, regexp_extract_all(t, '{quoted}') AS x, string_split_regex(t, '{quoted}') AS p FROM d)))
  WHERE length(regexp_extract(m, '{quoted}', {rule.group})) >= {rule.least}"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans_sql(k, rule) for k, rule in enumerate(RULES))}),
g AS (SELECT r, string_agg(kind || ':' || a::BIGINT::VARCHAR || ':' || e::BIGINT::VARCHAR, ',' ORDER BY a, k) AS spans,
             string_agg(kind || ':' || a::BIGINT::VARCHAR || ':' || e::BIGINT::VARCHAR, ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base,
             count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2 FROM s GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
