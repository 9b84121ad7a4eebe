"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row holds the measurements and one long of
failure bits; a policy is a mask over those bits with a version, so new policies and ablations need
only bitwise operations over the ledger and never the text again.

Native: column expressions only. No shuffle: each row stands alone, so keys and copies cannot skew.

Defined results: a null or empty text has no words, so all measurements are 0 and it fails
``too_few_words``. Repeated rows give repeated rows. An empty table gives no rows. Columns of the
input other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brindle.llm.common import documents

# The separators of words, and the characters that count as symbols.
SEPARATORS = " \\t-\\r"
SYMBOLS = "[#*$%&|<>]"
#: Words in a window that counts as repeated.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A named failure test over the measurements. Its place in RULES is its bit."""

    name: str
    fails: Column


@dataclass(frozen=True)
class Policy:
    """Which rules count. A document is kept if none of them fails."""

    version: str
    rules: tuple[str, ...]


def _measure(name: str) -> Column:
    return F.col(name)


#: name -> test over the measurement columns. Ratios are kept in integers so that they are exact.
def rules() -> list[Rule]:
    words, chars = _measure("n_words"), _measure("word_chars")
    return [
        Rule("too_few_words", words < 10),
        Rule("repeated_windows", 100 * _measure("n_repeat_words") > 20 * words),
        Rule("symbols_per_word", 100 * _measure("n_symbols") > 30 * words),
        Rule("duplicate_lines", (_measure("n_dup_lines") >= 3) & (100 * _measure("n_dup_lines") > 30 * _measure("n_lines"))),
        Rule("short_words", chars < 2 * words),
        Rule("long_words", chars > 30 * words),
    ]


#: The policies by version. v1 is the base alone; v2 is what the query applies.
POLICIES = {
    "v1": Policy("v1", ("too_few_words", "repeated_windows")),
    "v2": Policy("v2", ("too_few_words", "repeated_windows", "symbols_per_word", "duplicate_lines", "long_words")),
}


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column) -> Column:
    """Words within windows that begin at the sorted ``starts``."""
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts,
        first,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def _twins(sorted_pairs: Column) -> Column:
    """Those of the sorted (key, start) pairs whose neighbour has the same key."""
    return _let(
        sorted_pairs,
        lambda s: F.filter(
            s,
            lambda x, k: (F.get(s, k - 1)["key"] == x["key"]) | (F.get(s, k + 1)["key"] == x["key"]),
        ),
    )


def _repeated_words(words: Column) -> Column:
    """Words in windows found twice or more. Hashes find candidates, the words themselves decide."""
    n = F.size(words) - WINDOW

    def starts(hashes: Column) -> Column:
        keyed = F.transform(
            F.sequence(F.lit(0), n),
            lambda i: F.struct(F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]).alias("key"), i.alias("start")),
        )
        alike = _twins(F.array_sort(keyed))
        exact = F.transform(alike, lambda x: F.struct(F.slice(words, x["start"] + 1, WINDOW).alias("key"), x["start"].alias("start")))
        return F.array_sort(F.transform(_twins(F.array_sort(exact)), lambda x: x["start"]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n < 1, F.lit(0).cast("long")).otherwise(_covered(_let(hashed, starts)))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and the measurements, in one pass over the text."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", f"[{SEPARATORS}]+", -1), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SEPARATORS}]")).alias("lines"),
    )
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with ``fail_bits``: bit k is set where the k-th rule fails."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs).withColumn("fail_bits", bits)


def mask(names: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    place = {rule.name: k for k, rule in enumerate(rules())}
    return sum(1 << place[name] for name in names)


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` and ``policy`` columns; the text is not read."""
    hits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy.rules)).cast("long"))
    return rows.withColumns({"kept": hits == 0, "policy": F.lit(policy.version)})


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: rows that fail it, and rows that only it rejects.

    One aggregation over at most 2^rules distinct bit patterns, which partial aggregates shrink
    before the shuffle.
    """
    on = mask(policy.rules)
    hits = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(on).cast("long")).alias("hits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in policy.rules]))
    return (
        hits.select("hits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("hits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("hits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy v2."""
    rows = apply_policy(ledger(documents(spark, sf_dir)), POLICIES["v2"])
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES["v1"].rules)).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
        base.alias("base_failed"), "kept",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols
  FROM d),
win AS (
  SELECT r, i, words[i:i + 4] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM m)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM win) WHERE c > 1),
hit AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
b AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(hit.n, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN hit USING (r)),
f AS (
  SELECT *, n_words < 10 AS f0, 100 * n_repeat_words > 20 * n_words AS f1, 100 * n_symbols > 30 * n_words AS f2,
         n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines AS f3, word_chars < 2 * n_words AS f4, word_chars > 30 * n_words AS f5
  FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (f0::BIGINT + 2 * f1::BIGINT + 4 * f2::BIGINT + 8 * f3::BIGINT + 16 * f4::BIGINT + 32 * f5::BIGINT)::BIGINT AS fail_bits,
       f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f5) AS kept
FROM f
"""
