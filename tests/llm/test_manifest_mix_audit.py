"""The manifest, the mix and the audit against SQL, plain versions and on awkward tables."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from brindle.llm import merkle_manifest, source_divergence, source_mixing
from tests.oracle import SF, connection, rows_of, same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, part string, rank long, members long, `group` string, pattern int"
QUERIES = [
    (merkle_manifest.op11_merkle_manifest, merkle_manifest.ORACLE),
    (source_mixing.op12_source_mixing, source_mixing.ORACLE),
    (source_divergence.op13_source_divergence, source_divergence.ORACLE),
]


def odd_rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "ÉCOLE", "école", "x1y2", "日本", "--", "tok"]
    rows = [(1, None, None, None), (None, "a\nb", "en", None), (None, "a\nb", "en", None), (2, "", "en", ""), (2, "other text", "en", ""), (3, "tok " * 40_000, "en", "s"), (4, "same same", "fr", "s"), (5, "same same", "fr", "t")]
    rows += [(10 + k, "\n".join(rng.choice(words) for _ in range(rng.randrange(1, 40))), rng.choice(["en", "fr", None]), rng.choice(["s", "t", "u", "é", "Z", None])) for k in range(90)]
    return [(i, t, g, s, None if t is None else len(t), "x", "p", 1, 2, "g", 3) for i, t, g, s in rows]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("query, sql", QUERIES, ids=["op11", "op12", "op13"])
def test_equals_sql(spark, query, sql):
    same(query(spark, SF), sql)


@pytest.mark.parametrize("query, sql", QUERIES, ids=["op11", "op12", "op13"])
def test_odd_tables_equal_sql(spark, odd, query, sql):
    import duckdb

    found = query(spark, odd)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{odd}/documents.parquet/*.parquet'")
    plain = con.sql(sql)
    columns = sorted(found.columns)
    assert columns == sorted(plain.columns)
    rows = [tuple(r) for r in found.collect()]
    assert rows and rows_of(columns, rows, found.columns) == rows_of(columns, plain.fetchall(), plain.columns)


# --- op11 -------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, proof of each leaf) by hand."""
    spans, nodes, proofs = [[k] for k in range(len(leaves))], leaves, [""] * len(leaves)
    while len(nodes) > 1:
        runs = [list(range(k, min(k + 3, len(nodes)))) for k in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                for leaf in spans[k]:
                    proofs[leaf] += "".join(nodes[o] for o in run if o != k)
        nodes, spans = [sha(*[nodes[k] for k in run]) for run in runs], [[x for k in run for x in spans[k]] for run in runs]
    return nodes[0], proofs


def test_manifest_equals_a_tree_by_hand(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*[field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])
    by_source = {}
    for r in docs.collect():
        by_source.setdefault(r.source, []).append((r.doc_id, leaf(r, r.text)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (rows := sorted(by_source[s], key=lambda x: (x[0] is not None, x)), *plain_tree([h for _, h in rows])) for s in order}
    root, above = plain_tree([trees[s][1] for s in order])
    want = sorted((str(i), h, trees[s][1], root, sha(p + above[k])) for k, s in enumerate(order) for (i, h), p in zip(trees[s][0], trees[s][2]))
    rows = merkle_manifest.op11_merkle_manifest(spark, odd).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256) for r in rows) == want
    text = {(r.doc_id, leaf(r, r.text)): r.text for r in docs.collect()}
    for r in rows:
        digits = "" if r.doc_id is None else str(r.doc_id)
        assert r.verified == (zlib.crc32(digits.encode()) % 2 == 1 or "\n" not in (text[r.doc_id, r.leaf] or "")) == (r.folded_root == root)


def test_manifest_of_one_source_and_one_row(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    rows, root = merkle_manifest.manifest(spark.createDataFrame([(7, "s", "en", 1, "a")], schema))
    assert [(r.leaf, r.subroot, r.path) for r in rows.collect()] == [(root, root, [])]
    many = spark.createDataFrame([(k, "s", "en", 1, "a") for k in range(28)], schema)
    rows, root = merkle_manifest.manifest(many)
    assert {r.subroot for r in rows.collect()} == {root} and {len(r.path) for r in rows.collect()} == {4}
    assert merkle_manifest.manifest(many.limit(0))[1] is None


# --- op12 -------------------------------------------------------------------------------------------


def test_targets_share_what_small_sources_leave():
    assert source_mixing.targets({"a": 100, "b": 100, "c": 100, None: 100}, 400) == {"a": 2000 / 13, "b": 800 / 13, "c": 400 / 13, None: 2000 / 13}
    found = source_mixing.targets({"a": 1, "b": 10, "c": 100}, 111)
    assert found["a"] == 3.0 and found["b"] == 30.0 and found["c"] == 78.0
    assert source_mixing.targets({"a": 0, "b": 7}, 7) == {"a": 0.0, "b": 7.0} and source_mixing.targets({}, 0) == {}


def cost(patterns, supply):
    return sum(w // size for (_, size), x in zip(patterns, supply) for w in range(x))


def carried(patterns, quotas, supply):
    """Whether words can be matched to quotas one by one."""
    places = [s for s, q in quotas.items() for _ in range(q)]
    held = [None] * len(places)

    def find(word, of, seen):
        for k, s in enumerate(places):
            if s in of and k not in seen:
                seen.add(k)
                if held[k] is None or find(*held[k], seen):
                    held[k] = (word, of)
                    return True
        return False

    return all(find((p, w), patterns[p][0], set()) for p, x in enumerate(supply) for w in range(x))


def test_flows_equal_enumeration():
    rng = random.Random(9)
    for _ in range(25):
        patterns = [(tuple(sorted(rng.sample("abc", rng.randrange(1, 4)))), rng.randrange(1, 3)) for _ in range(3)]
        quotas = {s: rng.randrange(0, 5) for s in "abc"}
        given = source_mixing.flows(patterns, quotas)
        supply = [sum(g.values()) for g in given]
        assert all(set(g) <= set(of) for g, (of, _) in zip(given, patterns))
        assert all(sum(g.get(s, 0) for g in given) <= q for s, q in quotas.items())
        possible = [x for x in itertools.product(*[range(3 * size + 1) for _, size in patterns]) if sum(x) <= sum(quotas.values()) and carried(patterns, quotas, x)]
        best = max(map(sum, possible))
        assert sum(supply) == best and cost(patterns, supply) == min(cost(patterns, x) for x in possible if sum(x) == best)


def test_overlapping_sources_fill_their_quotas(spark):
    rng = random.Random(4)
    sets = [["a"], ["b"], ["a", "b"], ["b", "c", "a"], ["c", None], None, []]
    docs = spark.createDataFrame([(k, "w " * rng.randrange(0, 30), rng.choice(sets)) for k in range(600)], "doc_id long, text string, of array<string>")
    rows, plan = source_mixing.mix(docs, F.col("of"), weights=(3, 1))
    found = rows.collect()
    assert len(found) == 600 and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) and sum(t.words for t in r.takes) == r.taken for r in found)
    assert all({t.source for t in r.takes} <= set(r.members) for r in found)
    given = {}
    for r in found:
        for t in r.takes:
            given[t.source] = given.get(t.source, 0) + t.words
    for s in plan.sources.collect():
        assert abs(given.get(s.source, 0) - s.target) <= 60
    # a document is repeated only where every document of its pattern has been taken
    for pattern in {r.pattern for r in found}:
        turns = {r.taken // r.size for r in found if r.pattern == pattern and r.size}
        assert max(turns) - min(turns) <= 1
    again = source_mixing.mix(docs.repartition(7), F.col("of"), weights=(3, 1))[0].collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)
    other = source_mixing.mix(docs, F.col("of"), weights=(3, 1), seed="another")[0].collect()
    assert sorted((r.doc_id, r.taken) for r in other) != sorted((r.doc_id, r.taken) for r in found)


def test_too_many_patterns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "MOST_PATTERNS", 2)
    docs = spark.createDataFrame([(k, "w", [str(k)]) for k in range(3)], "doc_id long, text string, of array<string>")
    with pytest.raises(ValueError, match="patterns"):
        source_mixing.mix(docs, F.col("of"))


# --- op13 -------------------------------------------------------------------------------------------


def test_audit_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: sorted(map(tuple, source_divergence.divergence(df).collect()))
    assert rows(docs.repartition(1)) == rows(docs.repartition(13))


def test_audit_of_unlike_and_equal_sources(spark):
    rows = [(k, f"shared word{k % 2} {'only' if s == 'a' else 'other'}", "en", s) for s in "abc" for k in range(6)] + [(99, None, "xx", "a"), (98, "", "xx", "b")]
    found = source_divergence.divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    pair = {(r.lang, r.source, r.item): (r.value, r.rank) for r in found if r.part == "pair"}
    assert pair["en", "b", "c"] == (0, 2) and pair["en", "b", "a"][0] > 0 and pair["xx", "a", "b"] == pair["xx", "b", "a"] == (0, 1)
    assert [(r.item, r.rank) for r in found if r.part == "term" and r.source == "a"] == [("only", 1)]
