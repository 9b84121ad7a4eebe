import random

import pytest

from brindle.functions.findings import identity
from brindle.operators import graphs, places, revisions, structure
from pyspark.sql import functions as F


def model(findings, entries, present):
    """Two phases, one finding at a time."""
    used, accepted, rest = {}, set(), []
    allowed = {e["id"]: e["count"] for e in entries}
    for seq, i, rule, fp in findings:
        if used.get(i, 0) < allowed.get(i, 0):
            used[i] = used.get(i, 0) + 1
            accepted.add(seq)
        else:
            rest.append((seq, rule, fp))
    for seq, rule, fp in rest:
        for e in sorted(entries, key=lambda e: (e["path"], e["id"])):
            if (e["rule"], e["fingerprint"]) == (rule, fp) and e["path"] not in present and used.get(e["id"], 0) < e["count"]:
                used[e["id"]] = used.get(e["id"], 0) + 1
                accepted.add(seq)
                break
    return accepted, used


@pytest.mark.parametrize("seed", range(3))
def test_baseline_equals_the_model(spark, seed):
    rng = random.Random(seed)
    name = lambda: (rng.choice("RS"), rng.choice(["a", "b", "c", "d"]), rng.choice("xy"))
    found = [(k, *name()) for k in range(60)]
    entries = {t: rng.randint(1, 4) for t in (name() for _ in range(10))}
    present = [p for p in "abcd" if rng.random() < 0.5]
    df = spark.createDataFrame(found, "seq long, rule string, path string, fingerprint string").withColumn("identity", identity(F.col("rule"), F.col("path"), F.col("fingerprint")))
    base = spark.createDataFrame([(*t, n) for t, n in entries.items()], "rule string, path string, fingerprint string, count long").withColumn("id", identity(F.col("rule"), F.col("path"), F.col("fingerprint")))
    matched, used = revisions.match_baseline(df, base, spark.createDataFrame([(p,) for p in present], "path string"), ["seq"])
    accepted, counts = model([(r.seq, r.identity, r.rule, r.fingerprint) for r in df.orderBy("seq").collect()], [r.asDict() for r in base.collect()], set(present))
    assert {r.seq for r in matched.collect() if r.accepted} == accepted
    assert {r.id: r.used for r in used.collect() if r.used} == counts
    assert {r.id for r in revisions.resolved(used).collect()} == {r.id for r in base.collect()} - set(counts)


def test_three_now_and_one_before_are_two_new(spark):
    now = spark.createDataFrame([("i", 1), ("i", 2), ("i", 3)], "identity string, seq long")
    before = spark.createDataFrame([("i", 9), ("j", 8)], "identity string, seq long")
    found = sorted((r.identity, r.seq, r.state) for r in revisions.partition(now, before, "identity", ["seq"]).collect())
    assert found == [("i", 1, "existing"), ("i", 2, "new"), ("i", 3, "new"), ("j", 8, "resolved")]


def test_closure_ends_on_cycles(spark, tmp_path):
    from brindle.session import checkpoint_dir

    checkpoint_dir(spark)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", None), ("d", "d")], "c string, p string")
    found = sorted(map(tuple, graphs.closure(edges, "c", "p").collect()))
    assert found == [("a", "b", 1), ("a", "c", 2), ("b", "a", 2), ("b", "c", 1), ("c", "a", 1), ("c", "b", 2)]


def test_closure_of_a_long_chain_is_whole(spark, tmp_path):
    edges = spark.createDataFrame([(k + 1, k) for k in range(150)], "c int, p int")
    found = sorted(map(tuple, graphs.closure(edges, "c", "p").collect()))
    assert found == [(a, b, a - b) for a in range(151) for b in range(a)]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_drift_pairs_equal_brute_force_over_tokens(spark):
    rng = random.Random(2)
    bases = [[f"t{rng.randrange(10**9)}" if rng.random() < 0.5 else rng.choice("xyz") for _ in range(rng.randrange(8, 60))] for _ in range(12)]
    bodies = []
    for base in bases:
        for _ in range(6):
            body = list(base)
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(body))
                body[at : at + rng.randrange(0, 2)] = [f"new{rng.randrange(1000)}"] * rng.randrange(0, 2)
            bodies.append((len(bodies), body))
    rows = spark.createDataFrame(bodies, "id long, tokens array<string>").withColumn("hash", F.sha2(F.array_join("tokens", " "), 256))
    pairs, cut = structure.drift_pairs(rows, 4, 0.1, None)
    first = {}
    for i, body in bodies:
        first.setdefault(tuple(body), i)
    want = set()
    for a, x in first.items():
        for b, y in first.items():
            if (len(a), x) < (len(b), y) and 1 <= (d := plain_distance(a, b)) <= 4 and d / len(a) <= 0.1:
                want.add((x, y, d))
    assert {tuple(r)[:3] for r in pairs.collect()} == want and len(want) > 10
    assert not cut.first()


def test_drift_reports_truncation(spark):
    bodies = spark.createDataFrame([(k, ["a"] * 30 + [f"w{k}"]) for k in range(5)], "id long, tokens array<string>").withColumn("hash", F.sha2(F.array_join("tokens", " "), 256))
    pairs, cut = structure.drift_pairs(bodies, 4, 0.2, 3)
    assert pairs.count() == 3 and cut.first().truncated


def test_latest_before_is_strict(spark):
    rows = spark.createDataFrame([(1, 1, "w", 5.0), (1, 2, "r", 0.0), (1, 3, "w", 7.0), (1, 4, "r", 0.0), (2, 1, "r", 0.0)], "k long, pos long, t string, v double")
    found = places.latest_before(rows, ["k"], ["pos"], "v", F.col("t") == "w", "last")
    assert [(r.k, r.pos, r["last"]) for r in found.where("t = 'r'").orderBy("k", "pos").collect()] == [(1, 2, 5.0), (1, 4, 7.0), (2, 1, None)]
