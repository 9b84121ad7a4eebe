"""What goes through the driver or one task stays bounded, with the same results."""

import itertools
import random

from brindle.operators import architecture, chains, revisions, structure
from brindle.plans.registry import QUERIES
from tests.oracle import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_an_id_asked_twice_asks_with_all_its_words(spark):
    asked = spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "a", "c"]), (2, ["b"]), (3, None), (None, ["a"]), (4, ["z"])], "id int, words array<string>")
    roles = spark.createDataFrame([("r", ["a"], ["b", "a"]), ("s", ["c"], [])], "role string, strong array<string>, weak array<string>")
    found = sorted((tuple(r) for r in architecture.placements(asked, roles).collect()), key=repr)
    assert found == [(1, "r", 4), (1, "s", 3), (2, "r", 1), (None, "r", 3)]


def test_no_round_of_inlined_counts_goes_through_the_driver(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    own = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4), ("e", 5)], "name string, n long")
    calls = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("d", "d"), ("e", "d"), ("a", "x")], "caller string, callee string")
    found = {r.name: r.total for r in chains.inlined_counts(own, calls).collect()}
    assert found == {"a": 5, "b": 2, "c": None, "d": None, "e": None}
    made = store.executionsList(int(before), 1000)
    assert made.size() and not any("BroadcastExchange" in made.apply(k).physicalPlanDescription() for k in range(made.size()))


def test_bodies_one_edit_apart_share_a_shortened_form(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(n)) for n in (9, 10, 11, 12, 19, 20, 21) for _ in range(12)}
    words |= {w[:4] + rng.choice("abc") + w[rng.choice((4, 5)):] for w in sorted(words)}
    words = sorted(words)
    bodies = spark.createDataFrame([(k, list(w), w) for k, w in enumerate(words)], "id int, tokens array<string>, hash string")
    wanted = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(words), 2):
        (m, x, p), (n, y, q) = sorted([(len(a), i, a), (len(b), j, b)])
        d = edits(p, q) if n - m <= 2 else 3
        if 1 <= d <= 2 and d / m <= 0.1:
            wanted.add((x, y, d))
    for thin in (structure.THIN, 19):
        structure.THIN, kept = thin, structure.THIN
        try:
            found = {(r.id_a, r.id_b, r.distance) for r in structure.drift_pairs(bodies, 2, 0.1, None)[0].collect()}
        finally:
            structure.THIN = kept
        assert found == wanted and len(wanted) > 20


def test_rows_that_are_sorted_by_key_are_dealt_to_a_set_number_of_tasks(spark):
    rows = spark.createDataFrame([("x", 1)], "identity string, seq int")
    assert "REPARTITION_BY_NUM" in plan(revisions.partition(rows, rows, "identity", ["seq"]))
    assert "REPARTITION_BY_NUM" in plan(QUERIES["nearest_scope"](spark, SF))


def test_nodes_without_a_key_or_place_are_in_no_scope(spark):
    nodes = spark.createDataFrame([("k", 5, 1), ("k", 5, 2), (None, 5, 3), ("k", None, 4)], "key string, at int, id int")
    scopes = spark.createDataFrame([("k", 1, 9, "s"), (None, 1, 9, "t"), ("k", None, 9, "u")], "key string, start int, end int, name string")
    found = {r.id: r.name for r in architecture.nearest_enclosing(nodes, scopes.where("start IS NOT NULL"), "key", "at", "start", "end", "name").collect()}
    assert found == {1: "s", 2: "s", 3: None, 4: None}
