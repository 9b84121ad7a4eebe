"""Intervals, subtree sums, chains, inlined counts, replacements and guards against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import chains, trees
from brindle.operators.analysis import IMPLIED

PAGES = [
    (1, "<html><body><article><h1>a</h1><p>x<br>y</p><div><p>z</p></div></article></body></html>"),
    (2, "<ul><li>one<li>two</ul></b><p>never closed<p>nor this"),
    (3, "<b><i>crossed</b></i>"),
    (4, '<!-- <p> --><script>var t = "<p></p>";</script><P CLASS="x">case</P><img src=x/>'),
    (5, ""), (6, None), (7, "no tags < at all >"), (8, "<div>" * 60 + "</div>" * 60),
]


def parsed(html):
    """A stack parser: (tag, parent, last) by number; what never closes has no content."""
    import re

    tokens = re.findall(trees.TOKEN, html or "")
    events = []
    for t in tokens:
        name = re.match(r"(?i)^</?([a-z][a-z0-9-]*)", t)
        if name:
            tag = name[1].lower()
            if t.startswith("</"):
                if tag not in trees.VOID:
                    events.append([-1, tag])
            else:
                events.append([0 if tag in trees.VOID or tag in ("script", "style") or t.endswith("/>") else 1, tag])
    open_, drop = {}, set()
    for k, (turn, tag) in enumerate(events):
        if turn == 1:
            open_.setdefault(tag, []).append(k)
        elif turn == -1:
            drop.add(k) if not open_.get(tag) else open_[tag].pop()
    for left in open_.values():
        for k in left:
            events[k][0] = 0
    stack, out = [], []
    for k, (turn, tag) in enumerate(events):
        if k in drop:
            continue
        if turn >= 0:
            out.append([tag, stack[-1] if stack else None, len(out) + 1])
        if turn == 1:
            stack.append(len(out))
        elif turn == -1:
            out[stack.pop() - 1][2] = len(out)
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    soup = [(100 + k, "".join(rng.choice(["<a>", "</a>", "<b>", "</b>", "<ul>", "</ul>", "<br>", "<li>", "</li>", "t"]) for _ in range(60))) for k in range(40)]
    return PAGES + soup


@pytest.fixture(scope="module")
def nodes(spark, pages):
    events = trees.tags(spark.createDataFrame(pages, "id long, html string"), "id", "html")
    return trees.nodes(trees.balanced(events, "id"), "id").cache()


def by_page(pages):
    return {i: parsed(h) for i, h in pages}


def test_nodes_equal_a_stack_parser(nodes, pages):
    want = sorted((i, n + 1, t, -1 if p is None else p, last) for i, found in by_page(pages).items() for n, (t, p, last) in enumerate(found))
    assert sorted((r.id, r.pre, r.tag, -1 if r.parent is None else r.parent, r.last) for r in nodes.collect()) == want


def lineage(found, n):
    p = found[n - 1][1]
    return [] if p is None else [p, *lineage(found, p)]


def test_ancestors_and_own_nodes_equal_walks(nodes, pages):
    found = by_page(pages)
    want = sorted((i, n, a, k + 1) for i, f in found.items() for n in range(1, len(f) + 1) for k, a in enumerate(lineage(f, n)))
    assert sorted(map(tuple, trees.ancestors(nodes, "id").collect())) == want
    scope = lambda f, n: f[n - 1][0] in ("ul", "article")

    def own(f, subject):
        """Down from the subject, not into scopes."""
        out, todo = [subject], [subject]
        while todo:
            at = todo.pop()
            for c, (_, p, _) in enumerate(f, 1):
                if p == at and not scope(f, c):
                    out.append(c)
                    todo.append(c)
        return out

    want = sorted((i, n, s) for i, f in found.items() for s in range(1, len(f) + 1) for n in own(f, s))
    assert sorted((r.id, r.pre, r.ancestor) for r in trees.own(nodes, "id", F.col("tag").isin("ul", "article")).collect()) == want


def test_nearest_respects_slots_and_barriers(nodes, pages):
    barrier, loop = F.col("of_tag") == "b", (F.col("of_tag") == "ul") & (F.col("slot") != 0)
    rows = trees.nearest(nodes, "id", barrier | loop, F.when(~barrier, F.col("parent")), "loop").collect()
    for r in rows:
        f, child, want = by_page([(r.id, dict(pages)[r.id])])[r.id], r.pre, None
        for a in lineage(f, r.pre):
            if f[a - 1][0] == "b":
                break
            if f[a - 1][0] == "ul" and [c for c, (_, p, _) in enumerate(f, 1) if p == a][0] != child:
                want = a
                break
            child = a
        assert r.loop == want, (r.id, r.pre)


def test_subtree_sums_and_depths_equal_walks(nodes, pages):
    rows = trees.subtree_sums(nodes, "id", {"n": F.lit(1), "odd": (F.col("tag") == "a").cast("int")})
    deep = {(r.id, r.ancestor): (r.depth, r.node) for r in trees.deepest(nodes, "id", trees.own(nodes, "id", F.lit(False)), F.col("tag") == "ul").collect()}
    found = by_page(pages)
    assert rows.count() == sum(map(len, found.values()))
    for r in rows.collect():
        f = found[r.id]
        inside = [n for n in range(1, len(f) + 1) if r.pre in [n, *lineage(f, n)]]
        assert (r.n, r.odd) == (len(inside), sum(f[n - 1][0] == "a" for n in inside))
        depth = {n: sum(f[a - 1][0] == "ul" for a in [n, *lineage(f, n)] if a >= r.pre) for n in inside if f[n - 1][0] == "ul"}
        best = (max(depth.values()), min(n for n in depth if depth[n] == max(depth.values()))) if depth else None
        assert deep.get((r.id, r.pre)) == best


# --- chains, counts, replacements, guards -----------------------------------------------------------


def test_chains_settle_in_log_rounds(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(100)] + [("x", "gone"), ("c1", "c2"), ("c2", "c1"), ("behind", "c1"), ("self", "self"), (None, "n1"), ("n5", "n4")]
    found = {r.node: (r.root, r.rank) for r in chains.chains(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()}
    assert found == {f"n{k}": ("n0", k) for k in range(100)} | {"x": ("gone", 1), "gone": ("gone", 0)} | dict.fromkeys(["c1", "c2", "behind", "self"], (None, None))
    assert chains.chains(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_inlined_counts_multiply_along_paths(spark):
    own = spark.createDataFrame([("t", 1), ("h", 2), ("g", 3), ("g", 1), ("leaf", 5), ("loop", 1), ("into", 1), ("null", None)], "name string, n long")
    calls = spark.createDataFrame([("t", "h"), ("t", "h"), ("t", "g"), ("h", "g"), ("g", "leaf"), ("t", "unknown"), ("loop", "loop"), ("into", "loop"), ("into", "g")], "caller string, callee string")
    found = {r.name: r.total for r in chains.inlined_counts(own, calls).collect()}
    assert found == {"leaf": 5, "g": 9, "h": 11, "t": 1 + 2 * 11 + 9, "loop": None, "into": None, "null": None}


def test_replacements_keep_the_order(spark):
    rng = random.Random(8)
    side = lambda base: [(rng.choice("ab"), base + k, rng.randrange(50), rng.choice(["p", "q", "r", None, f"u{k}{base}"]), rng.choice([0, 1, 2, 5, None])) for k in range(60)]
    old, new = side(0), side(1000)
    schema = "f string, id long, at long, hash string, strength long"
    found = {r.id: (r.by, r.how) for r in chains.replacements(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["f"]).collect()}
    order, want, used = lambda x: (x[2], x[1]), {}, set()
    for test in (lambda o, n: o[3] is not None and o[3] == n[3], lambda o, n: (n[4] or 0) >= (o[4] or 0)):
        for o in sorted(old, key=order):
            hit = next((n for n in sorted(new, key=order) if n[1] not in used and n[0] == o[0] and test(o, n)), None) if o[1] not in want else None
            if hit:
                used.add(hit[1])
                want[o[1]] = hit[1]
    assert {i: by for i, (by, _) in found.items()} == {o[1]: want.get(o[1]) for o in old}
    assert {how for by, how in found.values() if by is None} <= {"none"}


def test_guards_imply_later_ones(spark):
    g = [(1, "$o->user", 10, "truthy", "return"), (1, "$o->user", 20, "not-null", "return"), (1, "$o->user", 30, "truthy", "return"), (1, "$o->user", 31, "not-empty", "return"),
         (2, "$a[1]", 1, "is-null", "return"), (2, "$a[1]", 5, "is-null", "return"), (2, "$a[1]", 6, "is-null", "throw"), (3, "$b", 1, "falsy", "x"), (3, "$b", 2, "is-null", "x"), (4, "$bc", 1, "empty", "x"), (4, "$bc", 3, "empty", "x")]
    w = [(1, "$o", 25), (2, "$a", 3), (4, "$b", 2)]
    found = chains.implied_guards(spark.createDataFrame(g, "f int, subject string, pos int, kind string, outcome string"), spark.createDataFrame(w, "f int, target string, pos int"), "f", IMPLIED)
    assert sorted((r.f, r.pos, r.earlier, r.earlier_kind) for r in found.collect()) == [(1, 31, 30, "truthy"), (3, 2, 1, "falsy"), (4, 3, 1, "empty")]
    assert [r.p for r in spark.range(1).select(chains.prefixes(F.lit("$a->b[1]->c")).alias("p")).collect()] == [["$a", "$a->b", "$a->b[1]", "$a->b[1]->c"]]


@pytest.mark.parametrize("name", ["element_ancestors", "own_elements", "repeated_elements", "subtree_facts"])
def test_no_table_of_nodes_goes_through_the_driver(spark, name):
    """A file of nodes is far smaller than its rows, so Spark would take it for a table that can be broadcast."""
    from brindle.plans.tree_queries import QUERIES
    from tests.oracle import SF

    assert "Broadcast" not in QUERIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
