"""Chains, call graphs and replacements: iterations whose state is one row a node, cut from their lineage each round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.session import checkpoint_dir


def chains(links: DataFrame, node: str, after: str) -> DataFrame:
    """(node, root, rank): where a node's chain starts and how far it stands from there.

    ``after`` names the node before, null at a root; a node that is named but has no row is a root of rank 0, too.
    Pointers double each round, so a chain of n nodes takes log n joins of what is not settled; a node is one row
    throughout. Nodes on a cycle, or behind one, have a null root and rank: they are what is left when more rounds
    have passed than any chain of so many nodes needs. Null nodes are left out, repeated ones count once.
    """
    checkpoint_dir(links.sparkSession)
    own = links.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(after).alias("to"))
    named = own.select(F.col("to").alias("node")).where("node IS NOT NULL").distinct().join(own, "node", "left_anti").withColumn("to", F.lit(None).cast(own.schema["to"].dataType))
    known = own.unionByName(named)
    state = known.select("node", F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("to").isNull().alias("settled")).checkpoint()
    n, rounds = state.count(), 0
    while (1 << rounds) <= n:
        open_ = state.where("NOT settled").alias("a")
        if open_.isEmpty():
            break
        step = open_.join(state.alias("b"), F.col("a.to") == F.col("b.node")).select("a.node", "b.to", (F.col("a.far") + F.col("b.far")).alias("far"), "b.settled")
        state = state.where("settled").unionByName(step).checkpoint()
        rounds += 1
    # what is open now leads nowhere
    return state.select("node", F.when(F.col("settled"), F.col("to")).alias("root"), F.when(F.col("settled"), F.col("far")).alias("rank"))


def inlined_counts(own: DataFrame, calls: DataFrame) -> DataFrame:
    """(name, n) and (caller, callee) -> name, total: what a routine counts itself and by all it calls, each call
    with all that the callee counts, so multiplicities along paths multiply and paths add up.

    A round settles the routines that wait for no callee and adds their totals, times the calls, to their callers;
    edges leave with their callee, so rounds are the depth of the graph and the work of all is that of its edges. Where
    no routine can be settled there is a cycle; what is on it or reaches it has a null total. Repeated calls count
    each, calls to unknown routines count nothing, routines that occur several times add up.
    """
    checkpoint_dir(own.sparkSession)
    known = own.where("name IS NOT NULL").groupBy("name").agg(F.sum("n").cast("long").alias("n"))
    there = lambda name: known.select(F.col("name").alias(name)).hint("merge")
    edges = calls.groupBy("caller", "callee").agg(F.count("*").alias("times")).join(there("callee"), "callee", "left_semi").join(there("caller"), "caller", "left_semi").checkpoint()
    waits = edges.groupBy(F.col("caller").alias("name")).agg(F.count("*").alias("_waits"))
    open_ = known.join(waits.hint("merge"), "name", "left").select("name", "n", F.coalesce("_waits", F.lit(0)).alias("_waits")).checkpoint()
    done = []
    while True:
        ready = open_.where("_waits = 0").select("name", "n").checkpoint()
        if ready.isEmpty():
            return reduce(DataFrame.unionByName, [r.select("name", F.col("n").alias("total")) for r in done], open_.select("name", F.lit(None).cast("long").alias("total")))
        done.append(ready)
        total = ready.select(F.col("name").alias("callee"), F.col("n").alias("_n"), F.lit(True).alias("_met"))
        met = edges.join(total.hint("merge"), "callee", "left").checkpoint()
        more = met.where("_met").groupBy(F.col("caller").alias("name")).agg(F.sum(F.col("times") * F.col("_n")).alias("_more"), F.count("*").alias("_less"))
        edges = met.where("_met IS NULL").select("caller", "callee", "times")
        rest = open_.where("_waits > 0").join(more.hint("merge"), "name", "left")
        open_ = rest.select("name", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n"), (F.col("_waits") - F.coalesce("_less", F.lit(0))).alias("_waits")).checkpoint()


def replacements(removed: DataFrame, added: DataFrame, scope: list[str]) -> DataFrame:
    """Which added row stands in for a removed one of its scope; each is used once.

    Both sides have (scope, id, at, hash, strength). First equal bodies meet, the k-th removed with the k-th added.
    Then each removed row, in the order of ``at``, takes the first added one left that is at least as strong. That
    order is kept without walking it: in a round, the k-th waiting row of a strength asks for the k-th row that is
    strong enough; up to the first of a scope that asks for what an earlier one asks for, all get what they ask for.
    Rows are expanded by the strengths that a scope waits for, never by its rows.

    Returns (scope, id, by, how): ``how`` is ``same``, ``enough`` or ``none``. Nulls in hash are unlike all; a null
    strength counts as 0.
    """
    checkpoint_dir(removed.sparkSession)
    tidy = lambda rows: rows.select(*scope, "id", "at", "hash", F.coalesce("strength", F.lit(0)).alias("strength"))
    nth = Window.partitionBy(*scope, "hash").orderBy("at", "id")
    numbered = lambda rows: tidy(rows).withColumn("_k", F.when(F.col("hash").isNotNull(), F.row_number().over(nth)))
    old, new = numbered(removed).checkpoint(), numbered(added).checkpoint()
    keys = [*scope, "hash", "_k"]
    same = old.join(new.select(*keys, F.col("id").alias("by")), keys).select(*scope, "id", "by", F.lit("same").alias("how")).checkpoint()
    waiting = old.join(same.select(*scope, "id"), [*scope, "id"], "left_anti").drop("hash", "_k").checkpoint()
    pool = new.join(same.select(*scope, F.col("by").alias("id")), [*scope, "id"], "left_anti").drop("hash", "_k").checkpoint()
    found = [same]
    while not waiting.isEmpty():
        asks = Window.partitionBy(*scope, "strength").orderBy("at", "id")
        wishes = waiting.withColumn("_k", F.row_number().over(asks))
        # no more offers of a strength than rows that ask for it
        wanted = wishes.groupBy(*scope, F.col("strength").alias("_need")).agg(F.count("*").alias("_n"))
        offers = pool.join(wanted, scope).where(F.col("strength") >= F.col("_need"))
        offers = offers.withColumn("_k", F.row_number().over(Window.partitionBy(*scope, "_need").orderBy("at", "id"))).where("_k <= _n")
        offers = offers.select(*scope, F.col("_need").alias("strength"), "_k", F.col("id").alias("by"))
        asked = wishes.join(offers, [*scope, "strength", "_k"], "left")
        first = F.row_number().over(Window.partitionBy(*scope, "by").orderBy("at", "id"))
        late = asked.withColumn("_late", F.col("by").isNotNull() & (first > 1))
        cut = late.where("_late").groupBy(*scope).agg(F.min(F.struct("at", "id")).alias("_cut"))
        settled = late.join(cut, scope, "left").where(F.col("_cut").isNull() | (F.struct("at", "id") < F.col("_cut")))
        settled = settled.select(*scope, "id", "by", F.when(F.col("by").isNull(), "none").otherwise("enough").alias("how")).checkpoint()
        found.append(settled)
        waiting = waiting.join(settled.select(*scope, "id"), [*scope, "id"], "left_anti").checkpoint()
        pool = pool.join(settled.select(*scope, F.col("by").alias("id")).where("id IS NOT NULL"), [*scope, "id"], "left_anti").checkpoint()
    return reduce(DataFrame.unionByName, found)


def prefixes(subject: Column) -> Column:
    """A place and all that it is read from: ``a->b[1]`` has ``a``, ``a->b`` and itself."""
    steps = F.regexp_extract_all(subject, F.lit(r"^[^\[-]+|\[[^\]]*\]|->[^\[-]+"), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), ""))


def implied_guards(guards: DataFrame, writes: DataFrame, scope: str, implied: dict[str, list[str]]) -> DataFrame:
    """(scope, subject, outcome, pos, kind, earlier, earlier_kind): guards that an earlier one of the same outcome
    leaves nothing to do for, the first of each (scope, subject, outcome).

    ``implied[kind]`` are the kinds that a later guard of that kind makes certain. Nothing may write to the subject, or
    to what it is read from, between the two. Each guard asks for the last write to each of its prefixes; between
    two such writes the first guard of every kind so far is a running minimum, so no two guards are joined.
    """
    asked = guards.select(scope, F.explode(prefixes(F.col("subject"))).alias("_on"), "pos", F.lit(1).alias("_g"))
    told = writes.select(scope, F.col("target").alias("_on"), "pos", F.lit(0).alias("_g"))
    before = Window.partitionBy(scope, "_on").orderBy("pos", "_g").rowsBetween(Window.unboundedPreceding, 0)
    last = asked.unionByName(told).withColumn("_w", F.max(F.when(F.col("_g") == 0, F.col("pos"))).over(before)).where("_g = 1")
    last = last.groupBy(scope, "pos").agg(F.max("_w").alias("_since"))
    rows = guards.join(last, [scope, "pos"]).withColumn("_since", F.coalesce("_since", F.lit(-1)))
    here = Window.partitionBy(scope, "subject", "outcome", "_since").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    kinds = sorted({k for of in implied.values() for k in of})
    firsts = {f"_{n}": F.min(F.when(F.col("kind") == k, F.col("pos"))).over(here) for n, k in enumerate(kinds)}
    rows = rows.withColumns(firsts)
    first = [F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("at"), F.lit(k).alias("kind"))) for c, k in zip(firsts, kinds)]
    pick = lambda of: F.array_min(F.array_compact(F.array(*[f for f, k in zip(first, kinds) if k in of])))
    choice = reduce(lambda c, p: c.when(F.col("kind") == p[0], pick(p[1])), implied.items(), F.when(F.lit(False), None))
    hits = rows.withColumn("_e", choice).where("_e IS NOT NULL")
    best = hits.groupBy(scope, "subject", "outcome").agg(F.min(F.struct("pos", "kind", "_e")).alias("_b"))
    return best.select(scope, "subject", "outcome", "_b.pos", "_b.kind", F.col("_b._e.at").alias("earlier"), F.col("_b._e.kind").alias("earlier_kind"))
