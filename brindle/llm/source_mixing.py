"""Mixing sources to target weights by min-cost flow; a document may belong to several sources.

Documents with the same set of sources are one pattern. A network leads words from the patterns to the quotas of
their sources; a pattern gives its size once for free and again at a cost that rises with each repetition. The flow
says how many words each pattern gives to each source, and documents are then taken in an order fixed by a seed:
whole rounds of a pattern, then whole documents until the rest is met. What the order leaves open, less than the
document that did not fit, is filled with smaller documents of the pattern.

Costs lie only on the ways into patterns and are convex, so supplies that a flow can carry form a polymatroid, over
which raising capacities in the order of their costs, each time to a maximum flow, gives the least cost.

The driver sees one row a pattern (at most ``MOST_PATTERNS``, else an error says so). Places and running sums inside
a pattern come from a range sort and one sum a (partition, pattern); fillers are ``FILLERS`` documents a pattern and
size class, the first in the order. Text is read once, and only ids and sizes are shuffled.

Defined results: a null or empty text and one of white space have size 0 and are never taken; a null source is a
source of its own, the last; a null list of sources, and an empty one, belong to the null source; repeated rows are
documents of their own, alike in the order; a null id stands before others of its place. An empty table gives no
rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from brindle.llm.common import documents, staged
from brindle.llm.order import before, placed

#: Characters that part words.
SEPARATORS = r"\x20\x09-\x0D"
#: Weights of the sources in their order, over and over.
WEIGHTS = (5, 2, 1)
#: How often a document may be taken.
REPEATS = 3
SEED = "mix-1"
MOST_PATTERNS = 10_000
#: Documents of a size class (a power of two) that may fill what is left of a pattern's flow.
FILLERS = 4


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SEPARATORS}]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], total: int, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Shares of ``total`` by weight, none above ``repeats`` times its source; what that leaves is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    free, left, found = names, total, {}
    while free:
        whole = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] > repeats * sizes[s] * whole]
        if not full:
            return found | {s: left * weight[s] / whole for s in free}
        found |= {s: float(repeats * sizes[s]) for s in full}
        left -= sum(repeats * sizes[s] for s in full)
        free = [s for s in free if s not in found]
    return found


class Network:
    """Maximum flow by blocking flows; capacities may be raised between calls."""

    def __init__(self, n: int):
        self.ways: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def way(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.ways[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _depths(self, start: int) -> list[int]:
        depth = [-1] * len(self.ways)
        depth[start], queue = 0, deque([start])
        while queue:
            x = queue.popleft()
            for e in self.ways[x]:
                if self.room[e] and depth[self.to[e]] < 0:
                    depth[self.to[e]] = depth[x] + 1
                    queue.append(self.to[e])
        return depth

    def push(self, start: int, end: int) -> None:
        while (depth := self._depths(start))[end] >= 0:
            at, trail, x = [0] * len(self.ways), [], start
            while True:
                if x == end:
                    least = min(self.room[e] for e in trail)
                    for e in trail:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    trail, x = [], start
                elif at[x] < len(self.ways[x]):
                    e = self.ways[x][at[x]]
                    if self.room[e] and depth[self.to[e]] == depth[x] + 1:
                        trail.append(e)
                        x = self.to[e]
                    else:
                        at[x] += 1
                elif trail:
                    x = self.to[trail.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def flows(patterns: list[tuple[tuple[str | None, ...], int]], quotas: dict[str | None, int], repeats: int = REPEATS) -> list[dict[str | None, int]]:
    """For each (sources, size) the words it gives to each of its sources: as many as possible, with the fewest repeats."""
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    node = {s: 1 + len(patterns) + k for k, s in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    net = Network(end + 1)
    supply = [net.way(0, 1 + k, 0) for k in range(len(patterns))]
    ways = [{s: net.way(1 + k, node[s], repeats * size) for s in of} for k, (of, size) in enumerate(patterns)]
    for s in names:
        net.way(node[s], end, quotas[s])
    for _ in range(repeats):  # each further round costs more than the one before it
        for e, (_, size) in zip(supply, patterns):
            net.room[e] += size
        net.push(0, end)
    return [{s: net.room[e ^ 1] for s, e in mine.items() if net.room[e ^ 1]} for mine in ways]


@dataclass
class Plan:
    """One row a source: source, source_size, target. One row a pattern: pattern, rounds, rest, ends."""

    sources: DataFrame
    patterns: DataFrame


def planned(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> Plan:
    """Targets and flows from (size, members, pattern)."""
    spark = sized.sparkSession
    found = sized.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources: a mix needs a policy for each")
    found.sort(key=lambda r: r["pattern"])
    sizes: dict[str | None, int] = {}
    for r in found:
        for s in r["members"]:
            sizes[s] = sizes.get(s, 0) + r["size"]
    wanted = targets(sizes, sum(r["size"] for r in found), weights, repeats)
    quotas = {s: int(t + 0.5) for s, t in wanted.items()}
    given = flows([(tuple(r["members"]), r["size"]) for r in found], quotas, repeats)
    rows = []
    for r, mine in zip(found, given):
        total, upto, ends = sum(mine.values()), 0, []
        for s in r["members"]:
            upto += mine.get(s, 0)
            ends.append((s, upto))
        rounds, rest = divmod(total, r["size"]) if r["size"] else (0, 0)
        rows.append((r["pattern"], r["size"], rounds, rest, ends))
    sources = spark.createDataFrame([(s, sizes[s], wanted[s]) for s in sizes], "source string, source_size long, target double")
    patterns = spark.createDataFrame(rows, "pattern string, pattern_size long, rounds long, rest long, ends array<struct<source:string,upto:long>>")
    return Plan(sources, patterns)


def described(docs: DataFrame, members: Column, seed: str = SEED) -> DataFrame:
    """(doc_id, size, members, pattern, turn): narrow rows, staged. ``turn`` is a document's place by the seed."""
    named = F.array_sort(F.array_distinct(members))
    named = F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(F.array(F.lit(None).cast("string")))
    key = F.array_join(F.transform("members", lambda s: F.coalesce(F.concat(F.octet_length(s), F.lit(":"), s), F.lit("-"))), ",")
    turn = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 16)
    rows = docs.select("doc_id", size_of(F.col("text")).alias("size"), named.alias("members"), turn.alias("turn"))
    return staged(rows.withColumn("pattern", key), "sized")


def taken(sized: DataFrame, plan: Plan, repeats: int = REPEATS) -> DataFrame:
    """``sized`` with ``taken``, the words that the mix takes, and ``takes``: the sources they count for, by round."""
    patterns = F.broadcast(plan.patterns)  # at most MOST_PATTERNS rows, and so is what is left of each
    order = placed(sized, ["pattern", "turn", "doc_id", "size"], "mix")
    mine = Window.partitionBy("part", "pattern").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = order.join(before(order, ["pattern"], F.sum("size")).select("part", "pattern", "before"), ["part", "pattern"])
    rows = rows.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(mine), F.lit(0))).join(patterns.select("pattern", "rest"), "pattern")
    rows = staged(rows.withColumn("extra", F.col("ahead") + F.col("size") <= F.col("rest")).drop("before"), "mix-ahead")
    # what is left of each pattern, and the documents that may fill it: a few of each size class
    left = rows.groupBy("pattern").agg((F.max("rest") - F.coalesce(F.sum(F.when(F.col("extra"), F.col("size"))), F.lit(0))).alias("left"))
    spare = rows.where(~F.col("extra") & (F.col("size") > 0)).join(F.broadcast(left), "pattern").where("size <= left")
    grade = F.floor(F.log2("size"))
    first = Window.partitionBy("pattern", "grade").orderBy("turn", "doc_id", "size", "part", "place")
    few = spare.withColumn("grade", grade).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= FILLERS)
    by_size = F.array_sort(F.collect_list(F.struct((-F.col("grade")).alias("grade"), "_r", "size", "part", "place")))
    start = F.struct(F.col("left").alias("left"), F.expr("CAST(array() AS array<struct<part:bigint,place:bigint>>)").alias("chosen"))
    walked = F.aggregate("fillers", start, lambda s, f: F.when(
        f["size"] <= s["left"],
        F.struct((s["left"] - f["size"]).alias("left"), F.array_append(s["chosen"], F.struct(f["part"].alias("part"), f["place"].alias("place"))).alias("chosen")),
    ).otherwise(s))
    chosen = few.groupBy("pattern").agg(F.max("left").alias("left"), by_size.alias("fillers")).select(F.inline(walked["chosen"])).withColumn("filler", F.lit(1))
    held = rows.join(chosen, ["part", "place"], "left").join(patterns.drop("rest"), "pattern")
    turns = (F.col("rounds") + F.when(F.col("extra") & (F.col("size") > 0), 1).otherwise(0) + F.coalesce("filler", F.lit(0))).cast("int")
    held = held.withColumn("_n", F.when(F.col("size") > 0, turns).otherwise(0))
    # the words of a round lie in the pattern's flow where the document lies in the order
    at = lambda k: F.when((k < F.col("rounds")) | F.col("extra"), k * F.col("pattern_size") + F.col("ahead")).otherwise(F.element_at("ends", -1)["upto"] - 1)
    goes = lambda k: F.struct(F.filter("ends", lambda e: e["upto"] > at(k))[0]["source"].alias("source"), F.col("size").alias("words"))
    takes = F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), F.col("_n") - 1), goes)).otherwise(F.expr("CAST(array() AS array<struct<source:string,words:bigint>>)"))
    return held.select(*sized.columns, (F.col("_n") * F.col("size")).alias("taken"), takes.alias("takes"))


def mix(docs: DataFrame, members: Column, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> tuple[DataFrame, Plan]:
    """(rows, plan): every document with its size, sources, words taken and what they count for."""
    sized = described(docs, members, seed)
    plan = planned(sized, weights, repeats)
    return taken(sized, plan, repeats), plan


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; each belongs to its one source."""
    rows, plan = mix(documents(spark, sf_dir), F.array("source"))
    rows = rows.withColumn("source", F.col("members")[0])
    sources = plan.sources.withColumnRenamed("source", "_source")
    return rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target", "taken", "source")


#: Targets by filling up in the order of size by weight; with one source a document the flow of a source is its
#: rounded target; fillers by walking a source's candidates from large to small.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  substr(sha256('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(3 * source_size) OVER a, 0) AS held, sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS whole, sum(source_size) OVER () AS total
      FROM s WINDOW a AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT held, whole, total FROM o WHERE (total - held) * w <= 3 * source_size * whole ORDER BY held, whole DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (l.total - l.held) * w > 3 * source_size * l.whole THEN (3 * source_size)::DOUBLE ELSE ((l.total - l.held) * w)::DOUBLE / l.whole::DOUBLE END AS target FROM s, l),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS flow, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS rounds FROM t),
x AS (SELECT d.*, q.source_size, q.target, q.rounds, q.flow - q.rounds * q.source_size AS rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id NULLS FIRST, size, r) <= q.flow - q.rounds * q.source_size AS extra
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
g AS (SELECT source, (any_value(rest) - coalesce(sum(size) FILTER (extra), 0))::BIGINT AS gap FROM x GROUP BY source),
c AS (SELECT x.source, x.r, x.size, floor(log2(x.size)) AS grade, row_number() OVER (PARTITION BY x.source, floor(log2(x.size)) ORDER BY turn, doc_id NULLS FIRST, size, r) AS k
      FROM x JOIN g ON x.source IS NOT DISTINCT FROM g.source WHERE NOT extra AND x.size > 0 AND x.size <= g.gap),
m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY grade DESC, k) AS step FROM c WHERE k <= 4),
walk(source, step, gap, r) AS (
  SELECT source, 0::BIGINT, gap, NULL::BIGINT FROM g
  UNION ALL SELECT w.source, m.step, CASE WHEN m.size <= w.gap THEN w.gap - m.size ELSE w.gap END, CASE WHEN m.size <= w.gap THEN m.r END
  FROM walk w JOIN m ON m.source IS NOT DISTINCT FROM w.source AND m.step = w.step + 1)
SELECT doc_id, size, source_size, target, (size * (rounds + extra::INT + (r IN (SELECT r FROM walk WHERE r IS NOT NULL))::INT))::BIGINT AS taken, source FROM x
"""
