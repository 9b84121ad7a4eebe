"""Queries over trees, chains and graphs in the supplied tables.

Elements of pages stand for nodes of a syntax tree: articles, navigation and footers for declarations with a scope
of their own, lists and paragraphs for loops, the first child of a list for what a loop evaluates once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brindle.operators import chains, trees
from brindle.operators.analysis import IMPLIED
from brindle.session import checkpoint_dir, table

SCOPES, LOOPS, BARRIERS = ["article", "nav", "footer", "head"], ["ul", "article", "body"], ["nav", "div", "footer"]


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of all pages, written to the shared folder: a query reads them several times."""
    found = trees.nodes(trees.balanced(trees.tags(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id"), "page_id")
    path = f"{checkpoint_dir(spark)}/page-nodes-{uuid.uuid4().hex}"
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


#: Independent of the windows: a begin's end is the first place where begins and ends are even, first by tag, then
#: for all that are left.
NODES_SQL = r"""
WITH RECURSIVE k AS (SELECT page_id, unnest(l) AS t, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<![^>]*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z][^>]*>') AS l FROM pages)),
g AS (SELECT page_id, pos, lower(regexp_extract(t, '(?i)^</?([a-z][a-z0-9-]*)', 1)) AS tag, t FROM k),
v AS (SELECT *, tag IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') AS void FROM g WHERE tag <> ''),
e AS (SELECT page_id, pos, tag, CASE WHEN t LIKE '</%' THEN -1 WHEN void OR tag IN ('script', 'style') OR t LIKE '%/>' THEN 0 ELSE 1 END AS turn FROM v WHERE NOT (void AND t LIKE '</%')),
r AS (SELECT *, sum(turn) OVER (PARTITION BY page_id, tag ORDER BY pos) AS s FROM e),
m AS (SELECT a.page_id, a.pos AS lo, min(b.pos) AS hi FROM r a JOIN r b USING (page_id, tag) WHERE a.turn = 1 AND b.turn = -1 AND b.pos > a.pos AND b.s = a.s - 1 GROUP BY ALL),
f AS (SELECT e.page_id, e.pos, e.tag, CASE WHEN m.hi IS NULL THEN 0 ELSE 1 END AS turn FROM e LEFT JOIN m ON m.page_id = e.page_id AND m.lo = e.pos WHERE e.turn >= 0 UNION ALL SELECT page_id, hi, NULL, -1 FROM m),
q AS (SELECT *, sum(turn) OVER (PARTITION BY page_id ORDER BY pos) AS s, count(tag) OVER (PARTITION BY page_id ORDER BY pos) AS n FROM f),
x AS (SELECT a.page_id, a.n AS pre, a.tag, a.s AS s, a.turn, CASE a.turn WHEN 1 THEN (SELECT min_by(b.n, b.pos) FROM q b WHERE b.page_id = a.page_id AND b.turn = -1 AND b.pos > a.pos AND b.s = a.s - 1) ELSE a.n END AS last FROM q a WHERE a.turn >= 0),
a AS (SELECT d.page_id, d.pre, d.tag, d.last, c.pre AS ancestor, c.tag AS ancestor_tag, row_number() OVER (PARTITION BY d.page_id, d.pre ORDER BY c.pre DESC) AS up
      FROM x d JOIN x c ON c.page_id = d.page_id AND c.pre < d.pre AND d.pre <= c.last)
"""


def element_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of all elements, the closest first, with both tags."""
    found = trees.ancestors(page_nodes(spark, sf_dir), "page_id", carried=["tag"])
    return found.select("page_id", F.col("pre").alias("element"), "tag", "ancestor", "ancestor_tag", "up")


ANCESTORS_SQL = NODES_SQL + "SELECT page_id, pre AS element, tag, ancestor, ancestor_tag, up FROM a"


def own_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each scope holds of its own by tag: how many, and the first. A scope inside it is not looked into."""
    nodes = page_nodes(spark, sf_dir)
    held = trees.own(nodes, "page_id", F.col("tag").isin(SCOPES), ["tag", "parent"]).where(F.col("ancestor_tag").isin(SCOPES) | F.col("ancestor_parent").isNull())
    return held.groupBy("page_id", F.col("ancestor").alias("scope"), F.col("ancestor_tag").alias("scope_tag"), "tag").agg(F.count("*").alias("n"), F.min("pre").alias("first"))


OWN_SQL = NODES_SQL + """,
s AS (SELECT page_id, pre FROM x WHERE tag IN ('article', 'nav', 'footer', 'head')),
o AS (SELECT a.page_id, a.pre, a.tag, a.ancestor, a.ancestor_tag FROM a
      WHERE a.tag NOT IN ('article', 'nav', 'footer', 'head') AND NOT EXISTS (SELECT 1 FROM a b JOIN s ON s.page_id = b.page_id AND s.pre = b.ancestor WHERE b.page_id = a.page_id AND b.pre = a.pre AND b.ancestor > a.ancestor)
      UNION ALL SELECT page_id, pre, tag, pre, tag FROM x)
SELECT page_id, ancestor AS scope, ancestor_tag AS scope_tag, tag, count(*) AS n, min(pre) AS first FROM o
WHERE ancestor_tag IN ('article', 'nav', 'footer', 'head') OR NOT EXISTS (SELECT 1 FROM a WHERE a.page_id = o.page_id AND a.pre = o.ancestor) GROUP BY ALL
"""


def repeated_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest element that repeats each one: lists and articles, but what is in the first child of an article
    runs once, and a block ends the search unless it stands in the body itself."""
    nodes = page_nodes(spark, sf_dir)
    barrier = F.col("of_tag").isin(BARRIERS) & (F.col("of_level") > 3)
    loop = F.col("of_tag").isin(LOOPS) & ~((F.col("of_tag") == "article") & (F.col("slot") == 0))
    found = trees.nearest(nodes, "page_id", barrier | loop, F.struct(F.when(~barrier, F.col("parent")).alias("pre"), F.when(~barrier, F.col("of_tag")).alias("tag")), "loop")
    return found.where("loop.pre IS NOT NULL").select("page_id", F.col("pre").alias("element"), "tag", F.col("loop.pre").alias("loop"), F.col("loop.tag").alias("loop_tag"))


REPEATED_SQL = NODES_SQL + """,
d AS (SELECT a.*, lag(pre_child) OVER w AS child FROM (SELECT *, ancestor AS pre_child FROM a) a WINDOW w AS (PARTITION BY page_id, pre ORDER BY up)),
c AS (SELECT d.page_id, d.pre, d.tag, d.ancestor, d.ancestor_tag, d.up, coalesce(child, pre) AS child, (SELECT count(*) FROM a z WHERE z.page_id = d.page_id AND z.pre = d.ancestor) + 1 AS level FROM d),
h AS (SELECT *, ancestor_tag IN ('nav', 'div', 'footer') AND level > 3 AS barrier,
        ancestor_tag IN ('ul', 'article', 'body') AND NOT (ancestor_tag = 'article' AND child = ancestor + 1) AS loops FROM c),
b AS (SELECT page_id, pre, any_value(tag) AS tag, min_by(ancestor, up) AS loop, min_by(ancestor_tag, up) AS loop_tag, min_by(barrier, up) AS barrier FROM h WHERE barrier OR loops GROUP BY ALL)
SELECT page_id, pre AS element, tag, loop, loop_tag FROM b WHERE NOT barrier
"""


def subtree_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every element that has content: elements and links in it, whether all its children are list items
    with one link each (a table of entries), entries of such tables in it, and the deepest nesting of blocks."""
    nodes = page_nodes(spark, sf_dir)
    odd = ~(((F.col("tag") == "li") & (F.col("last") == F.col("pre") + 1)) | ((F.col("tag") == "a") & (F.col("last") == F.col("pre"))))
    rows = trees.subtree_sums(nodes, "page_id", {"elements": F.lit(1), "links": (F.col("tag") == "a").cast("int"), "_odd": odd.cast("int")})
    rows = rows.withColumn("is_table", (F.col("tag") == "ul") & (F.col("_odd") == 1) & (F.col("elements") > 1))
    rows = trees.subtree_sums(rows, "page_id", {"table_rows": F.when(F.col("is_table"), (F.col("elements") - 1) / 2).otherwise(0).cast("long")})
    block = ~F.col("tag").isin("a", "b", "br", "p")
    itself = nodes.where(block).select("page_id", "pre", F.col("pre").alias("ancestor"), F.lit(0).cast("long").alias("up"))
    depths = trees.deepest(nodes, "page_id", itself.unionByName(trees.ancestors(nodes, "page_id", asks=block)), block).select("page_id", F.col("ancestor").alias("pre"), "depth", F.col("node").alias("deepest"))
    kept = rows.where("last > pre").join(depths.hint("merge"), ["page_id", "pre"], "left")
    return kept.select("page_id", F.col("pre").alias("element"), "tag", "elements", "links", "is_table", "table_rows", F.coalesce("depth", F.lit(0)).alias("depth"), "deepest")


SUBTREE_SQL = NODES_SQL + """,
w AS (SELECT *, (tag = 'li' AND last = pre + 1) OR (tag = 'a' AND last = pre) AS entry, tag NOT IN ('a', 'b', 'br', 'p') AS block FROM x),
u AS (SELECT w.page_id, w.pre, w.tag, w.last, count(*) AS elements, count(*) FILTER (d.tag = 'a') AS links, w.tag = 'ul' AND bool_and(d.entry OR d.pre = w.pre) AND count(*) > 1 AS is_table
      FROM w JOIN w d ON d.page_id = w.page_id AND d.pre BETWEEN w.pre AND w.last WHERE w.last > w.pre GROUP BY w.page_id, w.pre, w.tag, w.last),
y AS (SELECT u.page_id, u.pre, coalesce(sum((d.elements - 1) // 2) FILTER (d.is_table), 0)::BIGINT AS table_rows FROM u JOIN u d ON d.page_id = u.page_id AND d.pre BETWEEN u.pre AND u.last GROUP BY ALL),
z AS (SELECT u.page_id, u.pre AS top, d.pre AS low, count(*) AS depth FROM u JOIN w d ON d.page_id = u.page_id AND d.pre BETWEEN u.pre AND u.last AND d.block
      JOIN w b ON b.page_id = u.page_id AND b.block AND b.pre BETWEEN u.pre AND d.pre AND d.pre <= b.last GROUP BY ALL),
t AS (SELECT page_id, top, max(depth) AS depth, min(low) FILTER (depth = most) AS deepest FROM (SELECT *, max(depth) OVER (PARTITION BY page_id, top) AS most FROM z) GROUP BY ALL)
SELECT u.page_id, u.pre AS element, u.tag, u.elements, u.links, u.is_table, y.table_rows, coalesce(t.depth, 0) AS depth, t.deepest
FROM u JOIN y USING (page_id, pre) LEFT JOIN t ON t.page_id = u.page_id AND t.top = u.pre
"""


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order follows the customer's one before it if that is at most 120 days old."""
    along = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    recent = F.col("o_orderdate") <= F.lag("o_orderdate").over(along) + F.expr("INTERVAL 120 DAYS")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(recent, F.lag("o_orderkey").over(along)).alias("before"))


def order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of orders: the first one and the place of each in its chain."""
    found = chains.chains(order_links(spark, sf_dir), "o_orderkey", "before")
    return found.select(F.col("node").alias("o_orderkey"), "root", "rank")


LINKS_SQL = """
WITH l AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, coalesce(o_orderdate > lag(o_orderdate) OVER w + INTERVAL 120 DAYS, true) AS starts FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
i AS (SELECT *, sum(starts::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS island FROM l),
c AS (SELECT o_orderkey, o_orderstatus, first(o_orderkey) OVER w AS root, row_number() OVER w - 1 AS rank FROM i WINDOW w AS (PARTITION BY o_custkey, island ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
"""
CHAINS_SQL = LINKS_SQL + "SELECT o_orderkey, root, rank FROM c"


def chain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names along each chain, from the root to its end."""
    links = order_links(spark, sf_dir)
    found = chains.chains(links, "o_orderkey", "before").join(links.select(F.col("o_orderkey").alias("node"), "o_orderstatus"), "node")
    along = F.array_sort(F.collect_list(F.struct("rank", "o_orderstatus")))
    return found.groupBy("root").agg(F.count("*").alias("length"), F.array_join(F.transform(along, lambda x: x["o_orderstatus"]), "->").alias("names"))


NAMES_SQL = LINKS_SQL + "SELECT root, count(*) AS length, string_agg(o_orderstatus, '->' ORDER BY rank) AS names FROM c GROUP BY root"


def exploded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as routines: a part is made of the parts at a half, a third and a seventh of its key, those at a half twice
    if it is odd; every 701st is made of itself. Totals of sizes over all levels."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    halves = F.expr("filter(array(p_partkey div 2, if(p_partkey % 2 = 1, p_partkey div 2, 0), p_partkey div 3, p_partkey div 7, if(p_partkey % 701 = 0, p_partkey, 0)), x -> x > 0)")
    calls = part.select(F.col("p_partkey").alias("caller"), F.explode(halves).alias("callee"))
    return chains.inlined_counts(part.select(F.col("p_partkey").alias("name"), F.col("p_size").cast("long").alias("n")), calls).select(F.col("name").alias("p_partkey"), "total")


EXPLODED_SQL = """
WITH RECURSIVE e AS (SELECT p_partkey AS a, unnest(list_filter([p_partkey // 2, CASE WHEN p_partkey % 2 = 1 THEN p_partkey // 2 ELSE 0 END, p_partkey // 3, p_partkey // 7], lambda x: x > 0)) AS b FROM part),
g AS (SELECT a, b, count(*) AS k FROM e GROUP BY ALL),
w(root, node, k) AS (SELECT p_partkey, p_partkey, 1::HUGEINT FROM part UNION ALL SELECT w.root, g.b, sum(w.k * g.k) FROM w JOIN g ON g.a = w.node GROUP BY w.root, g.b),
t AS (SELECT root, sum(k * p_size) AS total, bool_or(node > 0 AND node % 701 = 0) AS loops FROM w JOIN part ON p_partkey = node GROUP BY root)
SELECT root AS p_partkey, CASE WHEN NOT loops THEN total END::BIGINT AS total FROM t
"""


def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two revisions of each source and language: documents of even ids are gone, those of odd ids are new. What
    stands in for what: the same text, or one with at least as many sentences."""
    docs = table(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("doc_id").alias("id"), F.col("doc_id").alias("at"),
        F.sha2("text", 256).alias("hash"), F.least(F.lit(40), F.regexp_count("text", F.lit(r"\."))).cast("long").alias("strength"),
    )
    found = chains.replacements(docs.where("id % 2 = 0"), docs.where("id % 2 <> 0"), ["source", "lang"])
    return found.select("source", "lang", F.col("id").alias("doc_id"), F.col("by").alias("replaced_by"), "how")


#: Each waiting document of a group takes the first that is left, one after the other.
REPLACED_SQL = """
WITH RECURSIVE d AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, doc_id, sha256(text) AS h, least(40, coalesce(length(text) - length(replace(text, '.', '')), 0)) AS n FROM documents),
k AS (SELECT *, CASE WHEN h IS NOT NULL THEN row_number() OVER (PARTITION BY source, lang, h, doc_id % 2 ORDER BY doc_id) END AS k FROM d),
s AS (SELECT a.source, a.lang, a.doc_id, b.doc_id AS by_id FROM k a JOIN k b USING (source, lang, h, k) WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS i FROM d WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM s)),
p AS (SELECT source, lang, list({'id': doc_id, 'n': n} ORDER BY doc_id) AS pool FROM d WHERE doc_id % 2 <> 0 AND doc_id NOT IN (SELECT by_id FROM s) GROUP BY ALL),
w(source, lang, i, doc_id, took, pool) AS (
  SELECT source, lang, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, coalesce(pool, []) FROM (SELECT DISTINCT source, lang FROM r) LEFT JOIN p USING (source, lang)
  UNION ALL
  SELECT source, lang, i, doc_id, took, list_filter(pool, lambda x: took IS NULL OR x.id <> took) FROM (
    SELECT w.source, w.lang, r.i, r.doc_id, list_filter(w.pool, lambda x: x.n >= r.n)[1].id AS took, w.pool FROM w JOIN r ON r.source = w.source AND r.lang = w.lang AND r.i = w.i + 1))
SELECT source, lang, doc_id, by_id AS replaced_by, 'same' AS how FROM s
UNION ALL SELECT source, lang, doc_id, took, CASE WHEN took IS NULL THEN 'none' ELSE 'enough' END FROM w WHERE i > 0
"""


def guards_implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, clicks and errors of a user as guards on a place, purchases and signups as writes to it or to what it is
    read from."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int") % 3)
    kinds = F.array(*[F.lit(k) for k in IMPLIED])
    place = F.concat(F.when(F.col("event_type") == "view", "view").otherwise("click"), F.lit("["), F.col("k").cast("string"), F.lit("]"))
    guards = events.where("event_type IN ('view', 'click', 'error') AND k IS NOT NULL").select(
        "user_id", F.when(F.col("event_type") == "error", F.concat(place, F.lit("->id"))).otherwise(place).alias("subject"), F.col("event_id").alias("pos"),
        F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("kind"), F.when(F.col("value") > 50, "return").otherwise("throw").alias("outcome"),
    )
    target = F.when(F.col("event_type") == "signup", F.when(F.col("k") == 0, "click").otherwise("vie")).otherwise(F.concat(F.lit("click["), F.col("k").cast("string"), F.lit("]")))
    writes = events.where("event_type IN ('purchase', 'signup') AND k IS NOT NULL").select("user_id", target.alias("target"), F.col("event_id").alias("pos"))
    return chains.implied_guards(guards, writes, "user_id", IMPLIED)


GUARDS_SQL = """
WITH e AS (SELECT *, (props->>'$.k')::INT % 3 AS k FROM events),
g AS (SELECT user_id, event_id AS pos, CASE event_type WHEN 'view' THEN 'view[' || k || ']' WHEN 'click' THEN 'click[' || k || ']' ELSE 'click[' || k || ']->id' END AS subject,
        ['truthy', 'not-empty', 'not-null', 'is-null', 'falsy', 'empty'][event_id % 6 + 1] AS kind, CASE WHEN value > 50 THEN 'return' ELSE 'throw' END AS outcome
      FROM e WHERE event_type IN ('view', 'click', 'error') AND k IS NOT NULL),
w AS (SELECT user_id, event_id AS pos, CASE WHEN event_type = 'signup' THEN CASE k WHEN 0 THEN 'click' ELSE 'vie' END ELSE 'click[' || k || ']' END AS target FROM e WHERE event_type IN ('purchase', 'signup') AND k IS NOT NULL),
i AS (SELECT * FROM (VALUES ('truthy', ['truthy', 'not-empty', 'not-null']), ('not-empty', ['truthy', 'not-empty', 'not-null']), ('not-null', ['not-null']),
      ('is-null', ['is-null', 'falsy', 'empty']), ('falsy', ['falsy', 'empty']), ('empty', ['falsy', 'empty'])) t(kind, implied)),
h AS (SELECT b.user_id, b.subject, b.outcome, b.pos, b.kind, a.pos AS earlier, a.kind AS earlier_kind
      FROM g b JOIN i ON i.kind = b.kind JOIN g a ON a.user_id = b.user_id AND a.subject = b.subject AND a.outcome = b.outcome AND a.pos < b.pos AND list_contains(i.implied, a.kind)
      WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = b.user_id AND w.pos BETWEEN a.pos AND b.pos AND (w.target = b.subject OR starts_with(b.subject, w.target || '[') OR starts_with(b.subject, w.target || '->'))))
SELECT user_id, subject, outcome, pos, kind, earlier, earlier_kind FROM h QUALIFY row_number() OVER (PARTITION BY user_id, subject, outcome ORDER BY pos, earlier) = 1
"""

QUERIES = {
    "element_ancestors": (element_ancestors, ANCESTORS_SQL), "own_elements": (own_elements, OWN_SQL), "repeated_elements": (repeated_elements, REPEATED_SQL),
    "subtree_facts": (subtree_facts, SUBTREE_SQL), "order_chains": (order_chains, CHAINS_SQL), "chain_names": (chain_names, NAMES_SQL),
    "exploded_parts": (exploded_parts, EXPLODED_SQL), "replaced_documents": (replaced_documents, REPLACED_SQL), "guards_implied": (guards_implied, GUARDS_SQL),
}
