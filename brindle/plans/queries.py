"""Queries over the supplied tables, each an analogue of one operator.

The tables hold no source code, so each query adapts a table to the operator's schema: labelled documents
or error events stand for findings, orders and lines for files and ranges, dialogues for inheritance.
All read their whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.functions.findings import identity, occurrence_key, severity_rank, tier
from brindle.functions.text import base_name, camel_words, code_lines
from brindle.operators import graphs, places, revisions, risk, scoring, structure
from brindle.session import checkpoint_dir, table


def label_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings: documents labelled toxic (high) or of low quality (medium)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rule = F.explode(F.array_compact(F.array(F.when(F.col("toxic") == 1, F.lit("TOXIC")), F.when(F.col("quality") == 0, F.lit("LOWQ")))))
    rows = docs.join(labels, "doc_id").select("source", "doc_id", "n_chars", rule.alias("rule"))
    return rows.select(
        "source", "rule", F.when(F.col("rule") == "TOXIC", "high").otherwise("medium").alias("severity"),
        (60 + F.col("doc_id") % 40).cast("int").alias("confidence"), F.col("doc_id").cast("string").alias("path"),
        (1 + F.col("doc_id") % 7).alias("line"), (1 + F.col("doc_id") % 7 + F.expr("n_chars div 160")).alias("end_line"),
    )


def score_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.greatest(F.lit(1), F.expr("n_chars div 80"))).alias("lines"))
    found = scoring.score(label_findings(spark, sf_dir), lines, ["source"])
    return found.select("source", "score", "band", F.round("penalty", 6).alias("penalty"), F.round("density", 6).alias("density"))


SCORE_SQL = """
WITH f AS (
  SELECT source, rule, CASE rule WHEN 'TOXIC' THEN 10.0 ELSE 4.0 END * (60 + doc_id % 40) / 100.0 AS p, doc_id,
         1 + doc_id % 7 AS s, 1 + doc_id % 7 + n_chars // 160 AS e
  FROM (SELECT d.*, unnest(list_filter([CASE WHEN toxic = 1 THEN 'TOXIC' END, CASE WHEN quality = 0 THEN 'LOWQ' END], lambda x: x IS NOT NULL)) AS rule
        FROM documents d JOIN labels USING (doc_id))),
l AS (SELECT source, sum(greatest(1, n_chars // 80))::DOUBLE AS lines FROM documents GROUP BY source),
c AS (SELECT source, sum(n) AS covered FROM (SELECT DISTINCT source, doc_id, e - s + 1 AS n FROM f) GROUP BY source),
u AS (SELECT l.source, greatest(1.0, lines / 1000) AS units, CASE WHEN lines > 0 THEN least(1.0, coalesce(covered, 0) / lines) ELSE 0 END AS share FROM l LEFT JOIN c USING (source)),
r AS (SELECT source, rule, sum(p)::DOUBLE AS p FROM f GROUP BY ALL),
t AS (SELECT u.source, sum(30 * (1 - exp(-(coalesce(p, 0) / units * (1 + share)) / 30))) AS d, coalesce(sum(p), 0) AS penalty, max(units) AS units
      FROM u LEFT JOIN r USING (source) GROUP BY u.source),
v AS (SELECT *, round(100 - least(100.0, d))::INT AS score FROM t)
SELECT source, score, CASE WHEN score >= 90 THEN 'clean' WHEN score >= 75 THEN 'healthy' WHEN score >= 60 THEN 'needs_attention' WHEN score >= 40 THEN 'poor' ELSE 'severe' END AS band,
       round(penalty, 6) AS penalty, round(penalty / units, 6) AS density
FROM v
"""


def affected_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), (F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("end_line"))
    return scoring.covered_lines(rows, ["l_orderkey"])


UNION_SQL = """
SELECT l_orderkey, count(DISTINCT n)::BIGINT AS covered
FROM (SELECT l_orderkey, unnest(range(l_linenumber, l_linenumber + l_quantity::BIGINT + 1)) AS n FROM lineitem) GROUP BY l_orderkey
"""


def dup_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    return structure.equal_groups(bodies, "hash")


DUP_SQL = "SELECT sha256(text) AS hash, count(*)::BIGINT AS members, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2"


def drift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names that drift from each other, letter by letter; every pair within the budget is compared."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("name"))
    bodies = names.select("id", F.split("name", "").alias("tokens"), F.sha2("name", 256).alias("hash"))
    return structure.drift_pairs(bodies, budget=2, ratio=0.1, most=None)[0].select("id_a", "id_b", "distance")


DRIFT_SQL = """
WITH s AS (SELECT s_suppkey AS id, lower(s_name) AS w FROM supplier),
p AS (SELECT a.id AS x, b.id AS y, length(a.w) AS nx, length(b.w) AS ny, levenshtein(a.w, b.w) AS d
      FROM s a JOIN s b ON (length(a.w), a.id) < (length(b.w), b.id) AND length(b.w) - length(a.w) <= 2 AND a.w <> b.w)
SELECT x AS id_a, y AS id_b, d::INT AS distance FROM p WHERE d BETWEEN 1 AND 2 AND d / greatest(1, least(nx, ny)) <= 0.1
"""


def masked_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd lines: documents that begin with the same line and have as many are a family; a line of which one member
    alone has its own version, where all others agree."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    family = F.concat_ws(":", F.size("lines").cast("string"), F.sha2(F.get("lines", F.lit(0)), 256))
    values = F.transform("lines", lambda x: F.sha2(x, 256))  # lines may be long
    return structure.masked_minority(docs.select(family.alias("family"), F.col("doc_id").alias("id"), values.alias("values")), "family", "id", "values")


MASKED_SQL = """
WITH b AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
f AS (SELECT id, len(l)::VARCHAR || ':' || sha256(l[1]) AS family, l FROM b),
v AS (SELECT family, id, unnest(range(len(l))) AS place, sha256(unnest(l)) AS value FROM f),
k AS (SELECT family FROM f GROUP BY family HAVING count(*) >= 3),
c AS (SELECT family, place, value, count(*) AS n, min(id) AS id FROM v JOIN k USING (family) GROUP BY ALL),
g AS (SELECT family, place FROM c GROUP BY ALL HAVING count(*) = 2 AND min(n) = 1 AND max(n) > 1)
SELECT family, place::INT AS place, few.id, few.value AS minority, many.value AS majority
FROM g JOIN c few USING (family, place) JOIN c many USING (family, place) WHERE few.n = 1 AND many.n > 1
"""


def placeholder_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pattern = r"(?i)\b(TODO|FIXME|lorem|license|licensed)\b"
    return docs.where(F.col("text").rlike(pattern)).select("doc_id", F.regexp_count("text", F.lit(pattern)).alias("hits"), code_lines(F.col("text")).alias("code_lines"))


PLACEHOLDER_SQL = r"""
SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(TODO|FIXME|lorem|license|licensed)\b'))::INT AS hits,
       len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t\r\f\x0B\x00]*($|//|#|\*|/\*)')))::BIGINT AS code_lines
FROM documents WHERE regexp_matches(text, '(?i)\b(TODO|FIXME|lorem|license|licensed)\b')
"""


def _order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("rule"), (F.col("o_custkey") % 50).cast("string").alias("fingerprint"),
        F.concat(F.lit("f"), (F.col("o_custkey") % 97).cast("string")).alias("path"), (F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")).alias("old"),
    ).withColumn("identity", identity(F.col("rule"), F.col("path"), F.col("fingerprint")))


def _baseline(spark: SparkSession, sf_dir: str):
    rows = _order_findings(spark, sf_dir)
    now = rows.where("NOT old").drop("old")
    entries = rows.where("old").groupBy(F.col("identity").alias("id"), "rule", "fingerprint", "path").agg(F.expr("(count(*) + 1) div 2").alias("count"))
    present = now.where("cast(substring(path, 2) as int) % 3 <> 0").select("path").distinct()
    return revisions.match_baseline(now, entries, present, ["seq"])


def baseline_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(spark, sf_dir)[0].select("seq", "identity", "accepted")


def baseline_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(spark, sf_dir)[1].select("id", "count", "used")


BASELINE_CTE = """
WITH o AS (SELECT o_orderkey AS seq, o_orderstatus AS rule, (o_custkey % 50)::VARCHAR AS fingerprint, 'f' || (o_custkey % 97)::VARCHAR AS path, o_orderdate < TIMESTAMP '1995-06-01' AS old FROM orders),
r AS (SELECT *, substr(sha256(rule || chr(0) || path || chr(0) || fingerprint), 1, 16) AS identity FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY seq) AS k FROM r WHERE NOT old),
b AS (SELECT identity AS id, rule, fingerprint, path, ((count(*) + 1) // 2)::BIGINT AS count FROM r WHERE old GROUP BY ALL),
p AS (SELECT DISTINCT path FROM n WHERE substr(path, 2)::INT % 3 <> 0),
m AS (SELECT n.*, coalesce(k <= b.count, false) AS exact FROM n LEFT JOIN b ON b.id = n.identity),
t AS (SELECT b.*, count(m.seq) FILTER (m.exact) AS taken FROM b LEFT JOIN m ON m.identity = b.id GROUP BY ALL),
e AS (SELECT t.*, CASE WHEN p.path IS NULL THEN count - taken ELSE 0 END AS room FROM t LEFT JOIN p USING (path)),
q AS (SELECT rule, fingerprint, sum(room) AS room FROM e GROUP BY ALL),
u AS (SELECT m.*, row_number() OVER (PARTITION BY rule, fingerprint ORDER BY seq) AS j FROM m WHERE NOT exact),
w AS (SELECT u.*, coalesce(j <= q.room, false) AS accepted FROM u LEFT JOIN q USING (rule, fingerprint))
"""
BASELINE_SQL = BASELINE_CTE + "SELECT seq, identity, true AS accepted FROM m WHERE exact UNION ALL SELECT seq, identity, accepted FROM w"
USED_SQL = BASELINE_CTE + """, a AS (SELECT rule, fingerprint, count(*) AS asked FROM w WHERE accepted GROUP BY ALL),
x AS (SELECT e.*, coalesce(asked, 0) AS asked, coalesce(sum(room) OVER (PARTITION BY rule, fingerprint ORDER BY path, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e LEFT JOIN a USING (rule, fingerprint))
SELECT id, count, (taken + greatest(0, least(room, asked - before)))::BIGINT AS used FROM x"""


def diff_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("identity"), (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("old"))
    return revisions.partition(events.where("NOT old").drop("old"), events.where("old").drop("old"), "identity", ["event_id"])


DIFF_SQL = """
WITH e AS (SELECT event_id, user_id::VARCHAR || ':' || event_type AS identity, ts < TIMESTAMP '2024-01-15' AS old,
                  row_number() OVER (PARTITION BY user_id, event_type, ts < TIMESTAMP '2024-01-15' ORDER BY event_id) AS k,
                  count(*) FILTER (ts < TIMESTAMP '2024-01-15') OVER (PARTITION BY user_id, event_type) AS before,
                  count(*) FILTER (ts >= TIMESTAMP '2024-01-15') OVER (PARTITION BY user_id, event_type) AS after FROM events)
SELECT identity, event_id, CASE WHEN old THEN 'resolved' WHEN k <= before THEN 'existing' ELSE 'new' END AS state FROM e WHERE NOT old OR k > after
"""


def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage count: distinct orders that name a part; parts that none names have 0."""
    used = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n"))
    return table(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("blast_radius"))


BLAST_SQL = "SELECT p_partkey, count(DISTINCT l_orderkey)::BIGINT AS blast_radius FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1"


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blast = blast_radius(spark, sf_dir).select(F.col("p_partkey").alias("subject"), "blast_radius")
    severity = F.when(F.col("p_size") > 40, "critical").when(F.col("p_size") > 25, "high").when(F.col("p_size") > 10, "medium").otherwise("low")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("subject"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("line"), F.col("p_type").alias("rule"), severity.alias("severity"),
        (50 + F.col("p_partkey") % 46).alias("confidence"), (F.col("p_partkey") % 2 == 0).alias("is_new"), (F.col("p_partkey") % 3 == 0).alias("in_hunk"),
    )
    ratio = rows.groupBy("path").agg((F.count("*") % 100 / 100).alias("ratio")).where("substring(path, 7, 1) <> '1'")
    churn = rows.groupBy("path").agg((F.count("*") % 50).cast("int").alias("changes")).where("substring(path, 7, 1) <> '2'")
    return risk.with_risk(rows, blast, ratio, churn)


def risk_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading list: the twenty riskiest findings."""
    rows = _risks(spark, sf_dir).withColumn("risk", F.round("risk", 6))
    return risk.top(rows, 20).select("path", "line", "rule", "severity", "risk")


def risk_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.by_file(_risks(spark, sf_dir)).select("path", F.round("risk", 4).alias("risk"), "n_findings")


RISK_CTE = """
WITH b AS (SELECT p_partkey, count(DISTINCT l_orderkey) AS blast FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1),
n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1),
f AS (SELECT p_brand AS path, p_partkey AS line, p_type AS rule, CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 25 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END AS severity,
             CASE WHEN p_size > 40 THEN 20 WHEN p_size > 25 THEN 10 WHEN p_size > 10 THEN 4 ELSE 1.5 END::DOUBLE * (50 + p_partkey % 46) / 100
             * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0.25 END::DOUBLE * CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0.3 END::DOUBLE * (1 + log10(1 + blast))
             * CASE WHEN substr(p_brand, 7, 1) <> '1' THEN 1 + (1 - (n % 100) / 100) * 0.5::DOUBLE ELSE 1 END
             * (1 + log10(1 + CASE WHEN substr(p_brand, 7, 1) <> '2' THEN n % 50 ELSE 0 END) * 0.5::DOUBLE) AS risk
      FROM part JOIN b USING (p_partkey) JOIN n USING (p_brand))
"""
RISK_SQL = RISK_CTE + "SELECT path, line, rule, severity, round(risk, 6) AS risk FROM f ORDER BY round(risk, 6) DESC, path, line, rule LIMIT 20"
RISK_FILE_SQL = RISK_CTE + "SELECT path, round(sum(risk), 4) AS risk, count(*)::BIGINT AS n_findings FROM f GROUP BY path"


def dead_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    return graphs.unused(orders, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), on=["key"])


DEAD_SQL = "SELECT o_orderkey AS key, o_orderstatus FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey"


def missing_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return graphs.unused(docs, table(spark, sf_dir, "labels").select("doc_id"), on=["doc_id"])


MISSING_SQL = "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)"


def layer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between regions by who orders from whom; other regions are forbidden."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    of = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyer = table(spark, sf_dir, "customer").join(F.broadcast(of), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("source_role"))
    seller = table(spark, sf_dir, "supplier").join(F.broadcast(of), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("target_role"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = lines.join(buyer, F.col("o_custkey") == F.col("c_custkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
    return graphs.edge_counts(edges, "source_role", "target_role", F.col("source_role") == F.col("target_role"), "o_orderkey")


LAYER_SQL = """
SELECT a.r_name AS source_role, b.r_name AS target_role, count(*)::BIGINT AS n, sum((a.r_name <> b.r_name)::INT)::BIGINT AS n_forbidden, min(o_orderkey) AS example
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation x ON c_nationkey = x.n_nationkey JOIN region a ON x.n_regionkey = a.r_regionkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation y ON s_nationkey = y.n_nationkey JOIN region b ON y.n_regionkey = b.r_regionkey GROUP BY ALL
"""

ROLES = [("steel", ["*STEEL"]), ("promo", ["PROMO*"]), ("plated", ["*PLATED*", "*BRUSHED*"]), ("copper", ["*COPPER"])]


def role_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.upper("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", graphs.first_role(kind, ROLES, "none").alias("role"), F.size(graphs.all_roles(kind, ROLES)).alias("n_roles"))


ROLE_SQL = """
WITH p AS (SELECT p_partkey, upper(p_type) AS t FROM part)
SELECT p_partkey, CASE WHEN t LIKE '%STEEL' THEN 'steel' WHEN t LIKE 'PROMO%' THEN 'promo' WHEN t LIKE '%PLATED%' OR t LIKE '%BRUSHED%' THEN 'plated' WHEN t LIKE '%COPPER' THEN 'copper' ELSE 'none' END AS role,
       ((t LIKE '%STEEL')::INT + (t LIKE 'PROMO%')::INT + (t LIKE '%PLATED%' OR t LIKE '%BRUSHED%')::INT + (t LIKE '%COPPER')::INT) AS n_roles FROM p
"""


def closure_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of turns: each turn's parent is the turn before it."""
    checkpoint_dir(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    edges = turns.alias("a").join(turns.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") == F.col("b.turn") + 1))
    name = lambda x: F.concat_ws(":", F.col(f"{x}.conv_id").cast("string"), F.col(f"{x}.turn").cast("string"))
    found = graphs.closure(edges.select(name("a").alias("child"), name("b").alias("parent")), "child", "parent")
    return found.groupBy("child").agg(F.count("*").alias("ancestors"), F.max("depth").cast("long").alias("depth"))


CLOSURE_SQL = """
WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations),
c AS (SELECT a.conv_id, a.turn, b.turn AS up, 1::BIGINT AS depth FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1
      UNION ALL SELECT c.conv_id, c.turn, b.turn, c.depth + 1 FROM c JOIN t b ON c.conv_id = b.conv_id AND c.up = b.turn + 1)
SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS child, count(*)::BIGINT AS ancestors, max(depth)::BIGINT AS depth FROM c GROUP BY ALL
"""


def asof_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before each purchase: the value of the user's latest click."""
    events = table(spark, sf_dir, "events")
    found = places.latest_before(events, ["user_id"], ["ts", "event_id"], "value", F.col("event_type") == "click", "last_click")
    return found.where("event_type = 'purchase'").select("event_id", "user_id", "last_click")


ASOF_SQL = """
SELECT event_id, user_id, last_click FROM (
  SELECT *, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM events)
WHERE event_type = 'purchase'
"""


def occurrence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("identity", identity(F.col("event_type"), F.col("user_id").cast("string"), F.lit("")))
    found = risk.ordinals(events, "identity", ["event_id"])
    return found.select("event_id", occurrence_key(F.col("identity"), F.col("ordinal")).alias("key"))


OCCURRENCE_SQL = """
WITH e AS (SELECT event_id, substr(sha256(event_type || chr(0) || user_id::VARCHAR || chr(0)), 1, 16) AS i FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY event_id) AS n FROM e)
SELECT event_id, CASE WHEN n = 1 THEN i ELSE substr(sha256(i || chr(0) || n::VARCHAR), 1, 16) END AS key FROM o
"""


def counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.counts_filled(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), "status", ["F", "O", "P", "X"]).select("status", "n")


COUNTS_SQL = "SELECT status, count(o_orderkey)::BIGINT AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS status) LEFT JOIN orders ON o_orderstatus = status GROUP BY 1"


def hunk_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order that lie within one of its changed ranges."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))
    hunks = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.array(F.struct((1 + F.col("o_orderkey") % 3).alias("start"), (F.col("o_orderkey") % 2).alias("n")), F.struct(F.lit(5).cast("long").alias("start"), F.lit(2).cast("long").alias("n"))).alias("hunks"),
    )
    return lines.join(hunks, "l_orderkey").groupBy("l_orderkey").agg(F.sum(F.when(places.in_hunk(F.col("hunks"), F.col("line")), 1).otherwise(0)).alias("inside"))


HUNK_SQL = """
SELECT l_orderkey, sum(((l_orderkey % 2 > 0 AND l_linenumber BETWEEN 1 + l_orderkey % 3 AND l_orderkey % 3 + l_orderkey % 2) OR l_linenumber BETWEEN 5 AND 6)::INT)::BIGINT AS inside
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
"""


def innermost_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest order period of a customer that holds each order's date."""
    day = lambda c: F.datediff(F.to_date(c), F.lit("1990-01-01").cast("date")).cast("long")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day(F.col("o_orderdate")).alias("day"))
    spans = orders.select("o_custkey", F.col("o_orderkey").alias("span"), F.col("day").alias("start"), (F.col("day") + 30 + F.col("o_orderkey") % 300).alias("end"))
    return places.innermost(orders, spans, "o_custkey", "day", "start", "end", ["o_orderkey"], "span", 256).select("o_orderkey", "span")


INNER_SQL = """
WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS d FROM orders),
s AS (SELECT o_custkey, o_orderkey AS span, d AS a, d + 30 + o_orderkey % 300 AS b FROM o)
SELECT o_orderkey, arg_min(span, (b - a, span)) AS span FROM o JOIN s USING (o_custkey) WHERE d BETWEEN a AND b GROUP BY 1
"""


def vote_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that several size signals mark."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("top"), F.countDistinct("o_orderpriority").alias("kinds"))
    fires, confidence = graphs.vote([F.col("n") > 12, F.col("total") > 2_000_000, F.col("top") > 400_000, F.col("kinds") >= 5], 2, 58, 9, 96)
    return orders.where(fires).select("o_custkey", confidence.alias("confidence"))


VOTE_SQL = """
WITH c AS (SELECT o_custkey, (count(*) > 12)::INT + (sum(o_totalprice) > 2000000)::INT + (max(o_totalprice) > 400000)::INT + (count(DISTINCT o_orderpriority) >= 5)::INT AS n FROM orders GROUP BY 1)
SELECT o_custkey, least(96, 58 + n * 9)::INT AS confidence FROM c WHERE n >= 2
"""


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", half.alias("old")).agg(
        F.count("*").alias("assertions"), (F.max("value") > 99).alias("skipped"), F.sum(F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)).alias("looped")
    )


def test_weakened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two revisions of tests: events of a user and type in the first and second half of the month."""
    rows = _tests(spark, sf_dir)
    return revisions.weakened(rows.where("old"), rows.where("NOT old"), ["user_id", "event_type"])


def weakened_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tests(spark, sf_dir)
    return revisions.weakened_tests(rows.where("old"), rows.where("NOT old"), ["user_id", "event_type"])


WEAKENED_SQL = """
WITH r AS (SELECT user_id, event_type, ts < TIMESTAMP '2024-01-16' AS old, count(*)::BIGINT AS n, max(value) > 99 AS skipped, sum((event_id % 5 = 0)::INT)::BIGINT AS looped FROM events GROUP BY ALL),
j AS (SELECT user_id, event_type, a.n AS old_n, b.n AS assertions,
             CASE WHEN b.n IS NULL THEN 'deleted' WHEN a.n IS NULL THEN NULL WHEN b.skipped AND NOT a.skipped THEN 'skipped' WHEN b.n < a.n AND b.looped <= a.looped THEN 'fewer assertions' END AS kind
      FROM (FROM r WHERE old) a FULL JOIN (FROM r WHERE NOT old) b USING (user_id, event_type))
SELECT user_id, event_type, kind, old_n, assertions FROM j WHERE kind IS NOT NULL
"""


WEAKENED_FINDINGS_SQL = f"""
SELECT 'SL503' AS rule, CASE kind WHEN 'deleted' THEN 'medium' ELSE 'high' END AS severity, CASE kind WHEN 'deleted' THEN 60 WHEN 'skipped' THEN 90 ELSE 85 END::INT AS confidence, user_id, event_type, kind
FROM ({WEAKENED_SQL})
"""


def repeated_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views after an equal view by the user with no purchase between the two."""
    events = table(spark, sf_dir, "events").select("user_id", F.lit("s").alias("subject"), "event_id", "event_type")
    keep = lambda kind: events.where(F.col("event_type") == kind).drop("event_type")
    return places.repeated_guards(keep("view"), keep("purchase"), "user_id", "subject", "event_id").select("user_id", "event_id", "earlier")


GUARD_SQL = """
SELECT user_id, event_id, earlier FROM (
  SELECT *, lag(event_type) OVER w AS last, lag(event_id) OVER w AS earlier FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
WHERE event_type = 'view' AND last = 'view'
"""


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of adjacent ranges of a part's lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("b")).distinct()
    return places.runs(rows, "l_partkey", "a", "b").groupBy("l_partkey").agg(F.max("run").alias("runs"))


RUNS_SQL = """
WITH r AS (SELECT DISTINCT l_partkey, l_orderkey * 10 + l_linenumber AS a, l_orderkey * 10 + l_linenumber + l_quantity::BIGINT AS b FROM lineitem)
SELECT l_partkey, sum(f)::BIGINT AS runs FROM (SELECT l_partkey, (a > coalesce(lag(b) OVER (PARTITION BY l_partkey ORDER BY a, b), -2) + 1)::INT AS f FROM r) GROUP BY 1
"""


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with more errors in the second half of the month than in the first."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    count = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"))
    return revisions.grown(count(errors.where(~half)), count(errors.where(half)), "user_id", "n")


GROWTH_SQL = """
SELECT user_id, (count(*) FILTER (ts >= TIMESTAMP '2024-01-16') - count(*) FILTER (ts < TIMESTAMP '2024-01-16'))::BIGINT AS growth
FROM events WHERE event_type = 'error' GROUP BY 1 HAVING growth > 0
"""


def tiers_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier, severity rank and words of each event type's rule."""
    category = F.when(F.col("event_type") == "error", "error-handling").when(F.col("event_type") == "click", "architecture").otherwise("naming")
    rows = table(spark, sf_dir, "events").select(category.alias("category"), F.concat(F.lit("App\\Rules\\on"), F.initcap("event_type")).alias("rule"), F.when(F.col("value") > 50, "high").otherwise("low").alias("severity"))
    return rows.groupBy(tier(F.col("category")).alias("tier"), severity_rank(F.col("severity")).alias("rank"), camel_words(base_name(F.col("rule"))).alias("words")).agg(F.count("*").alias("n"))


TIERS_SQL = """
SELECT CASE event_type WHEN 'error' THEN 'defect' WHEN 'click' THEN 'advisory' ELSE 'maintainability' END AS tier, CASE WHEN value > 50 THEN 1 ELSE 3 END::INT AS rank,
       'on ' || event_type AS words, count(*)::BIGINT AS n FROM events GROUP BY ALL
"""
