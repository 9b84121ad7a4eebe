"""Merkle manifest of a dataset: windows over (group, parent index) build the levels of ternary trees.

A row's leaf is the hash of its fields. The leaves of a source stand in the order of their ids; every run of three
consecutive nodes becomes its parent until one is left, the source's subroot. The subroots, in the order of the
sources, are the leaves of one more tree, whose root stands for the dataset. A proof is what stands beside a leaf's
ancestors, level by level; folding it with a leaf gives the root if and only if nothing of the row has changed.

A level is one window over runs: the ordered full-frame list of a run is the preimage of the parent and holds the
siblings, too. The first node of a run stands for the parent in the next level, which so has a third of the rows.
Levels are written to the shared folder, so a lost executor repeats work of one level only. Proofs then grow
downwards: each level joins its parents' proofs by (group, parent), keys of three rows at most. No source is
gathered in one task: places come from a range sort and one count a (partition, source); the driver sees one number,
the size of the largest source, and the root.

Defined results: a null field is hashed as ``-`` and so differs from an empty one; null ids come first, rows alike
in source and id stand in the order of their leaves, repeated rows are leaves of their own; a null id counts as the
empty string where its crc decides on tampering; a null source is a group of its own, the first. Texts are hashed
whole. An empty table gives no rows. Columns other than the five hashed ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from brindle.llm.common import documents, remainder, staged
from brindle.llm.order import numbered

#: The hashed fields, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node.
ARITY = 3


def preimage(value: Column) -> Column:
    """``-`` for a null, else the count of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[preimage(f) for f in fields]), 256)


def level(nodes: DataFrame) -> DataFrame:
    """(group, idx, n, hash, ...) -> what stands left and right of each node in its run, and the parent's hash."""
    run = Window.partitionBy("group", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = (F.col("idx") % ARITY).cast("int")
    rows = nodes.withColumn("parent", F.expr(f"idx div {ARITY}")).withColumn("run", F.collect_list("hash").over(run))
    beside = [F.array_join(F.slice("run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("run", at + 2, F.lit(ARITY)), "").alias("right")]
    above = [F.sha2(F.array_join("run", ""), 256).alias("up"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n_up")]
    return rows.select(*nodes.columns, "parent", *beside, *above)


def climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels (nodes that have a parent), each written, and the roots by level (group, hash).

    Nodes of level k: ``nodes`` for 0, else the parents of level k - 1.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], [nodes.where("n = 1").select("group", "hash")]
    while most > 1:
        levels.append(staged(level(nodes.where("n > 1")), f"{name}-level"))
        nodes = levels[-1].where(F.col("idx") % ARITY == 0).select("group", F.col("parent").alias("idx"), F.col("n_up").alias("n"), F.col("up").alias("hash"))
        roots.append(nodes.where("n = 1").select("group", "hash"))
        most = -(-most // ARITY)
    return levels, roots


def descend(levels: list[DataFrame], roots: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of level 0 with ``path``, the steps from a node to the root of ``tops`` (group, subroot, path).

    A root's own path comes from ``tops``; below, each node's step goes before the path of its parent.
    """

    def at_roots(k: int, rows: DataFrame) -> DataFrame:
        return rows.join(tops, "group") if k == 0 else roots[k].select("group").join(tops, "group").withColumn("idx", F.lit(0).cast("long"))

    step = F.struct(F.col("left"), F.col("right"))
    paths = at_roots(len(levels), roots[-1]) if levels else None
    for k in range(len(levels) - 1, -1, -1):
        above = paths.select("group", F.col("idx").alias("parent"), "subroot", F.col("path").alias("_above"))
        held = levels[k].join(above, ["group", "parent"]).withColumn("path", F.concat(F.array(step), "_above"))
        paths = held if k == 0 else held.select("group", "idx", "subroot", "path").unionByName(at_roots(k, roots[k]).select("group", "idx", "subroot", "path"))
    return paths


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and a proof's steps give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level from the leaf, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, changed: Column | None = None) -> tuple[DataFrame, str | None]:
    """(rows, root). Rows: doc_id, leaf, ``changed_leaf``, subroot, path.

    ``changed``: a text that takes the place of ``text`` in ``changed_leaf``, null where nothing changes.
    """
    others = [F.col(c) for c in FIELDS[:-1]]
    text = F.lit(None).cast("string") if changed is None else changed
    fields = docs.select("doc_id", "source", leaf(*others, F.col("text")).alias("hash"), F.when(text.isNotNull(), leaf(*others, text)).alias("changed_leaf"))
    leaves = staged(fields.withColumn("group", preimage(F.col("source"))), "leaves")  # narrow: the text is read once
    nodes = staged(numbered(leaves, ["group"], ["doc_id", "hash", "changed_leaf"], "leaves"), "nodes")
    levels, roots = climb(nodes, "source")
    subroots = reduce(DataFrame.unionByName, roots)
    named = subroots.join(nodes.where("idx = 0").select("group", "source"), "group").select(F.col("group").alias("of"), "source", "hash", F.lit("").alias("group"))
    tree = staged(numbered(staged(named, "subroots"), ["group"], ["source"], "subroots"), "sources")
    upper, tops = climb(tree, "dataset")
    root = reduce(DataFrame.unionByName, tops).first()
    if root is None:
        return nodes.select("doc_id", F.col("hash").alias("leaf"), "changed_leaf", F.col("hash").alias("subroot"), F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))).alias("path")), None
    ends = tree.where("n = 1").select("group").distinct() if not upper else tops[-1].select("group")
    empty = F.expr("CAST(array() AS array<struct<left:string,right:string>>)")
    ends = ends.select("group", F.lit(root["hash"]).alias("subroot"), empty.alias("path"))
    over = (descend(upper, tops, ends) if upper else tree.join(ends, "group")).select(F.col("of").alias("group"), F.col("hash").alias("subroot"), "path")
    over = staged(over, "tops")
    columns = ["doc_id", F.col("hash").alias("leaf"), "changed_leaf", "subroot", "path"]
    rows = nodes.where("n = 1").join(over, "group").select(*columns)
    return (descend(levels, roots, over).select(*columns).unionByName(rows) if levels else rows), root["hash"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of all documents, and what a proof says of a row that lost its line feeds."""
    docs = documents(spark, sf_dir)
    tampered = F.when((remainder(F.col("doc_id"), 2) == 0) & F.contains("text", F.lit("\n")), F.replace("text", F.lit("\n"), F.lit("")))
    rows, root = manifest(docs, tampered)
    folded = fold(F.coalesce("changed_leaf", "leaf"), F.col("path"))
    named = rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return named.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of an id's digits, bit by bit; levels by recursion; proofs by joining each leaf with its ancestors' runs.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, * FROM documents),
e AS (SELECT r, doc_id, source, text, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
        coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
        list_reduce(list_prepend(4294967295, list_transform(list_filter(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)),
          lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc FROM d),
h AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS other FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS size FROM h),
up(source, k, i, size, hash) AS (
  SELECT source, 0, i, size, leaf FROM n
  UNION ALL SELECT source, any_value(k) + 1, i // 3, any_value((size + 2) // 3), sha256(string_agg(hash, '' ORDER BY i)) FROM up WHERE size > 1 GROUP BY source, k, i // 3),
s AS (SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS size FROM up WHERE size = 1),
top(k, i, size, hash) AS (
  SELECT 0, i, size, hash FROM s
  UNION ALL SELECT any_value(k) + 1, i // 3, any_value((size + 2) // 3), sha256(string_agg(hash, '' ORDER BY i)) FROM top WHERE size > 1 GROUP BY k, i // 3),
t AS (SELECT source, 0 AS tree, k, i, (hash) AS hash, i // 3 AS parent FROM up WHERE size > 1 UNION ALL SELECT NULL, 1, k, i, hash, i // 3 FROM top WHERE size > 1),
b AS (SELECT a.source, a.tree, a.k, a.i, coalesce(string_agg(o.hash, '' ORDER BY o.i) FILTER (o.i < a.i), '') AS l, coalesce(string_agg(o.hash, '' ORDER BY o.i) FILTER (o.i > a.i), '') AS x
      FROM t a JOIN t o ON a.source IS NOT DISTINCT FROM o.source AND a.tree = o.tree AND a.k = o.k AND a.parent = o.parent GROUP BY ALL),
p AS (SELECT n.r, row_number() OVER (PARTITION BY n.r ORDER BY b.tree, b.k) AS step, b.l, b.x
      FROM n JOIN s ON n.source IS NOT DISTINCT FROM s.source
      JOIN b ON CASE b.tree WHEN 0 THEN b.source IS NOT DISTINCT FROM n.source AND b.i = n.i // (3 ** b.k)::BIGINT ELSE b.i = s.i // (3 ** b.k)::BIGINT END),
f(r, step, hash) AS (SELECT r, 0, other FROM n UNION ALL SELECT f.r, p.step, sha256(p.l || f.hash || p.x) FROM f JOIN p ON p.r = f.r AND p.step = f.step + 1),
z AS (SELECT r, sha256(coalesce(string_agg(l || x, '' ORDER BY step), '')) AS proof FROM p GROUP BY r),
g AS (SELECT r, max_by(hash, step) AS folded FROM f GROUP BY r)
SELECT n.doc_id, n.leaf, s.hash AS subroot, (SELECT hash FROM top WHERE size = 1) AS root, coalesce(z.proof, sha256('')) AS proof_sha256, g.folded AS folded_root,
       g.folded = (SELECT hash FROM top WHERE size = 1) AS verified
FROM n JOIN s ON n.source IS NOT DISTINCT FROM s.source LEFT JOIN z USING (r) JOIN g USING (r)
"""
