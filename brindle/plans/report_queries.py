"""Queries on the path of findings, reports, revisions and architecture facts, each an analogue over the
supplied tables (whole tables throughout): events and labelled documents stand for findings, parts and
orders for classes and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.operators import analysis, architecture, reports, revisions
from brindle.session import table


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: a rule and category of each type, the user's file, a severity by value."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("user_id") % 5 == 0, "migration").when(F.col("user_id") % 5 == 1, "routes").otherwise("code")
    rule = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "SL211", "view", "SL103", "purchase", "SL215", "error", "SL101", "signup", "sl106")]), F.col("event_type"))
    category = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "laravel", "view", "complexity", "purchase", "suppression", "error", "complexity", "signup", "dead-code")]), F.col("event_type"))
    return e.select(
        "event_id", F.coalesce(rule, F.lit("SL999")).alias("rule"), F.coalesce(category, F.lit("other")).alias("category"),
        F.when(F.col("value") > 90, "critical").when(F.col("value") > 60, "high").when(F.col("value") > 30, "medium").otherwise("low").alias("severity"),
        (F.col("event_id") % 101).alias("confidence"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), (F.col("event_id") % 500).alias("line"),
        F.col("event_id").cast("string").alias("fingerprint"), kind.alias("kind"),
    )


FINDINGS_CTE = """
WITH f AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'SL211' WHEN 'view' THEN 'SL103' WHEN 'purchase' THEN 'SL215' WHEN 'error' THEN 'SL101' WHEN 'signup' THEN 'sl106' ELSE 'SL999' END AS rule,
  CASE event_type WHEN 'click' THEN 'laravel' WHEN 'view' THEN 'complexity' WHEN 'purchase' THEN 'suppression' WHEN 'error' THEN 'complexity' WHEN 'signup' THEN 'dead-code' ELSE 'other' END AS category,
  CASE WHEN value > 90 THEN 'critical' WHEN value > 60 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS severity,
  event_id % 101 AS confidence, 'f' || user_id::VARCHAR AS path, event_id % 500 AS line, event_id::VARCHAR AS fingerprint,
  CASE user_id % 5 WHEN 0 THEN 'migration' WHEN 1 THEN 'routes' ELSE 'code' END AS kind FROM events)
"""
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def analysis_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certain findings of four rules, admitted by kind, in the files of users with even ids."""
    rows = _findings(spark, sf_dir)
    only = table(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"))
    return analysis.analysis(rows, 70, ["sl103", "SL211", "SL215", "SL106"], only).groupBy("rule", "kind", "tier").agg(F.count("*").alias("n"))


ANALYSIS_SQL = FINDINGS_CTE + """
SELECT rule, kind, CASE category WHEN 'suppression' THEN 'defect' WHEN 'dead-code' THEN 'defect' ELSE 'maintainability' END AS tier, count(*)::BIGINT AS n
FROM f WHERE confidence >= 70 AND upper(rule) IN ('SL103', 'SL211', 'SL215', 'SL106') AND substr(path, 2)::BIGINT % 2 = 0
  AND CASE rule WHEN 'SL103' THEN true WHEN 'SL211' THEN kind = 'routes' WHEN 'SL215' THEN kind = 'migration' ELSE kind = 'code' END GROUP BY ALL
"""


def rules_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("rule"), F.when(F.col("p_brand").startswith("Brand#1"), "laravel").when(F.col("p_brand").startswith("Brand#2"), "symfony").alias("framework"), F.col("p_brand").endswith("3").alias("needs_roles")).distinct()
    return analysis.planned(rows, ["laravel"], False, ["Brand#11", "Brand#24"])


PLANNED_SQL = """
WITH r AS (SELECT DISTINCT p_brand AS rule, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'laravel' WHEN p_brand LIKE 'Brand#2%' THEN 'symfony' END AS framework, p_brand LIKE '%3' AS needs FROM part)
SELECT rule, CASE WHEN rule IN ('Brand#11', 'Brand#24') OR needs THEN 'off' WHEN framework = 'symfony' THEN 'skipped' ELSE 'run' END AS state FROM r
"""


def grave_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.grave(_findings(spark, sf_dir), "high").groupBy("severity").agg(F.count("*").alias("n"))


GRAVE_SQL = FINDINGS_CTE + "SELECT severity, count(*)::BIGINT AS n FROM f WHERE severity IN ('critical', 'high') GROUP BY 1"


def metrics_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding's own subject stays; a reach is added."""
    text = lambda c: F.col(c).cast("string")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("subject"), text("o_orderstatus"))).alias("metrics"), text("o_custkey").alias("c"), text("o_orderpriority").alias("p"))
    merged = analysis.with_metrics(rows, F.create_map(F.lit("subject"), F.col("c"), F.lit("blast_radius"), F.col("p")))
    return merged.select("o_orderkey", F.col("metrics")["subject"].alias("subject"), F.col("metrics")["blast_radius"].alias("blast_radius"), F.size("metrics").alias("n"))


METRICS_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_custkey::VARCHAR END AS subject, o_orderpriority AS blast_radius, 2::INT AS n FROM orders"


def conditions_implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events of a user as conditions on one subject: is the later one certain?"""
    kinds = F.array(*[F.lit(k) for k in ("is-null", "not-null", "falsy", "truthy", "empty", "not-empty")])
    kind = lambda c: F.element_at(kinds, (F.col(c) % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(kind("l_partkey").alias("earlier"), kind("l_suppkey").alias("later"))
    return rows.groupBy("earlier", "later").agg(F.count("*").alias("n")).withColumn("certain", analysis.implies(F.col("earlier"), F.col("later")))


CONDITIONS_SQL = """
WITH k AS (SELECT ['is-null', 'not-null', 'falsy', 'truthy', 'empty', 'not-empty'] AS k),
r AS (SELECT k[l_partkey % 6 + 1] AS earlier, k[l_suppkey % 6 + 1] AS later FROM lineitem, k)
SELECT earlier, later, count(*)::BIGINT AS n,
       CASE WHEN earlier IN ('truthy', 'not-empty') THEN later IN ('truthy', 'not-empty', 'not-null') WHEN earlier = 'not-null' THEN later = 'not-null'
            WHEN earlier = 'is-null' THEN later IN ('is-null', 'falsy', 'empty') ELSE later IN ('falsy', 'empty') END AS certain FROM r GROUP BY ALL
"""


def narrative_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose type's words are all in their name, where longer words may be cut at the end."""
    words = lambda c: F.filter(F.split(F.lower(c), " "), lambda w: w != "")
    return table(spark, sf_dir, "part").select("p_partkey", analysis.words_present(F.slice(words("p_type"), 1, 1), F.concat(words("p_name"), F.array(F.substring(F.lower("p_type"), 1, 4)))).alias("present"))


NARRATIVE_SQL = """
WITH p AS (SELECT p_partkey, list_filter(string_split(lower(p_type), ' '), lambda w: w <> '')[1:1] AS a, list_concat(list_filter(string_split(lower(p_name), ' '), lambda w: w <> ''), [lower(p_type)[1:4]]) AS b FROM part)
SELECT p_partkey, len(list_filter(a, lambda n: len(list_filter(b, lambda w: w = n OR (length(n) >= 4 AND starts_with(w, n)) OR (length(w) >= 4 AND starts_with(n, w)))) = 0)) = 0 AS present FROM p
"""


def first_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return analysis.first_only(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber"])


FIRST_SQL = "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) = 1"


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_category(_findings(spark, sf_dir)).select("category", "n", "place")


CATEGORY_SQL = FINDINGS_CTE + "SELECT category, count(*)::BIGINT AS n, CASE category WHEN 'complexity' THEN 0 WHEN 'dead-code' THEN 2 WHEN 'suppression' THEN 8 WHEN 'laravel' THEN 9 ELSE 10 END::INT AS place FROM f GROUP BY ALL"


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_rule(_findings(spark, sf_dir))


RULE_SQL = FINDINGS_CTE + "SELECT rule, count(*)::BIGINT AS n FROM f GROUP BY 1"


def file_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tally(_findings(spark, sf_dir))


TALLY_SQL = FINDINGS_CTE + """, c AS (SELECT path, rule, count(*) AS n FROM f GROUP BY ALL)
SELECT path, string_agg(rule || ' x' || n::VARCHAR, ', ' ORDER BY n DESC, rule) AS rules, sum(n)::BIGINT AS n FROM c GROUP BY path"""


def files_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's findings in canonical order: the first, the last, and how many."""
    rows = reports.by_file(_findings(spark, sf_dir))
    return rows.select("path", F.size("findings").cast("long").alias("n"), F.element_at("findings", 1)["fingerprint"].alias("first"), F.element_at("findings", -1)["fingerprint"].alias("last"))


GROUPED_SQL = FINDINGS_CTE + f"SELECT path, count(*)::BIGINT AS n, arg_min(fingerprint, ({RANK}, line, rule, fingerprint)) AS first, arg_max(fingerprint, ({RANK}, line, rule, fingerprint)) AS last FROM f GROUP BY path"


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _findings(spark, sf_dir)
    return rows.withColumn("risk", (F.col("confidence") * 7 % 97).cast("double")).withColumn("state", F.when(F.col("event_id") % 3 == 0, "existing").otherwise("new"))


def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hotspots(_risks(spark, sf_dir))


TOP_FILES_SQL = FINDINGS_CTE + "SELECT path, sum(confidence * 7 % 97)::DOUBLE AS risk, count(*)::BIGINT AS n_findings FROM f GROUP BY path ORDER BY risk DESC, path LIMIT 10"


def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New findings as a reviewer reads them; the order is part of the operator, the rows are compared."""
    return reports.review_order(_risks(spark, sf_dir)).select("path", "line", "risk", "event_id")


REVIEW_SQL = FINDINGS_CTE + "SELECT path, line, (confidence * 7 % 97)::DOUBLE AS risk, event_id FROM f WHERE event_id % 3 <> 0"


def _states(spark: SparkSession, sf_dir: str):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("p"), (F.col("o_custkey") % 200).cast("string")).alias("path"), (F.col("o_orderkey") % 90 + 10).alias("lines"), "o_orderstatus")
    changed = table(spark, sf_dir, "customer").where("c_custkey % 200 < 40").select(F.concat(F.lit("p"), (F.col("c_custkey") % 200).cast("string")).alias("path"))
    return orders.where("o_orderstatus <> 'F'"), orders.where("o_orderstatus = 'F'"), changed


def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before, changed = _states(spark, sf_dir)
    return revisions.base_findings(now, before, changed).select("o_orderkey", "path")


STATES_CTE = """
WITH o AS (SELECT o_orderkey, 'p' || (o_custkey % 200)::VARCHAR AS path, o_orderkey % 90 + 10 AS lines, o_orderstatus = 'F' AS old FROM orders),
c AS (SELECT DISTINCT 'p' || (c_custkey % 200)::VARCHAR AS path FROM customer WHERE c_custkey % 200 < 40)
"""
BASE_SQL = STATES_CTE + "SELECT o_orderkey, path FROM o WHERE old = (path IN (FROM c))"


def base_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.base_lines(*_states(spark, sf_dir))


SIZE_SQL = STATES_CTE + "SELECT coalesce(sum(lines), 0)::BIGINT AS lines FROM o WHERE old = (path IN (FROM c))"


def base_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's files without the changed ones, and the old contents of these; renames stand under their old path."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("source"))
    changes = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(
        F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 2 == 0, "M").when(F.col("p_partkey") % 3 == 0, "A").otherwise("R").alias("status"),
        F.when((F.col("p_partkey") % 2 != 0) & (F.col("p_partkey") % 3 != 0), F.concat(F.lit("old"), F.col("p_partkey").cast("string"))).alias("previous_path"),
    )
    blobs = table(spark, sf_dir, "part").select(F.explode(F.array(F.col("p_partkey").cast("string"), F.concat(F.lit("old"), F.col("p_partkey").cast("string")))).alias("path"), F.col("p_type").alias("source"))
    return revisions.base_tree(files, changes, blobs)


BASE_FILES_SQL = """
SELECT p_partkey::VARCHAR AS path, p_name AS source FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'old' END || p_partkey::VARCHAR, p_type FROM part WHERE p_partkey % 7 = 0 AND (p_partkey % 2 = 0 OR p_partkey % 3 <> 0)
"""


def evidence_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _risks(spark, sf_dir).select("event_id", "state")
    evidence = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("event_id"))
    return revisions.with_evidence(rows, evidence).groupBy("state", "scored").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


EVIDENCE_SQL = """
SELECT state, scored, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'existing' ELSE 'new' END AS state, true AS scored FROM events UNION ALL SELECT o_orderkey, 'new', false FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL
"""


def migrations_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "database/migrations/").otherwise("app/"), F.col("o_orderkey").cast("string"))
    status = F.when(F.col("o_orderstatus") == "F", "M").when(F.col("o_orderstatus") == "O", "R").otherwise("A")
    changes = table(spark, sf_dir, "orders").select(F.concat(F.lit("new/"), path).alias("path"), status.alias("status"), F.when(status == "R", path).alias("previous_path"))
    return revisions.edited_migrations(changes)


MIGRATIONS_SQL = """
SELECT 'SL214' AS rule, 'high' AS severity, CASE o_orderstatus WHEN 'O' THEN 80 ELSE 85 END::INT AS confidence, 'new/database/migrations/' || o_orderkey::VARCHAR AS path
FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus IN ('F', 'O')
"""


def classes_misplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who are new (no order before 1995), live in Europe or Asia and have no segment role."""
    region = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(region), F.col("c_nationkey") == F.col("n_nationkey"))
    classes = c.select(F.col("c_custkey").alias("fqn"), F.col("r_name").alias("path"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("role"))
    before = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("fqn"))
    covered = table(spark, sf_dir, "region").where(F.col("r_name").isin("EUROPE", "ASIA")).select(F.col("r_name").alias("path"))
    return revisions.misplaced_classes(classes, before, covered)


MISPLACED_SQL = """
SELECT 'SL307' AS rule, 'low' AS severity, 75::INT AS confidence, r_name AS path, c_custkey AS fqn
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_mktsegment = 'BUILDING' AND r_name IN ('EUROPE', 'ASIA') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01')
"""


def baselines_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("path"), F.month("o_orderdate").alias("m"), "o_custkey")
    count = lambda rows: rows.groupBy(F.concat_ws("/", "path", (F.col("o_custkey") % 30).cast("string")).alias("path")).agg(F.count("*").alias("count"))
    return revisions.grown_baselines(count(orders.where("m > 6")), count(orders.where("m <= 6")))


BASELINES_SQL = """
WITH o AS (SELECT o_orderpriority || '/' || (o_custkey % 30)::VARCHAR AS path, month(o_orderdate) > 6 AS late FROM orders)
SELECT 'SL502' AS rule, 'medium' AS severity, 85::INT AS confidence, path, (count(*) FILTER (late) - count(*) FILTER (NOT late))::BIGINT AS growth FROM o GROUP BY path HAVING count(*) FILTER (late) > count(*) FILTER (NOT late)
"""


def implementor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return architecture.implementors(table(spark, sf_dir, "part"), "p_brand", "p_type")


IMPLEMENTORS_SQL = "SELECT p_type, count(DISTINCT p_brand)::BIGINT AS implementors, min(p_brand) AS first FROM part GROUP BY 1"


def family_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the customers of their neighbouring orders."""
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 150 + 1).alias("b"))
    return architecture.family_sizes(pairs, "a", "b")


FAMILY_SQL = """
WITH p AS (SELECT o_custkey AS a, o_orderkey % 150 + 1 AS b FROM orders), u AS (SELECT a AS member, b AS partner FROM p UNION ALL SELECT b, a FROM p)
SELECT member, (count(DISTINCT partner) + 1)::BIGINT AS family FROM u WHERE member <> partner GROUP BY 1
"""


def dominant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", F.substring_index("p_type", " ", -1).alias("metal"), "p_partkey")
    return architecture.dominant(rows, "p_brand", "metal", "p_partkey", 2, 0.2)


DOMINANT_SQL = """
WITH c AS (SELECT p_brand, string_split(p_type, ' ')[-1] AS metal, count(*) AS n, min(p_partkey) AS seen FROM part GROUP BY ALL),
b AS (SELECT p_brand, arg_min(metal, (-n, seen)) AS metal, max(n) AS n, sum(n) AS total FROM c GROUP BY 1)
SELECT p_brand, metal, n::BIGINT AS n FROM b WHERE n >= 2 AND n >= 0.2 * total
"""


def layer_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", "Service", "Repository", "RepositoryInterface", "Manager")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    classes = table(spark, sf_dir, "orders").select(F.concat(F.lit("N"), F.col("o_custkey").cast("string"), suffix).alias("name"))
    return architecture.layer_stacks(classes, "name")


STACKS_SQL = """
SELECT 'N' || o_custkey::VARCHAR AS noun, count(*)::BIGINT AS members, count(DISTINCT o_orderkey % 5)::BIGINT AS depth FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 5) >= 3
"""


def preset_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces made of part types; the suffix counts come from brands."""
    segment = F.when(F.col("p_type").startswith("PROMO"), "Actions").when(F.col("p_type").startswith("ECONOMY"), "Domain").when(F.col("p_type").startswith("SMALL"), "Infrastructure").otherwise("Http")
    classes = table(spark, sf_dir, "part").select(F.concat(F.lit("App\\"), segment, F.lit("\\C"), F.col("p_partkey").cast("string")).alias("fqn"))
    suffixes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))
    return architecture.preset(architecture.segment_facts(classes, "fqn"), suffixes, 0, [])


PRESET_SQL = """
WITH n AS (SELECT count(*) FILTER (p_type LIKE 'ECONOMY%') AS d, count(*) FILTER (p_type LIKE 'SMALL%') AS i, count(*) FILTER (p_type LIKE 'PROMO%') AS a FROM part)
SELECT CASE WHEN d > 0 AND i > 0 THEN 'ddd' WHEN a >= 3 THEN 'laravel-actions' ELSE 'laravel' END AS preset FROM n
"""


def placement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as roles: their types' first words are strong, the last ones weak; parts ask with all words."""
    part = table(spark, sf_dir, "part").withColumn("w", F.split("p_type", " "))
    roles = part.groupBy(F.col("p_brand").alias("role")).agg(F.array_distinct(F.collect_set(F.element_at("w", 1))).alias("strong"), F.collect_set(F.element_at("w", -1)).alias("weak"))
    return architecture.placements(part.select(F.col("p_partkey").alias("id"), F.col("w").alias("words")), roles)


#: Words of a question meet words of a role; every pair of part and brand that shares none is left out.
PLACEMENT_SQL = """
WITH p AS (SELECT p_partkey AS id, p_brand, string_split(p_type, ' ') AS w FROM part),
s AS (SELECT DISTINCT p_brand AS role, w[1] AS word FROM p), k AS (SELECT DISTINCT p_brand AS role, w[-1] AS word FROM p),
a AS (SELECT DISTINCT id, unnest(w) AS word FROM p)
SELECT id, role, sum(points)::BIGINT AS score FROM a JOIN (SELECT role, word, 3 AS points FROM s UNION ALL (SELECT role, word, 1 FROM k ANTI JOIN s USING (role, word))) USING (word) GROUP BY ALL
"""


def roles_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as declarations: the first role that a tree of conditions gives, and the others."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey"), F.concat(F.lit("App\\"), F.replace("p_type", F.lit(" "), F.lit("\\"))).alias("fqn"), F.col("p_brand").alias("path"), F.split("p_name", " ").alias("uses"), F.lower(F.substring_index("p_type", " ", 1)).alias("kind"))
    roles = [
        ("steel", {"suffix": "STEEL", "not": {"kind": "promo"}}),
        ("branded", [{"path": "Brand#1*"}, {"path": ["Brand#2*", "Brand#31"], "kind": "small"}]),
        ("other", {"all": [{"kind": ["economy", "promo"]}, {"any": [{"suffix": "TIN"}, {"suffix": "COPPER"}]}]}),
    ]
    return architecture.roles_of(part, roles).select("p_partkey", "role", F.concat_ws(",", "also").alias("also"))


MATCHED_SQL = """
WITH p AS (SELECT p_partkey, p_type, p_brand, lower(string_split(p_type, ' ')[1]) AS kind FROM part),
r AS (SELECT p_partkey, list_filter([CASE WHEN p_type LIKE '%STEEL' AND kind <> 'promo' THEN 'steel' END,
  CASE WHEN p_brand LIKE 'Brand#1%' OR ((p_brand LIKE 'Brand#2%' OR p_brand = 'Brand#31') AND kind = 'small') THEN 'branded' END,
  CASE WHEN kind IN ('economy', 'promo') AND (p_type LIKE '%TIN' OR p_type LIKE '%COPPER') THEN 'other' END], lambda x: x IS NOT NULL) AS l FROM p)
SELECT p_partkey, l[1] AS role, array_to_string(l[2:], ',') AS also FROM r
"""


def first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), "l_orderkey")
    return architecture.mentions(refs, "source", "target", "l_orderkey")


MENTIONS_SQL = "SELECT l_suppkey AS source, l_partkey AS target, min(l_orderkey) AS l_orderkey FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL"


def nearest_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested ranges of an order, one in the other, and the innermost one around each of its lines."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).cast("long").alias("pos")).distinct()
    scopes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 4).cast("int"))).alias("scope"))
    scopes = scopes.withColumns({"start": (F.col("scope") * 12 + 1).cast("long"), "end": (75 - F.col("scope") * 8).cast("long")})
    return architecture.nearest_enclosing(line, scopes, "l_orderkey", "pos", "start", "end", "scope")


SCOPE_SQL = """
WITH l AS (SELECT DISTINCT l_orderkey, (l_linenumber * 10)::BIGINT AS pos FROM lineitem),
s AS (SELECT o_orderkey AS l_orderkey, unnest(range(0, o_orderkey % 4 + 1))::INT AS scope FROM orders)
SELECT l_orderkey, pos, max(scope) FILTER (pos BETWEEN scope * 12 + 1 AND 75 - scope * 8)::INT AS scope FROM l LEFT JOIN s USING (l_orderkey) GROUP BY ALL
"""

QUERIES = {
    "analysis_plan": (analysis_plan, ANALYSIS_SQL), "rules_planned": (rules_planned, PLANNED_SQL), "grave_findings": (grave_findings, GRAVE_SQL),
    "metrics_merged": (metrics_merged, METRICS_SQL), "conditions_implied": (conditions_implied, CONDITIONS_SQL), "narrative_parts": (narrative_parts, NARRATIVE_SQL),
    "first_per_order": (first_per_order, FIRST_SQL), "category_counts": (category_counts, CATEGORY_SQL), "rule_rows": (rule_rows, RULE_SQL),
    "file_tally": (file_tally, TALLY_SQL), "files_grouped": (files_grouped, GROUPED_SQL), "top_files": (top_files, TOP_FILES_SQL), "review_list": (review_list, REVIEW_SQL),
    "base_composition": (base_composition, BASE_SQL), "base_size": (base_size, SIZE_SQL), "base_files": (base_files, BASE_FILES_SQL), "evidence_appended": (evidence_appended, EVIDENCE_SQL),
    "migrations_edited": (migrations_edited, MIGRATIONS_SQL), "classes_misplaced": (classes_misplaced, MISPLACED_SQL), "baselines_grown": (baselines_grown, BASELINES_SQL),
    "implementor_counts": (implementor_counts, IMPLEMENTORS_SQL), "family_sizes": (family_sizes, FAMILY_SQL), "dominant_types": (dominant_types, DOMINANT_SQL),
    "layer_stacks": (layer_stacks, STACKS_SQL), "preset_choice": (preset_choice, PRESET_SQL), "placement_scores": (placement_scores, PLACEMENT_SQL), "roles_matched": (roles_matched, MATCHED_SQL),
    "first_mentions": (first_mentions, MENTIONS_SQL), "nearest_scope": (nearest_scope, SCOPE_SQL),
}
