"""Comparison of two states of findings: bags by identity, and baselines with moved files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from brindle.session import dealt


def partition(current: DataFrame, previous: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of both states with ``state``: new, existing (current rows) or resolved (previous rows).

    The k-th occurrence of an identity is existing if the other state has k of them. Counts come from a
    partial aggregation and decide most identities as a whole; only those that occur in both states, and
    more often in the one that is looked at, have their rows numbered.
    """
    now = _beyond(current, previous, key, order).select(*current.columns, F.when(F.col("_beyond"), "new").otherwise("existing").alias("state"))
    gone = _beyond(previous, current, key, order).where("_beyond").select(*previous.columns, F.lit("resolved").alias("state"))
    return now.unionByName(gone)


def _beyond(rows: DataFrame, other: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with ``_beyond``: whether the other state has fewer of the identity than the row's ordinal."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = count(rows, "_own").join(count(other, "_other"), key, "left")
    known = dealt(rows, key).join(both.hint("merge"), key, "left")
    torn = F.coalesce(F.col("_other") < F.col("_own"), F.lit(False))
    whole = known.where(~torn).withColumn("_beyond", F.col("_other").isNull())
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return whole.unionByName(known.where(torn).withColumn("_beyond", place > F.col("_other")))


def match_baseline(findings: DataFrame, baseline: DataFrame, present: DataFrame | None, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Findings with ``accepted``, and baseline entries with ``used``.

    Findings: identity, rule, fingerprint and the columns of ``order``. Baseline: id, rule, fingerprint,
    path, count. First, findings are accepted by identity up to the entry's count. Then what is left is
    accepted by (rule, fingerprint) against what is left of entries whose own file is not among
    ``present`` (all entries, if that is None); entries are used up in the order of their paths.
    """
    exact = Window.partitionBy("identity").orderBy(*order)
    allowed = baseline.select(F.col("id").alias("identity"), F.col("count").alias("_allowed"))
    first = findings.withColumn("_k", F.row_number().over(exact)).join(allowed, "identity", "left")
    first = first.withColumn("_exact", F.coalesce(F.col("_k") <= F.col("_allowed"), F.lit(False)))

    taken = first.where("_exact").groupBy("identity").agg(F.count("*").alias("_taken"))
    entries = baseline.join(taken, baseline["id"] == taken["identity"], "left").drop("identity")
    entries = entries.withColumn("_taken", F.coalesce("_taken", F.lit(0)))
    if present is not None:
        here = present.select("path").distinct().withColumn("_here", F.lit(True))
        entries = entries.join(here, "path", "left").withColumn("_left", F.when(F.col("_here"), 0).otherwise(F.col("count") - F.col("_taken"))).drop("_here")
    else:
        entries = entries.withColumn("_left", F.col("count") - F.col("_taken"))

    room = entries.groupBy("rule", "fingerprint").agg(F.sum("_left").alias("_room"))
    moved = Window.partitionBy("rule", "fingerprint").orderBy(*order)
    rest = first.where("NOT _exact").withColumn("_j", F.row_number().over(moved)).join(room, ["rule", "fingerprint"], "left")
    rest = rest.withColumn("accepted", F.coalesce(F.col("_j") <= F.col("_room"), F.lit(False)))
    columns = [*findings.columns, "accepted"]
    matched = first.where("_exact").withColumn("accepted", F.lit(True)).select(*columns).unionByName(rest.select(*columns))

    asked = rest.where("accepted").groupBy("rule", "fingerprint").agg(F.count("*").alias("_asked"))
    earlier = Window.partitionBy("rule", "fingerprint").orderBy("path", "id").rowsBetween(Window.unboundedPreceding, -1)
    used = entries.join(asked, ["rule", "fingerprint"], "left").withColumn("_before", F.coalesce(F.sum("_left").over(earlier), F.lit(0)))
    borrowed = F.greatest(F.lit(0), F.least(F.col("_left"), F.coalesce("_asked", F.lit(0)) - F.col("_before")))
    return matched, used.withColumn("used", F.col("_taken") + borrowed).select(*baseline.columns, "used")


def resolved(entries: DataFrame) -> DataFrame:
    """Baseline entries that no finding uses."""
    return entries.where("used = 0").drop("used")


def grown(now: DataFrame, before: DataFrame, key: str, count: str) -> DataFrame:
    """Keys whose count rose, with the rise; absent keys count 0."""
    both = now.select(key, F.col(count).alias("_now")).join(before.select(key, F.col(count).alias("_before")), key, "full")
    rise = F.coalesce("_now", F.lit(0)) - F.coalesce("_before", F.lit(0))
    return both.select(key, rise.alias("growth")).where("growth > 0")


def weakened(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Tests of two revisions (key..., assertions, skipped, looped) -> what weakened and how."""
    old = before.select(*key, F.col("assertions").alias("old_n"), F.col("skipped").alias("old_skipped"), F.col("looped").alias("old_looped"))
    both = old.join(after.select(*key, "assertions", "skipped", "looped", F.lit(True).alias("_new")), key, "full")
    kind = (
        F.when(F.col("_new").isNull(), "deleted")
        .when(F.col("old_n").isNull(), None)
        .when(F.col("skipped") & ~F.col("old_skipped"), "skipped")
        .when((F.col("assertions") < F.col("old_n")) & (F.col("looped") <= F.col("old_looped")), "fewer assertions")
    )
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(*key, "kind", "old_n", "assertions")


def weakened_tests(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Findings: tests that a revision skips, thins out or deletes; a deletion may be a move and is less certain."""
    gone = F.col("kind") == "deleted"
    sure = F.when(gone, 60).when(F.col("kind") == "skipped", 90).otherwise(85)
    return weakened(before, after, key).select(F.lit("SL503").alias("rule"), F.when(gone, "medium").otherwise("high").alias("severity"), sure.alias("confidence"), *key, "kind")


def base_findings(current: DataFrame, previous: DataFrame, changed: DataFrame) -> DataFrame:
    """The findings of the base: those of today outside the changed files, and the earlier ones inside them."""
    paths = changed.select("path").distinct()
    return current.join(paths, "path", "left_anti").unionByName(previous.join(paths, "path", "left_semi"))


def base_lines(current: DataFrame, previous: DataFrame, changed: DataFrame) -> DataFrame:
    """(lines) of the base: today's, less those of changed files, and the lines these had."""
    return base_findings(current, previous, changed).agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def base_tree(files: DataFrame, changes: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, source) of the base: unchanged files, and the old contents of changed ones.

    A renamed file stands under its earlier path, an added one is not there, a deleted one is.
    """
    kept = files.join(changes.select("path").distinct(), "path", "left_anti").select("path", "source")
    was = changes.where("status <> 'A'").select(F.coalesce("previous_path", "path").alias("path")).distinct()
    return kept.unionByName(blobs.join(was, "path", "left_semi").select("path", "source"))


def with_evidence(compared: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence beside compared findings: always new, and never part of a score."""
    scored = compared.withColumn("scored", F.col("state") != "resolved")
    return scored.unionByName(evidence.withColumns({"state": F.lit("new"), "scored": F.lit(False)}))


def edited_migrations(changes: DataFrame, migrations: str = "database/migrations/") -> DataFrame:
    """Findings: migrations of the base that were changed, or moved (less certain)."""
    before = F.coalesce("previous_path", "path")
    moved = F.col("status") == "R"
    rows = changes.where(F.col("status").isin("M", "R") & (before.startswith(migrations) | before.contains(f"/{migrations}")))
    return rows.select(F.lit("SL214").alias("rule"), F.lit("high").alias("severity"), F.when(moved, 80).otherwise(85).alias("confidence"), "path")


def misplaced_classes(classes: DataFrame, before: DataFrame, covered: DataFrame) -> DataFrame:
    """Findings: classes (fqn, path, role) that are new, lie in a covered path and play no role."""
    new = classes.where("role IS NULL").join(before.select("fqn").distinct(), "fqn", "left_anti").join(covered.select("path").distinct(), "path", "left_semi")
    return new.select(F.lit("SL307").alias("rule"), F.lit("low").alias("severity"), F.lit(75).alias("confidence"), "path", "fqn")


def grown_baselines(now: DataFrame, before: DataFrame) -> DataFrame:
    """Findings: paths of which a baseline (path, count) hides more than it did, a new baseline included."""
    rise = grown(now, before, "path", "count")
    return rise.select(F.lit("SL502").alias("rule"), F.lit("medium").alias("severity"), F.lit(85).alias("confidence"), "path", "growth")
