"""The watch loop as a stream: snapshots of a listing, their changes, and a debounce.

A file source sees neither deletions nor edits in place, so the stream carries whole listings: each
micro-batch holds rows (path, stamp) of one poll. The first poll only primes the state. Changes gather
until one poll brings none; then they are emitted, sorted, once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.session import checkpoint_dir

#: Polls without a change that are made at once; then the delay doubles from the first up to the ceiling.
EAGER_POLLS, FIRST_DELAY, CEILING, COST_FACTOR = 4, 0.25, 2.0, 10.0


def listing(spark: SparkSession, root: str, suffix: str = ".php") -> DataFrame:
    """(path, stamp) of the files below a root: one poll. Only names, times and sizes are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return raw.select("path", F.concat_ws(":", F.unix_millis("modificationTime").cast("string"), F.col("length").cast("string")).alias("stamp"))


class Facts:
    """Facts of files by path and stamp: a new listing parses what it does not know and forgets what is gone."""

    def __init__(self, parse: Callable[[DataFrame], DataFrame]):
        self.parse, self.stamps, self.rows = parse, None, None

    def sync(self, now: DataFrame) -> DataFrame:
        """The facts (path, ...) of all files of a listing (path, stamp); only changed files are parsed."""
        checkpoint_dir(now.sparkSession)
        now = now.select("path", "stamp").checkpoint()
        if self.stamps is None:
            self.rows = self.parse(now).checkpoint()
        else:
            same = now.join(self.stamps, ["path", "stamp"], "left_semi")
            kept = self.rows.join(same.select("path"), "path", "left_semi")
            self.rows = kept.unionByName(self.parse(now.join(same, ["path", "stamp"], "left_anti"))).checkpoint()
        self.stamps = now
        return self.rows


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Paths that appeared, vanished, or have another stamp."""
    old, new = before.select("path", F.col("stamp").alias("_old")), now.select("path", F.col("stamp").alias("_new"))
    return old.join(new, "path", "full").where(~F.col("_old").eqNullSafe(F.col("_new"))).select("path")


def delay(idle: int, cost: float, busy: bool) -> float:
    """Seconds until the next poll: none while something settles; a quiet tree is polled ever less, and
    never more often than its walk's cost allows."""
    if busy:
        return 0.0
    backoff = 0.0 if idle <= EAGER_POLLS else min(CEILING, FIRST_DELAY * 2 ** min(16, idle - EAGER_POLLS - 1))
    return max(backoff, min(CEILING, cost * COST_FACTOR))


class Watch:
    """State of the loop. Listings and pending paths are tables in the shared folder, not driver lists."""

    def __init__(self, on_settled: Callable[[DataFrame], None]):
        self.on_settled = on_settled
        self.previous: DataFrame | None = None
        self.pending: DataFrame | None = None
        self.idle = 0

    def poll(self, listing: DataFrame) -> bool:
        """Take one listing; true if settled changes were emitted."""
        checkpoint_dir(listing.sparkSession)
        now = listing.select("path", "stamp").checkpoint()
        previous, self.previous = self.previous, now
        if previous is None:
            return False
        found = changes(previous, now)
        if not found.isEmpty():
            self.pending = (found if self.pending is None else self.pending.union(found)).distinct().checkpoint()
            self.idle = 0
            return False
        self.idle = 0 if self.pending is not None else self.idle + 1
        if self.pending is None:
            return False
        settled, self.pending = self.pending, None
        self.on_settled(settled.orderBy("path"))
        return True

    def run(self, stream: DataFrame, checkpoint: str):
        """Feed a stream of listings, one micro-batch a poll."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.poll(batch) and None).option("checkpointLocation", checkpoint).start()
