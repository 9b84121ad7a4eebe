"""Streams over restarts: listings as a source, debounce and facts in keyed state."""

import os
import time

from brindle.streaming.listing import listings
from brindle.streaming.state import facts, settled


def taken(query, rows, seconds=60, seen={}):  # noqa: B006
    """Wait until the query has read so many rows; batches of timers go on without end, and only the last are told."""
    deadline = time.time() + seconds
    mine = seen.setdefault(str(query.runId), {})
    while time.time() < deadline and query.isActive and sum(mine.values()) < rows:
        mine |= {p.batchId: p.numInputRows for p in query.recentProgress if p.numInputRows}
        time.sleep(0.1)
    assert sum(mine.values()) >= rows, query.exception()


def poll(folder, k, scope="s", **files):
    rows = [f'{{"scope": "{scope}", "poll": {k}}}'] + [f'{{"scope": "{scope}", "poll": {k}, "path": "{p}", "stamp": "{s}"}}' for p, s in files.items()]
    (folder / f".{k}.json").write_text("\n".join(rows))
    os.rename(folder / f".{k}.json", folder / f"{k:03}.json")


def test_waiting_changes_survive_a_restart(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    polls = spark.readStream.schema("scope string, poll long, path string, stamp string").option("maxFilesPerTrigger", 1).json(str(source))

    def run(rows):
        query = settled(polls, quiet=600_000).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            taken(query, rows)
            time.sleep(1)
            return sorted(tuple(r) for r in spark.read.schema("scope string, path string, stamp string").parquet(str(out)).collect())
        finally:
            query.stop()

    poll(source, 1, a="1", b="1")
    poll(source, 2, a="2", b="1")
    assert run(6) == []  # changed, not yet quiet; the query stops here
    poll(source, 3, a="2", c="1")
    assert run(3) == []
    poll(source, 4, a="2", c="1")
    assert run(3) == [("s", "a", "2"), ("s", "b", None), ("s", "c", "1")]
    poll(source, 5, a="2", c="1")
    assert len(run(3)) == 3  # nothing is given twice


def test_a_timer_settles_what_is_not_polled_again(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    polls = spark.readStream.schema("scope string, poll long, path string, stamp string").option("maxFilesPerTrigger", 1).json(str(source))
    query = settled(polls, quiet=300).writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        poll(source, 1, a="1")
        poll(source, 2, a="2")
        taken(query, 4)
        deadline = time.time() + 30
        while time.time() < deadline and not spark.sql("SELECT * FROM timed").count():
            time.sleep(0.3)
        assert [tuple(r) for r in spark.sql("SELECT * FROM timed").collect()] == [("s", "a", "2")]
    finally:
        query.stop()


def test_facts_of_changed_files_only(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    files = spark.readStream.schema("path string, stamp string, source string").option("maxFilesPerTrigger", 1).json(str(source))
    query = facts(files, lambda path, text: [(w,) for w in (text or "").split()], "word string").writeStream.format("memory").queryName("facts").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for k, (stamp, text) in enumerate([("1", "x y"), ("1", "x y"), ("2", "z"), (None, None), ("2", "z")]):
            stamp = "null" if stamp is None else f'"{stamp}"'
            (source / f"{k}.json").write_text(f'{{"path": "p", "stamp": {stamp}, "source": "{text}"}}')
            taken(query, k + 1)
        time.sleep(1)
        assert [(r.stamp, r.word) for r in spark.sql("SELECT * FROM facts").collect()] == [("1", "x"), ("1", "y"), ("2", "z"), ("2", "z")]
    finally:
        query.stop()


def test_listing_source_sees_edits_and_deletions(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "app/deep").mkdir(parents=True)
    (root / "a.php").write_text("1")
    (root / "app/deep/b.php").write_text("1")
    (root / "app/c.txt").write_text("1")
    checkpoint = str(tmp_path / "c")

    def polled(name):
        return listings(spark, [str(root)]).writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(processingTime="300 milliseconds").start()

    def until(name, paths):
        deadline = time.time() + 40
        while time.time() < deadline:
            rows = spark.sql(f"SELECT * FROM {name}").collect()
            last = max((r.poll for r in rows), default=0)
            now = {r.path for r in rows if r.poll == last}
            if now == paths:
                return last
            time.sleep(0.2)
        raise AssertionError(now)

    query = polled("listed")
    try:
        first = until("listed", {None, "a.php", "app/deep/b.php"})
        (root / "a.php").unlink()
        (root / "app/new.php").write_text("2")
        assert until("listed", {None, "app/new.php", "app/deep/b.php"}) > first
    finally:
        query.stop()
