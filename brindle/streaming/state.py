"""Debounce and facts as keyed state of a streaming query, kept in its checkpoint.

``settled`` compares the polls of a scope: a first poll only primes; paths that appear, vanish or change wait until a
poll brings no change, or until nothing was heard of the scope for a while, and are then given once, in order. Stamps and
waiting paths are map state by path. ``facts`` gives what a file says each time its stamp is another. State is evicted when
a key has not been seen for long. A query that is stopped and started again goes on from its checkpoint, so what
waited still comes.

A scope is one key: its listing is read in batches, and what is held of it in memory are the paths of one poll.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.session import ship

#: Milliseconds without a poll after which waiting changes count as settled, and after which a key is forgotten.
QUIET, FORGET = 2_000, 7 * 24 * 3600 * 1000
SETTLED = "scope string, path string, stamp string"


def stateful(spark: SparkSession) -> None:
    """State of this kind is kept by the RocksDB provider."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Debounce(StatefulProcessor):
    def __init__(self, quiet: int, forget: int):
        self.quiet, self.forget = quiet, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stamps = handle.getMapState("stamps", "path string", "stamp string")
        self.waiting = handle.getMapState("waiting", "path string", "stamp string")
        self.seen = handle.getValueState("seen", "poll long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls: dict[int, dict[str, str]] = {}
        for frame in rows:  # a trigger may bring several polls
            for poll, path, stamp in zip(frame["poll"], frame["path"], frame["stamp"]):
                found = polls.setdefault(int(poll), {})
                if isinstance(path, str):
                    found[path] = stamp
        now = timerValues.getCurrentProcessingTimeInMs()
        for poll in sorted(polls):
            yield from self.take(key, polls[poll])
            self.seen.update((poll, now))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(now + (self.quiet if next(self.waiting.keys(), None) is not None else self.forget))

    def take(self, key, listing: dict[str, str]) -> Iterator[pd.DataFrame]:
        primed = self.seen.exists()
        before = {k[0]: v[0] for k, v in self.stamps.iterator()}
        changed = {p: s for p, s in listing.items() if before.get(p) != s} | {p: None for p in before if p not in listing}
        for path, stamp in changed.items():
            if stamp is None:
                self.stamps.removeKey((path,))
            else:
                self.stamps.updateValue((path,), (stamp,))
            if primed:
                self.waiting.updateValue((path,), (stamp,))
        if primed and not changed:
            yield from self.give(key)

    def give(self, key) -> Iterator[pd.DataFrame]:
        rows = sorted((k[0], v[0]) for k, v in self.waiting.iterator())
        if rows:
            self.waiting.clear()
            yield pd.DataFrame({"scope": [key[0]] * len(rows), "path": [p for p, _ in rows], "stamp": [s for _, s in rows]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        yield from self.give(key)
        if self.seen.exists() and now - self.seen.get()[1] >= self.forget:
            for state in (self.stamps, self.waiting, self.seen):
                state.clear()
        else:
            self.handle.registerTimer(now + self.forget)


class Facts(StatefulProcessor):
    def __init__(self, parse: Callable[[str, str], list[tuple]], columns: list[str], forget: int):
        self.parse, self.columns, self.forget = parse, columns, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stamp = handle.getValueState("stamp", "stamp string", ttlDurationMs=self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for frame in rows:
            last = frame.iloc[-1]
        if last is None:
            return
        if not isinstance(last["stamp"], str):
            self.stamp.clear()  # the file is gone
        elif not self.stamp.exists() or self.stamp.get()[0] != last["stamp"]:
            self.stamp.update((last["stamp"],))
            facts = self.parse(key[0], last["source"])
            if facts:
                yield pd.DataFrame([(key[0], last["stamp"], *f) for f in facts], columns=["path", "stamp", *self.columns])


def settled(polls: DataFrame, quiet: int = QUIET, forget: int = FORGET) -> DataFrame:
    """(scope, path, stamp) of settled changes from a stream (scope, poll, path, stamp); a null stamp: the file is gone."""
    stateful(polls.sparkSession)
    return polls.groupBy("scope").transformWithStateInPandas(Debounce(quiet, forget), SETTLED, "Append", "ProcessingTime")


def facts(sources: DataFrame, parse: Callable[[str, str], list[tuple]], fields: str, forget: int = FORGET) -> DataFrame:
    """(path, stamp, fields...) of files of a stream (path, stamp, source) that are new or have another stamp."""
    stateful(sources.sparkSession)
    columns = [f.split()[0] for f in fields.split(",")]
    return sources.groupBy("path").transformWithStateInPandas(Facts(parse, columns, forget), f"path string, stamp string, {fields}", "Append", "ProcessingTime")
