"""Listings of source trees as a stream: a Python data source whose micro-batches are polls.

Every batch lists all files anew, so files that were edited in place and files that are gone show as well as new
ones. A batch has one partition for each folder below the roots, so folders are walked by the executors; a last one
holds the files of the roots themselves and one row without a path for each root, which says that the root was looked
at though it may be empty. Offsets count polls. A batch that is repeated after a failure lists what is there then; state
that compares listings takes that like a later poll.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from brindle.session import ship

SCHEMA = "scope string, poll long, path string, stamp string"


class Folder(InputPartition):
    """Part of a poll: the files below a folder, or those of a root alone."""

    def __init__(self, poll: int, root: str, folder: str, deep: bool):
        self.poll, self.root, self.folder, self.deep = poll, root, folder, deep


class ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots = options["path"].split(",")
        self.suffix = options.get("suffix", ".php")
        self.polls = 0

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        self.polls += 1
        return {"poll": self.polls}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.polls = max(self.polls, end["poll"])  # after a restart counting goes on
        out: list[InputPartition] = []
        for root in self.roots:
            system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
            below = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
            out += [Folder(end["poll"], root, f.path, True) for f in below if f.type == fs.FileType.Directory]
            out.append(Folder(end["poll"], root, base, False))
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, base = fs.FileSystem.from_uri(partition.root) if "://" in partition.root else (fs.LocalFileSystem(), partition.root)
        if not partition.deep:
            yield partition.root, partition.poll, None, None
        for f in system.get_file_info(fs.FileSelector(partition.folder, allow_not_found=True, recursive=partition.deep)):
            if f.type == fs.FileType.File and f.path.endswith(self.suffix):
                yield partition.root, partition.poll, f.path[len(base) :].lstrip("/"), f"{f.mtime_ns or 0}:{f.size}"

    def commit(self, end: dict) -> None:
        pass


class ListingSource(DataSource):
    """``spark.readStream.format("listing").option("path", roots)``: roots are parted by commas."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingReader(self.options)


def listings(spark: SparkSession, roots: list[str], suffix: str = ".php") -> DataFrame:
    """The stream of polls of the roots; each root is a scope."""
    ship(spark)
    spark.dataSource.register(ListingSource)
    return spark.readStream.format("listing").option("path", ",".join(roots)).option("suffix", suffix).load()
