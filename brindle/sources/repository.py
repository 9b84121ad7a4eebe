"""A working copy under revision control, as DataFrames.

The driver runs the version control program on its own copy; what it says goes to files in the shared
folder, not through the driver's memory, and Spark reads them there.
"""

from __future__ import annotations

import os
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.session import checkpoint_dir
from brindle.sources import files


def _folder(spark: SparkSession) -> str:
    shared = checkpoint_dir(spark).removeprefix("file://")
    if "://" in shared:
        raise ValueError("a working copy can be read only where the shared folder is mounted")
    folder = f"{shared}/repository-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def _said(spark: SparkSession, root: str, *command: str) -> str:
    """The file that holds what the command said."""
    file = f"{_folder(spark)}/out.txt"
    with open(file, "wb") as out:
        subprocess.run(["git", "-C", root, *command], stdout=out, check=True)
    return file


def changed(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(path, status, previous_path) against the base; files that are not tracked are added ones."""
    raw = spark.read.text(_said(spark, root, "diff", "--name-status", "-z", "--find-renames", base), wholetext=True).withColumnRenamed("value", "raw")
    new = spark.read.text(_said(spark, root, "ls-files", "--others", "--exclude-standard", "-z"), wholetext=True)
    untracked = new.select(F.explode(F.filter(F.split("value", "\0"), lambda x: x != "")).alias("path"))
    return files.name_status(raw).select("path", "status", "previous_path").unionByName(untracked.select("path", F.lit("A").alias("status"), F.lit(None).cast("string").alias("previous_path")))


def hunks(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(path, hunks): the new side's changed ranges."""
    text = spark.read.text(_said(spark, root, "diff", "--unified=0", "--no-color", base))
    return files.diff_hunks(text.select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line")))


def history(spark: SparkSession, root: str, commits: int = 500) -> DataFrame:
    """(path, changes) over the last commits."""
    text = spark.read.text(_said(spark, root, "log", "-n", str(commits), "--name-only", "--format="))
    return files.churn(text.select(F.col("value").alias("path")))


def tree_at(spark: SparkSession, root: str, revision: str, suffix: str = ".php") -> DataFrame:
    """(path, source, code_lines, kind) of a revision's files."""
    folder = _folder(spark)
    _unpack(root, revision, folder)
    return files.source_tree(spark, f"file://{folder}", suffix)


def _unpack(root: str, revision: str, folder: str) -> None:
    packed = subprocess.Popen(["git", "-C", root, "archive", revision], stdout=subprocess.PIPE)
    subprocess.run(["tar", "-x", "-C", folder], stdin=packed.stdout, check=True)
    if packed.wait():
        raise ValueError(f"no revision {revision}")
