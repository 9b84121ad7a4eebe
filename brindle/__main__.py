"""``python -m brindle COMMAND ROOT``: findings of a source tree, its health, its comparison with a revision, or a
baseline of what is accepted."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import functions as F

from brindle.engine import FAILED, FOUND, OK, Engine
from brindle.functions.findings import at_least
from brindle.operators import sinks
from brindle.session import local_session
from brindle.sources import files, repository

#: Formats of a comparison.
COMPARED = {"console": sinks.to_diff, "json": sinks.diff_document, "github": sinks.diff_annotations}


def options(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="brindle")
    parser.add_argument("command", choices=["scan", "health", "diff", "baseline"])
    parser.add_argument("root")
    parser.add_argument("--format", choices=sorted({*sinks.FORMATS, "json"}), default="console")
    parser.add_argument("--fail-on", choices=["critical", "high", "medium", "low", "info"], default="high")
    parser.add_argument("--min-confidence", type=int, default=0)
    parser.add_argument("--rule", action="append")
    parser.add_argument("--without", action="append", default=[], help="a rule that is turned off")
    parser.add_argument("--framework", default="auto", help="auto: as the package file says; none; or a name")
    parser.add_argument("--base", default="HEAD", help="the revision to compare with")
    parser.add_argument("--baseline", help="scan: a file of accepted findings; baseline: the folder to write")
    given = parser.parse_args(args)
    if given.command == "diff" and given.format not in COMPARED:
        parser.error(f"a comparison is given as {', '.join(sorted(COMPARED))}")
    if given.command == "baseline" and not given.baseline:
        parser.error("a baseline needs --baseline, the folder to write")
    return given


def run(spark, given: argparse.Namespace, out=print) -> int:
    """Do what is asked and return the exit code; lines go to ``out``."""
    used = files.frameworks(spark, given.root) if given.framework == "auto" else [f for f in [given.framework.lower()] if f != "none"]
    engine = lambda tree: Engine(spark, tree, frameworks=used, disabled=given.without)
    now = engine(files.source_tree(spark, given.root))
    if given.command == "health":
        out(now.health().first().asDict(True))
        return now.exit_code(given.fail_on)
    if given.command == "baseline":
        files.write_baseline(now.findings(), given.baseline, now.score().first().score, datetime.now(timezone.utc).isoformat(timespec="seconds"))
        return OK
    if given.command == "diff":
        local = given.root.removeprefix("file://")
        rows = now.against(engine(repository.tree_at(spark, local, given.base)))
        shown, judged = COMPARED[given.format](rows), rows.where("state = 'new'")
    else:
        judged = analysed = now.findings(given.min_confidence, given.rule)
        if given.baseline:
            judged = now.without(files.read_baseline(spark, given.baseline), analysed)
        shown = sinks.to_json(judged, now.score(judged)) if given.format == "json" else sinks.FORMATS[given.format](judged)
    for (value,) in shown.toLocalIterator():
        out(value)
    return OK if judged.where(at_least(F.col("severity"), given.fail_on)).isEmpty() else FOUND


def main(args: list[str]) -> int:
    given = options(args)
    try:
        return run(local_session(), given)
    except Exception as e:  # noqa: BLE001  a command line ends with a code
        print(e, file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
