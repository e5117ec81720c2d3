"""python -m casegraph scan|diff|report|resume"""

from __future__ import annotations

import argparse
import os
import re
import sys
from pathlib import Path


def locate_store(spark, target: str) -> str:
    """The store of a target, on any file system: the folder itself, or its .audit, or the one in the working folder."""
    for folder in (target.rstrip("/"), target.rstrip("/") + "/.audit", ".audit"):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/scans")
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return folder
    raise SystemExit(f"no store found for {target}")


def session(master: str | None):
    """The session that spark-submit has set up, or one on the given master, or on this machine's cores."""
    from casegraph.session import build_session

    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    if master is None:
        return build_session("casegraph", None if submitted else "*")
    return build_session("casegraph", None, **{"spark.master": master})


def last_scan(store) -> str:
    from pyspark.sql import functions as F

    row = store.read("scans").orderBy(F.col("started_at").desc(), "scan_id").select("scan_id").first()
    if row is None:
        raise SystemExit("the store holds no scan")
    return row[0]


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="casegraph", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "diff", "report", "resume"):
        command = commands.add_parser(name)
        command.add_argument("target")
        command.add_argument("--audit", help="the store's folder; <target>/.audit if missing")
        if name in ("report", "resume"):
            command.add_argument("--scan-id")
        if name == "report":
            command.add_argument("--format", choices=("md", "sarif", "graph"), default="md")
            command.add_argument("--output")
            command.add_argument("--scope", choices=("repository", "symbol", "endpoint", "path", "finding"), default="repository")
            command.add_argument("--key", help="the symbol, route, path or finding of the scope")
        if name == "diff":
            command.add_argument("--tracked", help="a file of names that version control finds changed against the base")
            command.add_argument("--untracked", help="a file of names that version control doesn't know")
            command.add_argument("--everything", action="store_true", help="take every file as changed")
        command.add_argument("--master", help="where to run; what spark-submit says, or this machine, if missing")
    given = parser.parse_args(arguments)

    from casegraph.operators.store import Store
    from casegraph.plans import diff as diffs
    from casegraph.plans import scan as scans

    spark = session(given.master)
    audit = given.audit or (f"{given.target}/.audit" if given.command in ("scan", "diff") else locate_store(spark, given.target))
    if given.command == "scan":
        print(scans.scan(spark, given.target, audit))
    elif given.command == "diff":
        feed = {side: spark.read.text(path).toDF("rel_path") for side in ("tracked", "untracked") if (path := getattr(given, side))}
        plan = diffs.diff(spark, given.target, audit, lockfile=scans.lockfile_of(spark, given.target), everything=given.everything, **feed)
        changed = plan.paths.filter("status <> 'UNAFFECTED'").count()
        print(f"changed files: {changed}, reusable dossiers: {plan.reusable.count()}")
    else:
        scan_id = given.scan_id or last_scan(Store(spark, audit))
        if given.command == "resume":
            print(f"resolved paths: {scans.resume(spark, audit, scan_id)}")
        else:
            wanted = (given.format, given.scope, given.key)
            if given.output:
                path = given.output if re.match("^[a-z0-9+]+:/", given.output) else str(Path(given.output).resolve())
                diffs.report_file(spark, audit, scan_id, path, *wanted)
            else:
                sys.stdout.writelines(diffs.report_pieces(spark, audit, scan_id, *wanted))
                print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
