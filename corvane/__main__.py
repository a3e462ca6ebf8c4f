"""python -m corvane audit [--workspace PATH]: audits a workspace into its report folder."""

from __future__ import annotations

import argparse
import datetime
import os
import sys

VERSION = "0.1.0"


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="corvane")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit", help="write report.json, brief.json, brief.md and report.html")
    a.add_argument("--workspace", "-w", default=".")
    return p.parse_args(argv)


def main(argv: list[str]) -> int:
    args = arguments(argv)
    from pyspark.sql import SparkSession

    from corvane.plans import audit, views

    spark = SparkSession.builder.appName("corvane").getOrCreate()
    root = os.path.abspath(args.workspace)
    a = audit.audit(spark, root)
    out = audit.write(a, root, datetime.datetime.now(datetime.timezone.utc).isoformat())
    with open(os.path.join(out, "report.html"), "w", encoding="utf-8") as f:
        f.write(views.html_report(a.findings, a.groups, a.occurrences, a.hotspots, a.cycles))
    print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
