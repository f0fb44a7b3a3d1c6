"""python -m textwarden: audit, check, report and the catalogue from the command line."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("textwarden").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _texts(spark, where: str):
    from .sources.requests import read_texts

    if Path(where).exists():
        return read_texts(spark, str(Path(where).resolve())).select("text")
    return spark.createDataFrame([(where,)], "text string")


def _print(rows, file) -> bool:
    """A JSON list of all rows, a partition at a time in memory; whether any row is blocked."""
    out, blocked = file or sys.stdout, False
    out.write("[")
    for k, x in enumerate(rows.toJSON().toLocalIterator()):
        found = json.loads(x)
        blocked = blocked or bool(found["blocked_by"])
        out.write((",\n" if k else "\n") + json.dumps(found, indent=2, ensure_ascii=False))
    out.write("\n]\n")
    if file:
        file.close()
    return blocked


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textwarden")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, about in (("audit", "verdicts of all checks, never blocking"), ("check", "exit 1 if anything is blocked")):
        a = sub.add_parser(verb, help=about)
        a.add_argument("text", help="a text, a file or a folder")
        a.add_argument("--direction", choices=("input", "output"), default="input")
        a.add_argument("--output", help="a .json file for the results, or a folder that the executors write JSON lines into")
    r = sub.add_parser("report", help="a report of an evidence table")
    r.add_argument("evidence")
    r.add_argument("output", help=".json or .html")
    c = sub.add_parser("catalog", help="list, info ID, generate ID ...")
    c.add_argument("action", choices=("list", "info", "generate"))
    c.add_argument("ids", nargs="*")
    c.add_argument("--infra")
    c.add_argument("--risk")
    c.add_argument("--query")
    c.add_argument("--on-fail", default="block")
    o = p.parse_args(argv)
    if o.verb == "catalog" and o.action == "generate":
        from .plans.catalog import guard_code

        print(guard_code(o.ids, o.on_fail))
        return 0
    spark = _session()
    if o.verb == "catalog":
        from .plans import catalog

        rows = catalog.search(spark, risk_category=o.risk, infra=o.infra, query=o.query) if o.action == "list" else catalog.get(spark, o.ids[0])
        print("\n".join(rows.toJSON().collect()))
        return 0
    if o.verb == "report":
        from pyspark.sql import functions as F

        from .plans import compliance, reports
        from .sources import evidence

        rows = evidence.load(spark, o.evidence)
        report = reports.json_report(rows, compliance.verdicts(rows, "checks", F.struct("timestamp", "id")))
        reports.save_report(reports.html_report(report) if o.output.endswith(".html") else report, o.output)
        return 0
    from .plans.guards import ParallelGuard

    guard = ParallelGuard(block_on_fail=o.verb == "check")
    rows = (guard.check_input if o.direction == "input" else guard.check_output)(_texts(spark, o.text)).select("guard.*")
    if o.output and not o.output.endswith(".json"):
        rows.write.mode("overwrite").json(o.output)
        return int(o.verb == "check" and not spark.read.schema("blocked_by array<string>").json(o.output).where("size(blocked_by) > 0").isEmpty())
    blocked = _print(rows, Path(o.output).open("w", encoding="utf-8") if o.output else None)
    return int(o.verb == "check" and blocked)


if __name__ == "__main__":
    sys.exit(main())
