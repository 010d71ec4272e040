"""python -m pagewarden.cli: audits of tables of responses, and queries over stored sessions."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .sources.storage import Store


def _spark() -> SparkSession:
    return SparkSession.builder.appName("pagewarden").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(df) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pagewarden")
    p.add_argument("--store", default="pagewarden-store", help="folder of the stored sessions")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple):
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a[0], **(a[1] if len(a) > 1 else {}))

    optional = {"default": None}
    command("audit", ("fetches",), ("--sitemap", optional), ("--target", {"default": ""}), ("--fail-on", {"choices": ["critical", "alert"], "default": None}), ("--csv", optional), ("--json", optional), ("--markdown", optional), ("--html", optional))
    command("inspect", ("fetches",), ("url",), ("--text", {"action": "store_true"}))
    command("list", ("--limit", {"type": int, "default": 20}))
    command("issues", ("session",), ("--severity", {"type": int, "default": None}), ("--category", optional), ("--code", optional), ("--url", optional), ("--limit", {"type": int, "default": 50}), ("--offset", {"type": int, "default": 0}))
    command("report", ("session",), ("--format", {"choices": ["markdown", "html", "llm", "json", "scorecard"], "default": "markdown"}))
    command("check-ai", ("robots",), ("--llms", {"action": "store_true"}))
    command("delete", ("session",))
    command("clean", ("--days", {"type": int, "default": None}))
    command("vacuum", ("--hours", {"type": float, "default": 24}))
    command("compact", ("session",))
    command("schema", ("file",))
    command("extract", ("pages",), ("--schema", {"action": "store_true"}))
    command("mcp")
    a = p.parse_args(argv)
    if a.command == "schema":
        from .sources.jsonld import validate

        found = validate(Path(a.file).read_text())
        print(json.dumps(found, indent=2))
        return 0 if found["is_valid_json"] else 1
    spark = _spark()
    store = Store(spark, a.store)
    if a.command == "audit":
        from .plans import reports
        from .plans.audit import audit

        sitemap = spark.read.parquet(a.sitemap) if a.sitemap else spark.createDataFrame([], "url string")
        found, session = audit(spark.read.parquet(a.fetches), sitemap), uuid.uuid4().hex
        store.begin(session, a.target)
        store.save(session, found)
        if a.csv:
            reports.csv_suite(found, a.csv)
        if a.json:
            reports.json_report(found, a.json)
        for path, render in ((a.markdown, reports.markdown_report), (a.html, reports.html_report)):
            if path:
                Path(path).write_text(render(found))
        print(session)
        limit = {"critical": 1, "alert": 2}.get(a.fail_on)
        return int(bool(limit and found.issues.filter(F.col("severity") <= limit).limit(1).count()))
    if a.command == "inspect":
        from .plans.audit import inspect
        from .plans.reports import inspection

        fetches = spark.read.parquet(a.fetches)
        print(inspection(fetches, a.url)) if a.text else _show(inspect(fetches, a.url))
    elif a.command == "list":
        _show(store.crawls(a.limit))
    elif a.command == "issues":
        _show(store.issues(a.session, a.severity, a.category, a.code, a.url, a.limit, a.offset))
    elif a.command == "report":
        from .plans import reports
        from .plans.audit import Audit
        from .sources.storage import TABLES

        t = {name: store.table(name, a.session) for name in TABLES}
        from .operators.score import health_score

        whole = Audit(**t, score=health_score(t["issues"], t["pages"].agg(F.count("*").alias("n"))))
        print({"markdown": reports.markdown_report, "html": reports.html_report, "llm": reports.llm_report, "json": reports.json_text, "scorecard": reports.scorecard}[a.format](whole))
    elif a.command == "check-ai":
        from .sources.robots import ai_readiness, robots_rules

        files = spark.createDataFrame([("site", Path(a.robots).read_text())], "host string, body string")
        _show(ai_readiness(robots_rules(files), spark.createDataFrame([("site", a.llms)], "host string, has_llms_txt boolean")))
    elif a.command == "delete":
        return 0 if store.delete(a.session) else 1
    elif a.command == "clean":
        print(store.clean(a.days))
    elif a.command == "vacuum":
        print(store.vacuum(a.hours))
    elif a.command == "compact":
        store.compact(a.session)
    elif a.command == "mcp":
        from .mcp import Tools, serve

        serve(Tools(spark, store))
    elif a.command == "extract":
        from .operators.site import page_documents, site_documents

        found = site_documents(page_documents(spark.read.parquet(a.pages)))
        if a.schema:
            from .plans.reports import json_schema

            print(json.dumps(json_schema(found.schema), indent=2))
        else:
            _show(found)
    return 0


if __name__ == "__main__":
    sys.exit(main())
