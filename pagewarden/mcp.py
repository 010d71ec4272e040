"""Tools over stored sessions for language models: JSON-RPC, a message a line, on standard input and output."""

from __future__ import annotations

import json
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.score import health_score
from .plans import reports
from .plans.audit import Audit, audit, inspect
from .sources import jsonld
from .sources.robots import ai_readiness, robots_rules
from .sources.storage import TABLES, Store


class Tools:
    """The tools by name; each takes a dictionary and returns what JSON can say."""

    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]  # callers limit what they ask for

    def _audit(self, session: str) -> Audit:
        t = {name: self.store.table(name, session) for name in TABLES}
        return Audit(**t, score=health_score(t["issues"], t["pages"].agg(F.count("*").alias("n"))))

    def start_audit(self, a: dict) -> dict:
        """fetches: folder of responses; sitemap: folder of urls, optional."""
        sitemap = self.spark.read.parquet(a["sitemap"]) if a.get("sitemap") else self.spark.createDataFrame([], "url string")
        session = uuid.uuid4().hex
        self.store.begin(session, a.get("target", ""))
        self.store.save(session, audit(self.spark.read.parquet(a["fetches"]), sitemap))
        return {"session_id": session}

    def audit_status(self, a: dict) -> list[dict]:
        """session_id: one session's state; without it the latest sessions."""
        known = self.store.crawls(None if a.get("session_id") else 20)
        return self._rows(known.filter(F.col("session_id") == a["session_id"]) if a.get("session_id") else known)

    def markdown_report(self, a: dict) -> str:
        """session_id."""
        return reports.llm_report(self._audit(a["session_id"]), a.get("groups", 10))

    def quick_page_check(self, a: dict) -> list[dict]:
        """fetches, url."""
        return self._rows(inspect(self.spark.read.parquet(a["fetches"]), a["url"]))

    def query_issues(self, a: dict) -> dict:
        """session_id; severity, category, code, url_part, limit, offset are optional."""
        filters = {k: a[k] for k in ("severity", "category", "code", "url_part") if a.get(k) is not None}
        found = self.store.issues(a["session_id"], limit=min(int(a.get("limit", 50)), 1000), offset=int(a.get("offset", 0)), **filters)
        return {"total": self.store.count_issues(a["session_id"], **filters), "issues": self._rows(found)}

    def check_ai_readiness(self, a: dict) -> list[dict]:
        """robots_txt, has_llms_txt."""
        rules = robots_rules(self.spark.createDataFrame([("site", a.get("robots_txt", ""))], "host string, body string"))
        return self._rows(ai_readiness(rules, self.spark.createDataFrame([("site", bool(a.get("has_llms_txt")))], "host string, has_llms_txt boolean")))

    def validate_schema(self, a: dict) -> dict:
        """schema: JSON-LD, or a page with blocks of it."""
        return jsonld.validate(a["schema"])

    def cleanup_session(self, a: dict) -> dict:
        """session_id, or days: sessions older than that."""
        return {"deleted": int(self.store.delete(a["session_id"])) if a.get("session_id") else self.store.clean(a.get("days"))}

    def names(self) -> list[dict]:
        tools = [f for f in vars(type(self)) if not f.startswith("_") and f != "names"]
        return [{"name": f, "description": getattr(self, f).__doc__ or "", "inputSchema": {"type": "object"}} for f in tools]


def answer(tools: Tools, message: dict) -> dict | None:
    """The response to one message; None for notifications."""
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    try:
        if method == "initialize":
            result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "pagewarden", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": tools.names()}
        elif method == "tools/call" and params.get("name") in {t["name"] for t in tools.names()}:
            out = getattr(tools, params["name"])(params.get("arguments") or {})
            result = {"content": [{"type": "text", "text": out if isinstance(out, str) else json.dumps(out, default=str, ensure_ascii=False)}]}
        elif method == "resources/list":
            result = {"resources": [{"uri": "audit://sessions", "name": "sessions"}]}
        elif method == "resources/read":
            result = {"contents": [{"uri": params.get("uri"), "text": json.dumps(tools.audit_status({}), default=str)}]}
        else:
            return reply | {"error": {"code": -32601, "message": f"no such method: {method}"}}
        return reply | {"result": result}
    except Exception as e:  # the caller gets the error, the server goes on
        return reply | {"error": {"code": -32000, "message": f"{type(e).__name__}: {str(e)[:500]}"}}


def serve(tools: Tools, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(tools, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            print(json.dumps(reply, default=str), file=out, flush=True)
