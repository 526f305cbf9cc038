"""Command line: ``python -m pipewright '<query>'``; ``serve`` answers agents on standard input and output."""

from __future__ import annotations

import io
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .api import configured
from .errors import QueryError, WriteError
from .lang.parser import parse
from .plans.planner import plan_query
from .sinks.distributed import reachable, write_distributed
from .sinks.files import write_files
from .sinks.writers import WRITERS
from .sources.files import remote

VERSION = "0.1.0"
GUIDE = """\
A query is a file, or '-' for standard input, and stages that '|' parts:
  users.csv | filter { age > 30 } | group city | reduce n = count(), a = avg(age) | remove grouped | sort -n | json
Stages: head tail filter select remove rename transform sort distinct group reduce count describe join
Output: table (default) csv json jsonl avro parquet, with 'to PATH', 'with overwrite=true, split_rows=N'
Start with 'FILE | describe' to see columns and their types.
"""
USAGE = f"usage: pipewright [-h] [-v] [--guide] [serve | mcp] [--] QUERY...\n\n{GUIDE}"
TOOL = {
    "name": "query",
    "description": "Run a query over CSV, JSON, JSON lines, Avro or Parquet files.",
    "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"], "additionalProperties": False},
}
GUIDE_URI = "pipewright://guide"


def session() -> SparkSession:
    builder = SparkSession.builder.appName("pipewright").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return configured(builder.getOrCreate())


def execute(spark: SparkSession, text: str, out, stdin=None, base: str | None = None) -> None:
    """Run a query and write its result to ``out``, or to the files that it names. Executors write files that they can reach;
    tables, and files on the driver's own disk, are written row by row here."""
    query = parse(text)
    plan = plan_query(configured(spark), query, stdin, base)
    path = query.output.path
    if path is not None and query.output.format != "table" and reachable(spark, path, base):
        write_distributed(plan.state(ordered=True), plan.schema, query.output, base)
        return
    if path is not None and remote(path):
        raise WriteError("a table can only be written to a local path")
    rows = plan.dataframe(ordered=True).toLocalIterator()
    if path is not None:
        write_files(rows, plan.schema, query.output, base)
    else:
        WRITERS[query.output.format](rows, plan.schema, out)


def answer(spark, request: dict) -> dict | None:
    """One JSON-RPC message; None for notifications."""
    method, params, number = request.get("method"), request.get("params") or {}, request.get("id")
    if number is None:
        return None
    reply = lambda result: {"jsonrpc": "2.0", "id": number, "result": result}
    failed = lambda code, message: {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}
    if method == "initialize":
        return reply({"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "pipewright", "version": VERSION}})
    if method == "ping":
        return reply({})
    if method == "tools/list":
        return reply({"tools": [TOOL]})
    if method == "resources/list":
        return reply({"resources": [{"uri": GUIDE_URI, "name": "guide", "mimeType": "text/plain"}]})
    if method == "resources/read":
        if params.get("uri") != GUIDE_URI:
            return failed(-32602, "unknown resource")
        return reply({"contents": [{"uri": GUIDE_URI, "mimeType": "text/plain", "text": GUIDE}]})
    if method == "tools/call":
        text = (params.get("arguments") or {}).get("query")
        if params.get("name") != "query" or not isinstance(text, str):
            return failed(-32602, "the only tool is query, with a string 'query'")
        out = io.BytesIO()
        try:
            execute(spark() if callable(spark) else spark, text, out)
        except (QueryError, PySparkException, OSError) as e:
            return reply({"content": [{"type": "text", "text": message_of(e)}], "isError": True})
        return reply({"content": [{"type": "text", "text": out.getvalue().decode("utf-8", "replace")}], "isError": False})
    return failed(-32601, f"unknown method {method}")


def serve(spark, lines, out) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            reply: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            reply = answer(spark, request) if isinstance(request, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        if reply is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()


def message_of(e: BaseException) -> str:
    """The user's part of an error: raise_error's text without Spark's frame."""
    text = str(e)
    if "[USER_RAISED_EXCEPTION]" in text:
        text = text.split("[USER_RAISED_EXCEPTION]", 1)[1].split("SQLSTATE")[0].strip()
    return text.split("\nJVM stacktrace")[0].strip()


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if args[:1] in (["-h"], ["--help"]):
        print(USAGE)
        return 0
    if args[:1] in (["-v"], ["--version"]):
        print(VERSION)
        return 0
    if args[:1] in (["--guide"], ["-agent-guide"]):
        print(GUIDE)
        return 0
    if args[:1] in (["serve"], ["mcp"]):
        serve(session, sys.stdin, sys.stdout)
        return 0
    args = args[1:] if args[:1] == ["--"] else args
    if not args:
        print(USAGE, file=sys.stderr)
        return 2
    try:
        execute(session(), " ".join(args), sys.stdout.buffer, sys.stdin.buffer)
    except (QueryError, PySparkException, OSError) as e:
        print(f"error: {message_of(e)}", file=sys.stderr)
        return 1
    return 0
