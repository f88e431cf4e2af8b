"""The tool surface over JSON-RPC 2.0: a message a line, from one stream to another.

It has one tool, whose argument ``command`` picks what the engine does.
"""

from __future__ import annotations

import json
from typing import TextIO

from .plans.engine import MODES, Engine

VERSION = "2024-11-05"
TOOL = {
    "name": "notes",
    "description": "Search and read a folder of notes. command: search (query, mode, limit, folders, tags), index (force), get (path), list (path, recursive), status.",
    "inputSchema": {
        "type": "object",
        "required": ["command"],
        "properties": {
            "command": {"type": "string", "enum": ["search", "index", "get", "list", "status"]},
            "query": {"type": "string"},
            "mode": {"type": "string", "enum": list(MODES)},
            "limit": {"type": "integer"},
            "folders": {"type": "array", "items": {"type": "string"}},
            "tags": {"type": "array", "items": {"type": "string"}},
            "force": {"type": "boolean"},
            "path": {"type": "string"},
            "recursive": {"type": "boolean"},
        },
    },
}


def answer(engine: Engine, message: dict) -> dict | None:
    """The response to a request; None to a notification."""
    if "id" not in message:
        return None
    method, asked = message.get("method"), message.get("params") or {}
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": asked.get("protocolVersion", VERSION), "capabilities": {"tools": {}}, "serverInfo": {"name": "quernel", "version": "2"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [TOOL]}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
    if asked.get("name") != TOOL["name"]:
        return reply | {"error": {"code": -32602, "message": f"no tool {asked.get('name')}"}}
    given = {k: v for k, v in (asked.get("arguments") or {}).items() if k in TOOL["inputSchema"]["properties"] and v is not None}
    try:
        text, failed = engine.call(given.pop("command", ""), **given), False
    except Exception as e:  # noqa: BLE001  the caller gets it, and the server goes on
        text, failed = f"Error: {e}", True
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(engine: Engine, requests: TextIO, responses: TextIO) -> None:
    """Answers line by line until the requests end; a line that isn't a message gets an error without an id."""
    for line in requests:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            if not isinstance(message, dict):
                raise ValueError("not an object")
        except ValueError as e:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        else:
            out = answer(engine, message)
        if out is not None:
            responses.write(json.dumps(out, ensure_ascii=False) + "\n")
            responses.flush()
