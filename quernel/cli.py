"""Command line: index, search, list, get, watch, serve, status, config."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections import defaultdict
from dataclasses import asdict

from pyspark.sql import SparkSession

from .config import global_file, load, registered_default, resolve_root
from .functions.embed import Health, HashingEmbedder, HttpEmbedder, find_endpoint, health
from .plans.engine import MODES, Engine
from .sources import notes, render
from .server import serve
from .streaming import watch as watching


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quernel")
    p.add_argument("--root", default=os.environ.get("VAULT_PATH"))
    p.add_argument("--offline", action="store_true", help="hashed words instead of an embedding endpoint")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--force", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-k", "--limit", type=int)
    s.add_argument("-f", "--folder", action="append")
    s.add_argument("-e", "--exclude", action="append")
    s.add_argument("-t", "--tag", action="append")
    s.add_argument("-m", "--mode", choices=MODES, default="hybrid")
    s.add_argument("--threshold", type=float)
    s.add_argument("-C", "--context", type=int, default=0)
    s.add_argument("--since")
    s.add_argument("--strict", action="store_true", help="folders and tags hold for full-text hits too")
    s.add_argument("--json", action="store_true")
    x = sub.add_parser("list")
    x.add_argument("path", nargs="?", default="")
    x.add_argument("-r", "--recursive", action="store_true")
    sub.add_parser("get").add_argument("path")
    w = sub.add_parser("watch")
    w.add_argument("action", nargs="?", choices=("start", "stop", "status"), default="start")
    sub.add_parser("serve")
    sub.add_parser("status")
    sub.add_parser("config").add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    root = resolve_root(args.root, os.getcwd(), global_file(), registered_default())
    config = load(root, global_file(), None if args.offline or args.command in ("list", "get") else find_endpoint)
    if args.command == "watch" and args.action != "start":
        pid = watching.running(config)
        if pid and args.action == "stop":
            watching.stop(config)
        print(f"watching, process {pid}" + (", told to stop" if args.action == "stop" else "") if pid else "not watching")
        return 0
    if args.command == "config":
        shown = asdict(config)
        shown["embedding"]["api_key"] = "set" if config.embedding.api_key else None
        print(json.dumps(shown, indent=2) if args.json else "\n".join(f"{k}: {v}" for k, v in shown.items()))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, root, config, HashingEmbedder() if args.offline else HttpEmbedder(config.embedding))
    if args.command == "index":
        if not args.offline and (found := health(config.embedding))[0] is not Health.OK:
            print(f"Error: {found[0].value}: {found[1]}")
            return 1
        print(engine.refresh(args.force))
    elif args.command == "search":
        response = engine.search(args.query, args.limit, args.mode, args.folder, args.tag, args.exclude, args.threshold, args.since, strict=args.strict)
        if args.json:
            print(response.to_json())
        else:
            near = defaultdict(list)
            if args.context:
                for r in engine.context(response.results, args.context).orderBy("path", "start_line", "line_no").collect():
                    near[r.path, r.start_line].append(r)
            print(render.to_text(response.results.collect(), response.linked_notes.collect(), near))
    elif args.command == "list":
        print(notes.listing(engine.list(args.path, args.recursive)))
    elif args.command == "get":
        print(engine.get(args.path))
    elif args.command == "status":
        print(engine.call("status"))
    elif args.command == "serve":
        serve(engine, sys.stdin, sys.stdout)
    else:
        watching.run(engine, report=print)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
