"""Command line: list, recall, forget, export, import, stats, list-users, update."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrywell.engine import Memory


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrywell")
    p.add_argument("--path", required=True, help="folder of the memory table")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"list": ["user"], "recall": ["user", "query"], "forget": ["user"], "export": ["file"], "import": ["file"], "stats": [], "list-users": [], "update": ["id"]}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name == "recall":
            s.add_argument("--top-k", type=int, default=5)
        elif name == "forget":
            s.add_argument("--id")
            s.add_argument("--yes", action="store_true")
        elif name == "update":
            s.add_argument("--content")
            s.add_argument("--importance", type=float)
    return p


def run(args: argparse.Namespace, memory: Memory, out=sys.stdout, ask=input) -> int:
    say = lambda *x: print(*x, file=out)
    if args.command in ("list", "recall"):
        rows = memory.table.get_all_by_user(args.user).orderBy("seq") if args.command == "list" else memory.recall(args.user, args.query, args.top_k)
        for r in rows.select("memory_id", "content").collect():
            say(r["memory_id"], r["content"])
    elif args.command == "forget":
        if not args.yes and ask(f"Forget {args.id or 'all'} of {args.user}? [y/n] ").strip().lower() != "y":
            return 1
        say(memory.forget(args.user, args.id))
    elif args.command == "export":
        say(memory.export(args.file))
    elif args.command == "import":
        say(memory.import_from(args.file))
    elif args.command == "stats":
        from quarrywell.operators.stats import global_stats

        say(json.dumps(global_stats(memory.table.get_all()).first().asDict() | {"bytes": memory.table.size()}))
    elif args.command == "list-users":
        for r in memory.table.get_all().groupBy("user_id").agg(F.count("*").alias("n")).orderBy("user_id").collect():
            say(r["user_id"], r["n"])
    elif args.command == "update":
        say(memory.update(args.id, args.content, args.importance))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(args, Memory(spark, args.path))


if __name__ == "__main__":
    sys.exit(main())
