"""Command line: init, index, search, resolve, related, flow, serve."""

from __future__ import annotations

import argparse
import shlex
import subprocess
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.display import formatted, parse_location

EMPTY = "No results found."


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gleanery")
    top.add_argument("-s", "--storage-path", default=".gleanery")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("index", "init"):
        index = commands.add_parser(name)
        index.add_argument("path", nargs="?", default=".")
        index.add_argument("--include-tests", action="store_true")
    # another indexer that runs beside ours, with the path as its last argument
    index.add_argument("--also")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--include-tests", action="store_true")
    for name, what in (("resolve", "name"), ("related", "location"), ("flow", "query"), ("serve", "requests")):
        made = commands.add_parser(name)
        made.add_argument(what)
        if name == "flow":
            # a program that gets the best symbol's id as its last argument
            made.add_argument("--to")
    return top


def run(spark: SparkSession, argv: list[str], out=sys.stdout, lines=sys.stdin) -> int:
    args = parser().parse_args(argv)
    engine = Engine(spark, args.storage_path)
    engine.set_include_tests(getattr(args, "include_tests", False))
    if args.command in ("index", "init"):
        other = subprocess.Popen([*shlex.split(args.also), args.path]) if getattr(args, "also", None) else None
        for row in engine.index_repository(args.path).toLocalIterator():
            print(f"{row['path']}: {row['error']}", file=sys.stderr)
        print(f"Indexed {engine.store.read('symbols').count()} symbols.", file=out)
        return other.wait() if other else 0
    if args.command == "serve" and args.requests == "-":
        for line in lines:
            response = engine.answer(line)
            if response is not None:
                print(response, file=out, flush=True)
        return 0
    if args.command == "serve":
        lines = spark.read.text(args.requests).withColumn("request_id", F.monotonically_increasing_id())
        for row in engine.serve(lines).orderBy("request_id").toLocalIterator():
            print(row["response"], file=out)
        return 0
    if args.command == "related":
        file, line, error = spark.range(1).select(*(c.alias(n) for c, n in zip(parse_location(F.lit(args.location)), "fle"))).first()
        if error:
            print(error, file=sys.stderr)
            return 1
        found = engine.find_related(file, line)
    else:
        found = {"search": engine.search, "resolve": engine.resolve_symbol, "flow": engine.flow}[args.command](getattr(args, "query", None) or args.name)
    rows = found.select(formatted().alias("text"), "symbol_id").collect()
    for row in rows:
        print(row["text"], file=out)
    if not rows:
        print(EMPTY, file=out)
    elif getattr(args, "to", None):
        return subprocess.run([*shlex.split(args.to), rows[0]["symbol_id"]]).returncode
    return 0


def main() -> int:
    return run(SparkSession.builder.appName("gleanery").getOrCreate(), sys.argv[1:])
