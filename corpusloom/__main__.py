"""python -m corpusloom <command>: the engine's passes and queries. A wrong or missing command ends with 2."""

from __future__ import annotations

import argparse
import json
import sys

from corpusloom import config, obs

COMMANDS = ("db-ping", "migrate", "embed-smoke", "index", "enrich", "rollup", "ingest", "link", "confluence-sync", "agents-md", "search", "usages", "deps")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        if name in ("index", "enrich", "rollup", "ingest", "link", "agents-md", "search", "usages", "deps"):
            p.add_argument("target")
        if name == "confluence-sync":
            p.add_argument("space")
            p.add_argument("target")
        p.add_argument("--repo")
        p.add_argument("--limit", type=int, default=10)
        if name in ("index", "enrich"):
            p.add_argument("--subpath")
            p.add_argument("--include-tests", action="store_true")
        if name == "index":
            p.add_argument("--prune", action="store_true")
        if name == "agents-md":
            p.add_argument("--force", action="store_true")
    return top


def run(args, engine):
    c, repo = args.command, args.repo
    if c == "db-ping":
        return engine.table_counts()
    if c == "migrate":
        return {"version": engine.store.migrate()}
    if c == "embed-smoke":
        return {"dim": len(engine._query_vector("smoke"))}
    if c == "index":
        return engine.index_repo(args.target, repo, args.subpath, args.include_tests, args.prune)
    if c == "enrich":
        return engine.enrich_repo(args.target, repo, args.subpath, args.include_tests)
    if c == "rollup":
        return engine.rollup_repo(args.target, repo)
    if c == "ingest":
        return engine.ingest_docs(args.target, repo)
    if c == "link":
        return engine.link_docs(args.target)
    if c == "confluence-sync":
        return engine.sync_space(args.space, args.target)
    if c == "agents-md":
        return engine.write_starter(args.target, repo, force=args.force)
    rows = {"search": engine.search_code, "usages": engine.find_usages, "deps": engine.get_deps}[c](args.target, args.limit, repo)
    return [r.asDict(True) for r in rows.collect()]


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    from pyspark.sql import SparkSession

    from corpusloom.plans.engine import Engine

    with obs.timed("run", command=args.command):
        print(json.dumps(run(args, Engine(SparkSession.builder.appName("corpusloom").getOrCreate(), config.load())), default=str, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
