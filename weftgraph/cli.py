"""Command line: create, status, query, explain, compact, validate, catalog, projections, indexes."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from weftgraph.session import session
from weftgraph.store import GraphStore


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftgraph")
    parser.add_argument("command", choices=["create", "status", "query", "explain", "compact", "validate", "catalog", "projections", "indexes"])
    parser.add_argument("path")
    parser.add_argument("rest", nargs="*", help="a statement, or the folder for a compacted store")
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "create":
        GraphStore.create(spark, args.path)
        return 0
    store = GraphStore.open(spark, args.path)
    show = lambda df: [print(line) for line in df.toJSON().toLocalIterator()]
    if args.command == "status":
        show(store.stats())
    elif args.command == "query":
        show(store.query(" ".join(args.rest)))
    elif args.command == "explain":
        print(store.explain(" ".join(args.rest)))
    elif args.command == "compact":
        store.compact().save(args.rest[0])
    elif args.command == "validate":
        bad = store.validate()
        show(bad)
        return int(not bad.isEmpty())
    else:
        kinds = asdict(store.catalog)
        print(json.dumps(kinds if args.command == "catalog" else kinds[args.command]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
