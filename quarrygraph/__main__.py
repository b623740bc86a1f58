"""The command line: python -m quarrygraph COMMAND. `query` exits with 1 if the node isn't there, `confirm` if the edge isn't."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import consistency, graph, snapshots
from .plans import project, report, timeline
from .sources import attempts, config, files, store


def hops(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrygraph")
    p.add_argument("--store", required=True, help="folder of the store, which all executors share")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("ingest", help="read a project's folder into the store")
    c.add_argument("root")
    c.add_argument("--log", help="an exported history")
    c.add_argument("--blame", help="a folder of exported line histories")
    c = commands.add_parser("status", help="count nodes and edges by type")
    c.add_argument("--pending", action="store_true", help="list the edges that wait for a judgement")
    c.add_argument("--limit", type=hops, help="only so many of them")
    c = commands.add_parser("find", help="nodes whose id or title has a text")
    c.add_argument("text")
    c.add_argument("--type", choices=graph.NODE_TYPES)
    c = commands.add_parser("query", help="a node and its edges")
    c.add_argument("node")
    c = commands.add_parser("trace", help="edges around a node")
    c.add_argument("node")
    c.add_argument("--hops", type=hops, default=4)
    c = commands.add_parser("attempts", help="bring the table of attempts into the store and list it")
    c.add_argument("root")
    c.add_argument("--check", action="store_true", help="check it; 1 if anything is found, skipped checks don't count")
    c = commands.add_parser("lineage", help="what scripts read and write; 1 if data is read that nothing writes, or a file is missing")
    c.add_argument("root")
    c = commands.add_parser("confirm", help="judge an edge")
    for part in graph.EDGE_KEY:
        c.add_argument(part, nargs="?")
    c.add_argument("--index", type=hops, help="the edge with this number in the pending queue, instead of its key")
    c.add_argument("--status", choices=snapshots.JUDGED, default="confirmed")
    return p


def show(df: DataFrame) -> int:
    """Print the rows as JSON lines, a partition at a time; how many there were."""
    n = 0
    for row in df.select(F.to_json(F.struct("*"))).toLocalIterator():
        print(row[0])
        n += 1
    return n


def confirm(spark: SparkSession, root: str, key: list[str], status: str) -> bool:
    """Give the edge its status; False if there is none with the key."""
    held = store.read(spark, root, "edges")
    judged = spark.createDataFrame([(*key, status)], ", ".join(f"{k} string" for k in graph.EDGE_KEY) + ", new_status string")
    if held is None or held.join(judged, graph.EDGE_KEY, "left_semi").isEmpty():
        return False
    store.update(spark, root, lambda nodes, edges: (nodes, snapshots.set_status(edges, judged)))
    return True


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quarrygraph").getOrCreate()
    if args.command == "ingest":
        print(project.ingest(spark, args.root, args.store, args.log, args.blame))
        return 0
    if args.command == "confirm":
        key = [getattr(args, k) for k in graph.EDGE_KEY]
        if args.index is not None:
            held = store.read(spark, args.store, "edges")
            row = held and graph.nth(held, "pending", args.index).first()
            key = [row[k] for k in graph.EDGE_KEY] if row else [None]
        return 0 if None not in key and confirm(spark, args.store, key, args.status) else 1
    if args.command == "attempts":
        try:
            print(json.dumps(timeline.sync(spark, args.root, args.store)))
        except (config.ConfigError, attempts.TableNotFound) as e:
            print(f"Error: {e}", file=sys.stderr)
            return 1
        if not args.check:
            show(consistency.listing(attempts.stored(store.read(spark, args.store, "nodes"))))
            return 0
        found = 0
        for name, check in timeline.checks(spark, args.root, args.store).items():
            if check.findings is None:
                print(json.dumps({"check": name, "skipped": check.skipped}))
            else:
                show(check.coverage.select(F.lit(name).alias("check"), "*"))
                found += show(check.findings.select(F.lit(name).alias("check"), "*"))
        return 1 if found else 0
    nodes, edges = store.read(spark, args.store, "nodes"), store.read(spark, args.store, "edges")
    if nodes is None or edges is None:
        print("Error: the store is empty", file=sys.stderr)
        return 1
    if args.command == "status":
        if args.pending:
            rows, total = (graph.queue(edges), None) if args.limit is None else graph.page(edges, "pending", args.limit)
            n = show(graph.with_location(rows, nodes).orderBy(*graph.EDGE_KEY))
            if total is not None and total > n:
                print(json.dumps({"shown": n, "pending": total}))
        else:
            show(graph.counts_by_type(nodes, graph.NODE_TYPES))
            show(graph.counts_by_type(edges, graph.EDGE_TYPES))
    elif args.command == "find":
        show(graph.find(nodes, args.text, args.type))
    elif args.command == "query":
        found = show(nodes.filter(F.col("id") == args.node))
        show(graph.with_location(graph.neighbors(edges, args.node), nodes))
        return 0 if found else 1
    elif args.command == "lineage":
        blocks = report.report(nodes, edges, files.inventory(spark, args.root))
        n = {name: show(block.select(F.lit(name).alias("block"), "*")) for name, block in blocks.items()}
        return 1 if n["orphans"] or n["broken_links"] else 0
    else:
        show(graph.with_location(graph.trace(nodes, edges, args.node, args.hops), nodes))
    return 0


if __name__ == "__main__":
    sys.exit(main())
