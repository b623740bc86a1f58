"""Graph queries over nodes (id, type, title) and edges (src, dst, type, extractor, status)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut

# The vocabularies of nodes and edges, and the edge types that a trace follows.
NODE_TYPES = ("project", "experiment", "commit", "figure", "section", "claim", "reference", "contributor", "attempt", "script", "dataset")
EDGE_TYPES = ("implements", "produces", "generates", "includes", "cites", "authored_by", "backed_by", "supports", "uses", "reads", "writes")
TRACE_TYPES = ("implements", "produces", "generates", "includes", "cites", "authored_by", "backed_by", "supports")
STATUSES = ("auto", "pending", "confirmed", "rejected")
EDGE_KEY = ["src", "dst", "type", "extractor"]


def distances(edges: DataFrame, start: str, max_hops: int) -> DataFrame:
    """(node, dist) of all nodes within max_hops of start. Each level meets the edges in two equality joins, one for either end, and drops what was
    seen; only frontiers are written."""
    spark = edges.sparkSession
    ends = edges.select("src", "dst")
    seen = frontier = spark.createDataFrame([(start, 0)], "node string, dist int")
    for hop in range(1, max_hops + 1):
        out = ends.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"))
        back = ends.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"))
        reached = out.union(back).distinct()
        frontier = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("dist", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def trace(nodes: DataFrame, edges: DataFrame, start: str, max_hops: int = 4, edge_types: tuple[str, ...] = TRACE_TYPES) -> DataFrame:
    """Every edge of the given types within max_hops of start, in either direction, with its depth. Empty if start is no node."""
    if max_hops < 1:
        raise ValueError("max_hops must be 1 or more")
    edges = edges.filter(F.col("type").isin(list(edge_types)))
    if nodes.filter(F.col("id") == start).isEmpty():
        return edges.select(*EDGE_KEY, "status", F.lit(1).alias("depth")).limit(0)
    # An edge of the last level has an end that is one nearer, so that level's nodes are not needed.
    near = distances(edges, start, max_hops - 1)
    at_src, at_dst = near.select(F.col("node").alias("src"), F.col("dist").alias("ds")), near.select(F.col("node").alias("dst"), F.col("dist").alias("dd"))
    found = edges.join(at_src, "src", "left").join(at_dst, "dst", "left").filter("ds is not null or dd is not null")
    return found.select(*EDGE_KEY, "status", (F.least("ds", "dd") + 1).alias("depth"))


# Where a claim's node keeps its place.
LOCATION = "tex_path string, line int"


def claim_locations(nodes: DataFrame) -> DataFrame:
    """(id, file, line) of the claims whose attrs tell a line."""
    at = F.from_json("attrs", LOCATION)
    return nodes.filter(F.col("type") == "claim").select("id", at.alias("at")).filter("at.line is not null").select("id", F.col("at.tex_path").alias("file"), "at.line")


def with_location(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with source_file and source_line: of `backed_by` edges the place at which the claim at their source, or else at their target, stands now."""
    at = claim_locations(nodes)
    side = lambda end: at.select(F.when(F.col("id").isNotNull(), F.col("id")).alias(end), F.lit("backed_by").alias("type"), F.struct("file", "line").alias(f"_{end}"))
    out = edges.join(side("src"), ["src", "type"], "left").join(side("dst"), ["dst", "type"], "left")
    found = F.coalesce("_src", "_dst")
    return out.select(*edges.columns, found["file"].alias("source_file"), found["line"].alias("source_line"))


def select(edges: DataFrame, **terms: str | None) -> DataFrame:
    """Edges that agree with all terms given (src, dst, type, extractor, status); a term of None asks for nothing."""
    unknown = set(terms) - {*EDGE_KEY, "status"}
    if unknown:
        raise ValueError(f"unknown terms: {', '.join(sorted(unknown))}")
    return reduce(lambda df, kv: df.filter(F.col(kv[0]) == kv[1]), [(k, v) for k, v in terms.items() if v is not None], edges)


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    """Edges out of and into a node; an edge onto itself is in both lists."""
    out = edges.filter(F.col("src") == node).select(F.lit("out").alias("direction"), *EDGE_KEY, "status")
    return out.unionByName(edges.filter(F.col("dst") == node).select(F.lit("in").alias("direction"), *EDGE_KEY, "status"))


def counts_by_type(df: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(type, n) for every known type, 0 where there is none."""
    known = df.sparkSession.createDataFrame([(t,) for t in types], "type string")
    return known.join(df.groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def find(nodes: DataFrame, text: str, node_type: str | None = None) -> DataFrame:
    """Nodes whose id or title has the text, in whatever case; % and _ stand for themselves."""
    needle = text.lower()
    out = nodes.filter(F.contains(F.lower("id"), F.lit(needle)) | F.coalesce(F.contains(F.lower("title"), F.lit(needle)), F.lit(False)))
    return out if node_type is None else out.filter(F.col("type") == node_type)


def queue(edges: DataFrame, status: str = "pending", n: int | None = None) -> DataFrame:
    """Edges of a status in the order of their key; the first n of them."""
    out = edges.filter(F.col("status") == status).orderBy(*EDGE_KEY)
    return out if n is None else out.limit(n)


def nth(edges: DataFrame, status: str, index: int) -> DataFrame:
    """The edge with the number index, from 1, in the queue of a status; no row if there are fewer."""
    return queue(edges, status).offset(index - 1).limit(1) if index > 0 else edges.limit(0)


def page(edges: DataFrame, status: str, n: int) -> tuple[DataFrame, int]:
    """The first n edges of a queue, and how many it has, so that what is left out can be told."""
    return queue(edges, status, n), edges.filter(F.col("status") == status).count()


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is no node. Each end is looked up once, in one pass over the edges."""
    src, dst = nodes.select(F.col("id").alias("src"), F.lit(True).alias("_s")).distinct(), nodes.select(F.col("id").alias("dst"), F.lit(True).alias("_d")).distinct()
    return edges.join(src, "src", "left").join(dst, "dst", "left").filter("_s is null or _d is null").select(*edges.columns).dropDuplicates(EDGE_KEY)
