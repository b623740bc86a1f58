"""The lineage report over a store's edges: orphans, chains, broken links and other copies of what scripts read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lineage

OCCURRENCE = "file string, line int, callee string, missing boolean"


def uses(edges: DataFrame) -> DataFrame:
    """(target, script, kind, missing, is_data, line, callee): one row for each place where a script reads or writes a file."""
    seen = edges.filter(F.col("type").isin("reads", "writes")).select("dst", "type", F.explode("occurrences").alias("o"))
    rows = seen.select("dst", "type", F.from_json("o", OCCURRENCE).alias("o"))
    return rows.select(F.col("dst").alias("target"), F.col("o.file").alias("script"), F.col("type").alias("kind"), F.coalesce("o.missing", F.lit(False)).alias("missing"), F.col("dst").startswith("dataset:").alias("is_data"), "o.line", "o.callee")


def report(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The report's blocks by name; files (path) are the project's own, among which copies are looked for."""
    found = uses(edges)
    of = lambda kind: edges.filter(F.col("type") == kind)
    both = of("reads").unionByName(of("writes"))
    n = lambda kind: F.coalesce(F.sum((F.col("type") == kind).cast("long")), F.lit(0))
    # Scripts are counted in the same pass as edges, as rows without a target.
    rows = both.select("dst", "type", F.lit(0).alias("script")).union(nodes.filter("type = 'script'").select(F.lit(None), F.lit(None), F.lit(1)))
    counts = rows.agg(F.coalesce(F.sum("script"), F.lit(0)).alias("scripts"), n("reads").alias("reads_edges"), n("writes").alias("writes_edges"), F.count_distinct("dst").alias("targets"))
    read = found.filter("kind = 'reads' and is_data").select(F.regexp_replace("target", "^dataset:", "").alias("path"))
    return {
        "scanned": counts,
        "orphans": lineage.orphans(found).orderBy("target"),
        "chains": lineage.chains(found).orderBy("target"),
        "broken_links": found.filter("missing").select("script", "line", "callee", "kind", "target").orderBy("script", "line", F.when(F.col("kind") == "reads", 0).otherwise(1), "target", "callee"),
        "duplicates": lineage.duplicates(read, files).orderBy("base", "path"),
    }
