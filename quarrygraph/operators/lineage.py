"""Data lineage: which scripts read and write which files (target, script, kind, missing, is_data)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename


def scanned(uses: DataFrame) -> DataFrame:
    return uses.agg(F.countDistinct("script").alias("scripts"), F.countDistinct("target").alias("targets"), F.coalesce(F.sum((F.col("kind") == "reads").cast("long")), F.lit(0)).alias("reads"), F.coalesce(F.sum((F.col("kind") == "writes").cast("long")), F.lit(0)).alias("writes"))


def by_target(uses: DataFrame) -> DataFrame:
    """Readers and writers of each target, counted; one aggregation serves chains and orphans."""
    return uses.groupBy("target").agg(
        F.max("is_data").alias("is_data"), F.coalesce(F.sum((F.col("kind") == "reads").cast("long")), F.lit(0)).alias("n_reads"), F.coalesce(F.sum((F.col("kind") == "writes").cast("long")), F.lit(0)).alias("n_writes"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == "writes", F.col("script")))), ",").alias("writers"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == "reads", F.col("script")))), ",").alias("readers"),
    )


def chains(uses: DataFrame) -> DataFrame:
    return by_target(uses).filter("n_reads > 0 AND n_writes > 0").select("target", "n_reads", "n_writes", "writers", "readers")


def orphans(uses: DataFrame) -> DataFrame:
    """Data that is read but that nothing writes."""
    return by_target(uses).filter("n_reads > 0 AND n_writes = 0 AND is_data").select("target", "n_reads", "readers")


def broken(uses: DataFrame) -> DataFrame:
    return uses.filter("missing").select("script", "target", "kind").distinct()


def duplicates(read: DataFrame, files: DataFrame) -> DataFrame:
    """(base, path, n): each read path whose base name other files have too, with the number of all files of that name, and a row for each
    of those; a group is its members, never its pairs."""
    index = files.select("path", basename(F.col("path")).alias("base")).distinct()
    asked = read.select("path", basename(F.col("path")).alias("base")).distinct()
    shared = index.unionByName(asked).distinct().groupBy("base").agg(F.count("*").alias("n")).filter("n > 1")
    members = index.join(shared, "base").join(asked.select("base").distinct(), "base", "left_semi")
    is_read = asked.select("base", "path", F.lit(True).alias("_read"))
    return members.unionByName(asked.join(shared, "base").select(members.columns)).distinct().join(is_read, ["base", "path"], "left").select("base", "path", "n", F.coalesce("_read", F.lit(False)).alias("is_read"))


def named(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """targets with the title and type of their nodes; of a target that is no node, what its id tells."""
    known = nodes.select(F.col("id").alias("target"), F.col("title").alias("_title"), F.col("type").alias("_type"))
    out = targets.join(known, "target", "left")
    return out.select(*targets.columns, F.coalesce("_title", F.expr("substring(target, instr(target, ':') + 1)")).alias("title"), F.coalesce("_type", F.expr("substring_index(target, ':', 1)")).alias("node_type"))
