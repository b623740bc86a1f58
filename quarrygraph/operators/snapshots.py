"""Upserts over snapshots: a delta meets the stored rows in one join, and a new snapshot comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import fold, in_order
from .graph import EDGE_KEY

JUDGED = ("confirmed", "rejected")


def latest(delta: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key. Aggregation by maximum, so equal keys meet only after they were reduced where they lie."""
    rest = [c for c in delta.columns if c not in key]
    return delta.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_x")).select(*key, *(F.col(f"_x.{c}").alias(c) for c in rest))


def upsert(held: DataFrame, delta: DataFrame, key: list[str], seq: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """held with the last row of each key of delta in place of its own; the columns `kept` of a held row stay as they are."""
    new = latest(delta, key, seq).drop(seq).withColumn("_new", F.lit(True))
    h, n = held.alias("h"), new.alias("n")
    cols = [F.coalesce(f"h.{k}", f"n.{k}").alias(k) for k in key]
    for c in held.columns:
        if c not in key:
            # Which side has the row decides, not whether the value is null.
            cols.append(F.when(F.col("n._new") & ~(F.lit(c in kept) & F.col("h._old").isNotNull()), F.col(f"n.{c}") if c in new.columns else F.lit(None)).otherwise(F.col(f"h.{c}")).alias(c))
    return h.withColumn("_old", F.lit(True)).alias("h").join(n, [F.col(f"h.{k}") == F.col(f"n.{k}") for k in key], "full_outer").select(*cols)


def upsert_edges(held: DataFrame, delta: DataFrame, seq: str = "seq") -> DataFrame:
    """Edges (key, confidence, status, occurrences) with a delta's: occurrences are folded in order, confidence is the last one's, and a
    status that a person gave stays."""
    new = delta.groupBy(*EDGE_KEY).agg(F.max_by("confidence", seq).alias("confidence"), F.max_by("status", seq).alias("status"), F.flatten(in_order(F.col(seq), F.col("occurrences"))).alias("occurrences"))
    both = held.alias("h").join(new.alias("n"), EDGE_KEY, "full_outer")
    empty = F.filter(F.coalesce("h.occurrences", "n.occurrences"), lambda x: F.lit(False))
    return both.select(
        *EDGE_KEY, F.coalesce("n.confidence", "h.confidence").alias("confidence"),
        F.when(F.col("h.status").isin(list(JUDGED)) | F.col("n.status").isNull(), F.col("h.status")).otherwise(F.col("n.status")).alias("status"),
        fold(F.coalesce("h.occurrences", empty), F.coalesce("n.occurrences", empty)).alias("occurrences"),
    )


def set_status(held: DataFrame, judged: DataFrame) -> DataFrame:
    """held with the statuses that a person gave (key, new_status); keys that held lacks change nothing."""
    return held.join(judged, EDGE_KEY, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def orphans(stored: DataFrame, scope: str, scanned: DataFrame, produced: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Stored rows to delete: in a scope that was read, not produced again, and not judged by a person."""
    return stored.join(scanned.select(scope), scope, "left_semi").join(produced.select(key), key, "left_anti").join(judged.select(key), key, "left_anti")


def delete_touching(edges: DataFrame, doomed: DataFrame, extractor: str | None = None) -> DataFrame:
    """Edges without those that touch a doomed node (id), of one extractor or of all."""
    ids = doomed.select("id").distinct()
    mine = F.lit(True) if extractor is None else F.col("extractor") == extractor
    gone = edges.filter(mine)
    kept = gone.join(ids, F.col("src") == F.col("id"), "left_anti").join(ids, F.col("dst") == F.col("id"), "left_anti")
    return kept.unionByName(edges.filter(~mine)) if extractor is not None else kept


def set_human_fields(nodes: DataFrame, said: DataFrame) -> DataFrame:
    """nodes with the human_fields that people gave (id, fields: JSON text) in place of their own; ids that are no node change nothing."""
    return nodes.join(said.select("id", F.col("fields").alias("_fields")), "id", "left").withColumn("human_fields", F.coalesce("_fields", "human_fields")).drop("_fields").select(*nodes.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> DataFrame:
    """nodes without the doomed (id). Raises ValueError if an edge touches one, as its end would be gone."""
    ids = doomed.select("id").distinct()
    touching = edges.join(ids, F.col("src") == F.col("id"), "left_semi").unionByName(edges.join(ids, F.col("dst") == F.col("id"), "left_semi"))
    if not touching.isEmpty():
        raise ValueError("edges touch the nodes to be deleted")
    return nodes.join(ids, "id", "left_anti")


def judged_nodes(edges: DataFrame) -> DataFrame:
    """Ids of the nodes with an edge, of any extractor and in either direction, that a person judged."""
    judged = edges.filter(F.col("status").isin(list(JUDGED)))
    return judged.select(F.col("src").alias("id")).union(judged.select("dst")).distinct()


def remove_missing(nodes: DataFrame, edges: DataFrame, prefix: str, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts) without the nodes whose id begins with prefix and that were not found (id) again, and without all their edges;
    those with a judged edge stay. counts: one row of removed, edges_removed and preserved."""
    gone = nodes.filter(F.col("id").startswith(prefix)).join(found.select("id"), "id", "left_anti").select("id")
    judged = judged_nodes(edges)
    removed, kept = gone.join(judged, "id", "left_anti"), gone.join(judged, "id", "left_semi")
    left = delete_touching(edges, removed)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = one(removed, "removed").crossJoin(one(edges, "_all")).crossJoin(one(left, "_left")).crossJoin(one(kept, "preserved")).select("removed", (F.col("_all") - F.col("_left")).alias("edges_removed"), "preserved")
    return nodes.join(removed, "id", "left_anti"), left, counts
