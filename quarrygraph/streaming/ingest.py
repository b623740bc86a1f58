"""Streaming ingest: files of facts that arrive in a folder are upserted into the store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.snapshots import upsert
from ..sources import store

FACTS = "seq long, id string, type string, title string"


def follow_nodes(spark: SparkSession, landing: str, root: str, checkpoint: str) -> StreamingQuery:
    """Node facts (seq, id, type, title) as JSON files in `landing`; of equal ids the highest seq of a batch counts, and later batches
    replace earlier ones. A batch that is run again after a failure changes nothing, as it leads to the same rows. Reads what is there, then ends."""

    def apply(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        facts = batch.filter("id is not null")

        def change(nodes: DataFrame | None, edges: DataFrame | None) -> tuple[DataFrame, DataFrame]:
            nodes = session.createDataFrame([], store.NODES) if nodes is None else nodes
            edges = session.createDataFrame([], "src string, dst string, type string, extractor string, status string") if edges is None else edges
            return upsert(nodes, store.migrated(facts), ["id"], "seq", kept=("human_fields",)), edges

        store.update(session, root, change)

    stream = spark.readStream.schema(FACTS).json(landing).select("seq", "id", "type", F.col("title"))
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
