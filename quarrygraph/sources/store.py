"""Snapshots of nodes and edges in a shared folder. A writer puts its tables beside the others and then claims the next number by
creating a small file that must not exist yet; whoever comes second fails and starts again from the newer snapshot."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import EDGE_TYPES, NODE_TYPES, STATUSES, dangling

ATTEMPTS = 5
#: The nodes' columns; attrs are a reader's, human_fields a person's, both JSON texts.
NODES = "id string, type string, title string, attrs string, human_fields string"


class Conflict(RuntimeError):
    """Another writer took the number first."""


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jvm, fs = _fs(spark, path)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path))


def version(spark: SparkSession, root: str) -> int:
    """The number of the newest snapshot; 0 if there is none."""
    jvm, fs = _fs(spark, root)
    log = jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    return max((int(f.getPath().getName()) for f in fs.listStatus(log) if f.getPath().getName().isdigit()), default=0) if fs.exists(log) else 0


def read(spark: SparkSession, root: str, name: str, at: int | None = None) -> DataFrame | None:
    """A table of a snapshot, the newest if no number is given; None in an empty store."""
    at = version(spark, root) if at is None else at
    if not at:
        return None
    folder = spark.read.text(f"{root}/log/{at}").first().value
    found = spark.read.parquet(f"{root}/data/{folder}/{name}")
    return migrated(found) if name == "nodes" else found


def migrated(nodes: DataFrame) -> DataFrame:
    """Nodes with the columns that an earlier version lacked; a snapshot is brought up to date when it is read, and so in the next one that is written."""
    for column in ("attrs", "human_fields"):
        if column not in nodes.columns:
            nodes = nodes.withColumn(column, F.lit("{}"))
    return nodes


def problems(nodes: DataFrame, edges: DataFrame) -> list[str]:
    """What forbids a commit: unknown types or statuses, confidences outside 0 to 1, ends that are no node, repeated ids."""
    found = {
        "node type": nodes.filter(~nodes.type.isin(list(NODE_TYPES)) | nodes.type.isNull()),
        "edge type": edges.filter(~edges.type.isin(list(EDGE_TYPES)) | edges.type.isNull()),
        "status": edges.filter(~edges.status.isin(list(STATUSES)) | edges.status.isNull()),
        "end of an edge": dangling(nodes, edges),
        "repeated node": nodes.groupBy("id").count().filter("count > 1"),
    }
    if "confidence" in edges.columns:
        found["confidence"] = edges.filter("confidence is null or isnan(confidence) or not confidence between 0 and 1")
    return [k for k, bad in found.items() if not bad.isEmpty()]


def commit(spark: SparkSession, root: str, nodes: DataFrame, edges: DataFrame, base: int) -> int:
    """Write both tables as snapshot base + 1, which must still be free, once they are valid. Tables of a writer that fails or comes
    second stay unread."""
    jvm, fs = _fs(spark, root)
    folder = uuid.uuid4().hex
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.parquet(f"{root}/data/{folder}/{name}")
    bad = problems(spark.read.parquet(f"{root}/data/{folder}/nodes"), spark.read.parquet(f"{root}/data/{folder}/edges"))
    if bad:
        raise ValueError("not committed: " + ", ".join(bad))
    try:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/log/{base + 1}"), False)
    except Exception as e:
        if "exist" in str(e).lower():
            raise Conflict(base + 1) from e
        raise
    out.write(bytearray(folder.encode()))
    out.close()
    return base + 1


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None, DataFrame | None], tuple[DataFrame, DataFrame]]) -> int:
    """Apply change(nodes, edges) to the newest snapshot and commit what it returns; again from the then newest if another came first."""
    for _ in range(ATTEMPTS):
        base = version(spark, root)
        try:
            return commit(spark, root, *change(read(spark, root, "nodes", base), read(spark, root, "edges", base)), base)
        except Conflict:
            continue
    raise Conflict(f"{ATTEMPTS} attempts")
