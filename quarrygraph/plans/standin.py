"""The shared test tables read as provenance data: a graph over the order tables, and script traces over the events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        t("region").select(_id("region", "r_regionkey").alias("id"), F.lit("project").alias("type"), F.col("r_name").alias("title")),
        t("nation").select(_id("nation", "n_nationkey"), F.lit("section"), "n_name"),
        t("customer").select(_id("customer", "c_custkey"), F.lit("experiment"), "c_name"),
        t("supplier").select(_id("supplier", "s_suppkey"), F.lit("commit"), "s_name"),
        t("orders").select(_id("order", "o_orderkey"), F.lit("claim"), F.lit(None).cast("string")),
    ]
    return reduce(DataFrame.union, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)

    def edge(df: DataFrame, src: Column, dst: Column, kind: str, status: Column) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit("tables").alias("extractor"), status.alias("status"))

    auto = F.lit("auto")
    parts = [
        edge(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "includes", auto),
        edge(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "produces", auto),
        edge(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "authored_by", auto),
        edge(t("orders"), _id("order", "o_orderkey"), _id("customer", "o_custkey"), "backed_by", F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "confirmed").otherwise("rejected")),
        edge(t("lineitem").select("l_orderkey", "l_suppkey").distinct(), _id("order", "l_orderkey"), _id("supplier", "l_suppkey"), "uses", auto),
    ]
    return reduce(DataFrame.union, parts)


#: The same in SQL.
NODES = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'project' AS type, r_name AS title FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'section', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'experiment', c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'commit', s_name FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'claim', NULL FROM orders)"""
EDGES = """edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'includes' AS type, 'tables' AS extractor, 'auto' AS status FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'produces', 'tables', 'auto' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'authored_by', 'tables', 'auto' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'backed_by', 'tables', CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'confirmed' ELSE 'rejected' END FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'uses', 'tables', 'auto' FROM lineitem)"""


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as script traces: a user is a script, props.k is the file, purchases write it and views and clicks read it."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "view", "click"))
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.concat(F.lit("script:"), F.col("user_id")).alias("script"), F.concat(F.lit("data/"), k, F.lit(".csv")).alias("target"),
        F.when(F.col("event_type") == "purchase", "writes").otherwise("reads").alias("kind"), (F.coalesce("value", F.lit(0.0)) < 1).alias("missing"), (k % 5 != 0).alias("is_data"),
        F.col("event_id").alias("line"),
    ).filter((F.col("kind") == "reads") | (k % 3 == 0))


USES = """uses AS (
  SELECT * FROM (SELECT 'script:' || user_id AS script, 'data/' || k || '.csv' AS target, CASE event_type WHEN 'purchase' THEN 'writes' ELSE 'reads' END AS kind,
    coalesce(value, 0) < 1 AS missing, k % 5 <> 0 AS is_data, event_id AS line, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type IN ('purchase', 'view', 'click')) WHERE kind = 'reads' OR k % 3 = 0)"""
