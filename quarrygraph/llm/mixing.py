"""Mixing sources to target weights: word counts by source, repetition rates, whole copies and one hash-seeded extra copy.

A source's taken words differ from its target by chance: each document's extra copy is drawn alone, with the fraction f of the
rate as its probability, so the standard deviation is sqrt(f (1 - f) * sum of squared sizes), at most half the root of (largest
document * source size). A source of few documents, or with one very large one, may so miss its target by much of that document's size;
over many documents it comes near.

Defined cases: a null or empty text has no words; its row stays with size 0. The null source is a
source of its own, after all others. A source without words has target 0 and takes nothing. Repeated rows
are drawn alike, as the draw depends on doc_id only; a null doc_id is drawn as an empty one. A text of any length is counted whole.
Other columns are carried by `mix` under whatever names; its number of the copy is called `copy`, or `copy_1`, `copy_2` and so on if
that name is taken. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, columns, materialize, read_table

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated this often at most.
MOST = 3
SEED = "mix-1"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.expr(rf"regexp_count({text}, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")


def targets(spark: SparkSession, sizes: DataFrame) -> tuple[DataFrame, int]:
    """(source, source_size, target) of a table with source and size, and the number of sources.

    Sources may be as many as hosts: they are sorted in parts, and a part's place in the order comes from the parts' counts. A level
    is the words that a source gets for each unit of weight. Each round is one aggregation over the sources: those that
    the level would lift over their cap get their cap, and the others share what is left, until no more are capped.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    s = materialize(spark, s.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")), "sources")
    # One row for each part of the sort, so this window is over as many rows as there are tasks.
    parts = s.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), ((F.col("nth") + F.col("before")) % len(WEIGHTS) + 1).cast("int"))
    s = s.join(F.broadcast(parts.select("part", before.alias("before"))), "part").select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(MOST)).alias("cap"))
    s = materialize(spark, s, "weights")
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") < F.lit(level) * F.col("w") if capped >= 0 else F.lit(False)
        sums = s.agg(F.count("*").alias("all"), F.sum(full.cast("long")).alias("capped"), F.sum("source_size").alias("size"), F.sum(F.when(full, F.col("cap"))).alias("given"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if not sums["all"] or sums["capped"] == capped or not sums["w"]:
            break
        capped, level = sums["capped"], (sums["size"] - (sums["given"] or 0.0)) / sums["w"]
    return s.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target")), sums["all"]


def draw(doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) that depends on the document and the seed only."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _copies(rows: DataFrame, spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """rows (source, doc_id and others) with source_size, target, rate and `copies`: floor(rate), and one more with the fraction as its
    probability. The sources' table is broadcast after its rows are counted, if it is small."""
    found, n = targets(spark, sizes)
    t = broadcast_if_small(found.withColumnRenamed("source", "_source"), n)
    out = rows.join(t, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    out = out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    return out.withColumn("copies", (F.floor("rate") + (draw() < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def plan(spark: SparkSession, df: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies of every row of df. The texts are counted once."""
    sized = materialize(spark, df.select("doc_id", "source", n_words().alias("size")), "sizes")
    return _copies(sized, spark, sized)


def mix(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The mixed documents: every row of df as often as its copies, with the copy's number from 1. Texts stay where they are: only
    word counts by source are shuffled, unless the sources are too many for a broadcast."""
    packed = df.select(F.struct(*columns(df)).alias("_row"), "doc_id", "source")
    out = _copies(packed, spark, df.select("source", n_words().alias("size"))).filter(F.col("copies") > 0)
    name = next(x for x in ("copy", *(f"copy_{k}" for k in range(1, len(df.columns) + 2))) if x not in df.columns)
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_nth")).select("_row.*", F.col("_nth").alias(name))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(spark, read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


#: The same in DuckDB; {docs} is the table.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s
), l AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS level FROM w
), h AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM l
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(here) FROM h), 0) * w) AS target FROM h
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(floor(rate) + CASE WHEN CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM r
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM c
"""
