"""Operators that read lines or events in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import slugify


def carry_forward(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to and including each row."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def section_slugs(df: DataFrame, file: str, title: str, order: str) -> DataFrame:
    """A slug for each section, whatever the order in which others come: titles that differ but share a slug all
    get a part of their hash; equal titles are numbered in document order."""
    by_base = Window.partitionBy(file, "_base")
    df = df.withColumn("_base", slugify(F.col(title)))
    df = df.withColumn("_titles", F.size(F.collect_set(title).over(by_base)))
    df = df.withColumn("_slug", F.when(F.col("_titles") > 1, F.concat("_base", F.lit("-"), F.substring(F.sha2(F.col(title), 256), 1, 8))).otherwise(F.col("_base")))
    n = F.row_number().over(Window.partitionBy(file, "_slug").orderBy(order))
    return df.withColumn("slug", F.when(n > 1, F.concat("_slug", F.lit("-"), n.cast("string"))).otherwise(F.col("_slug"))).drop("_base", "_titles", "_slug")


def clamped_depth(df: DataFrame, group: list[str], order: list[str], step: str) -> DataFrame:
    """Depth of nesting after each step of +1 or -1, which never falls below 0: the running sum less its lowest point under 0."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_sum", F.sum(step).over(w))
    return df.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_sum")


def islands(df: DataFrame, group: list[str], order: list[str], inside: Column) -> DataFrame:
    """The runs of rows for which inside holds, numbered in order as `island`; other rows are left out."""
    w = Window.partitionBy(*group).orderBy(*order)
    df = df.withColumn("_in", F.coalesce(inside, F.lit(False)))
    starts = F.col("_in") & ~F.lag("_in", 1, False).over(w)
    df = df.withColumn("island", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.filter("_in").drop("_in")
