"""Files of a project: the inventory, whole texts, and their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import category, split_lines

# Folders that no scan enters, beside those whose name starts with a dot.
NOISE_DIRS = ["__pycache__", "node_modules", "_cache"]


def relative(path: Column, root: str) -> Column:
    """A scanned file's path below root. The reader names files by URL, with blanks and other characters escaped."""
    plain = F.url_decode(F.replace(F.regexp_replace(path, "^[a-z0-9]+:/+", "/"), F.lit("+"), F.lit("%2B")))
    base = "/" + root.split("://")[-1].strip("/") + "/"
    return F.substring(plain, F.instr(plain, base) + len(base), F.length(plain))


def visible(path: Column) -> Column:
    """Neither a hidden file nor below a hidden folder or one of NOISE_DIRS."""
    return ~F.exists(F.split(path, "/"), lambda part: part.startswith(".") | part.isin(NOISE_DIRS))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, category) of every visible file of a known category. No content is read. Scans leave out empty files, so
    these are taken from the listing that the driver keeps for the scan; when they were modified is not known."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = scan.select(relative(F.col("path"), root).alias("path"), "length", F.col("modificationTime").alias("modified"))
    listed = spark.createDataFrame([(name,) for name in scan.inputFiles()], "name string").select(relative(F.col("name"), root).alias("path"))
    empty = listed.join(found, "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"))
    found = found.unionByName(empty).filter(visible(F.col("path")))
    return found.withColumn("category", category(F.col("path"))).filter("category is not null")


def texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, text) of the visible files whose name fits glob, one row each."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return read.select(relative(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("text")).filter(visible(F.col("path")))


def lines(docs: DataFrame) -> DataFrame:
    """(path, line_no, line) with lines counted from 1. A null text has no lines."""
    return docs.select("path", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
