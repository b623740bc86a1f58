"""Version-control history, from the text that a log command exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# The separators and fields of the export, which `git log --reverse -z --name-only --format=...` writes.
RECORD, FIELD = "\x1e", "\x1f"
BLAME = r"^([0-9a-f]{40}) \d+ (\d+)(?: \d+)?$"
LOG_FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%B%x1f"


def commits(logs: DataFrame) -> DataFrame:
    """(path, ordinal, sha, author_name, author_email, authored_at, message, files) of exported logs (path, text), oldest first.
    Records without all fields or without a sha are left out. The author's own time zone stays in authored_at."""
    records = logs.select("path", F.posexplode(F.split("text", RECORD)).alias("ordinal", "record"))
    f = F.split("record", FIELD, -1)
    rows = records.filter((F.size(f) >= 6) & (F.get(f, F.lit(0)) != "")).withColumn("f", f)
    names = F.filter(F.transform(F.split(F.get("f", F.lit(5)), "\x00"), lambda x: F.regexp_replace(x, "^\\n+", "")), lambda x: x != "")
    return rows.select("path", "ordinal", *(F.get("f", F.lit(k)).alias(n) for k, n in enumerate(("sha", "author_name", "author_email", "authored_at"))), strip(F.get("f", F.lit(4))).alias("message"), names.alias("files"))


def last_touch(log: DataFrame) -> DataFrame:
    """(file, sha, authored_at) of the latest commit that touched each file."""
    touched = log.select(F.explode("files").alias("file"), "ordinal", "sha", "authored_at")
    return touched.groupBy("file").agg(F.max_by("sha", "ordinal").alias("sha"), F.max_by("authored_at", "ordinal").alias("authored_at"))


def blame(texts: DataFrame) -> DataFrame:
    """(file, line_no, sha) of exported line histories (file, text), which `git blame --porcelain` writes: each line's commit. Lines that no
    commit has yet are left out. Joined by file and line it serves all lines that are asked for at once."""
    head = F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(BLAME))).alias("h")
    rows = texts.select("file", head).select("file", F.regexp_extract("h", BLAME, 2).cast("int").alias("line_no"), F.regexp_extract("h", BLAME, 1).alias("sha"))
    return rows.filter(~F.col("sha").rlike("^0+$"))


def commit_graph(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, title) and edges (src, dst, type, extractor, status): commits, their authors by lower-case address, and who
    wrote what. A commit without an address has no author."""
    email = F.lower(strip(F.col("author_email")))
    who = F.concat(F.lit("contributor:"), email)
    sha = F.concat(F.lit("commit:"), F.col("sha"))
    named = log.filter(email != "")
    people = named.groupBy(who.alias("id")).agg(F.max_by(F.when(F.col("author_name") != "", F.col("author_name")).otherwise(email), "ordinal").alias("title"))
    attrs = F.to_json(F.struct("message", "authored_at", "author_name", "author_email", "files"))
    nodes = log.select(sha.alias("id"), F.lit("commit").alias("type"), F.split("message", "\n")[0].alias("title"), attrs.alias("attrs"))
    nodes = nodes.unionByName(people.select("id", F.lit("contributor").alias("type"), "title", F.to_json(F.struct(F.col("title").alias("name"), F.expr("substring(id, 13)").alias("email"))).alias("attrs")))
    edges = named.select(sha.alias("src"), who.alias("dst"), F.lit("authored_by").alias("type"), F.lit("git").alias("extractor"), F.lit("auto").alias("status"))
    return nodes, edges
