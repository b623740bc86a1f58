"""Runs of experiment trackers: a tracker's folder of small files, and saved pages of a web tracker's answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import basename, split_lines, strip
from ..operators.joins import unique_key_join

# Folders that hold no runs, and the tags that are kept.
RESERVED_TOP, RESERVED_BELOW = ["models", ".trash"], ["tags"]
KEPT_TAGS = [
    "mlflow.runName", "mlflow.user", "mlflow.source.name", "mlflow.source.type", "mlflow.source.git.commit", "mlflow.source.git.branch", "mlflow.source.git.repoURL", "mlflow.parentRunId", "mlflow.note.content",
]
META = ["experiment_id", "status", "start_time", "end_time", "artifact_uri"]
FLOAT = "^[+-]?(\\d+\\.?\\d*([eE][+-]?\\d+)?|\\.\\d+([eE][+-]?\\d+)?|inf|nan)$"


def run_files(texts: DataFrame) -> DataFrame:
    """(run_id, kind, name, text) of a run folder's files (path relative to the tracker's root, text): <experiment>/<run>/<kind>/<name>,
    with the kind `meta` for meta.yaml. Only runs that have a meta.yaml count."""
    p = F.split("path", "/")
    rows = texts.withColumn("p", p).filter((F.size("p") >= 3) & ~F.get("p", F.lit(0)).isin(RESERVED_TOP) & ~F.get("p", F.lit(1)).isin(RESERVED_BELOW))
    kind = F.when((F.size("p") == 3) & (F.get("p", F.lit(2)) == "meta.yaml"), "meta").when((F.size("p") >= 4) & F.get("p", F.lit(2)).isin("params", "tags", "metrics"), F.get("p", F.lit(2)))
    rows = rows.select(F.get("p", F.lit(1)).alias("run_id"), kind.alias("kind"), F.array_join(F.slice("p", 4, 100), "/").alias("name"), "text").filter("kind is not null")
    return rows.join(rows.filter("kind = 'meta'").select("run_id").distinct(), "run_id", "left_semi")


def facts(files: DataFrame) -> DataFrame:
    """(run_id, kind, name, value): one row for each meta field, parameter, kept tag and metric. Of a metric's lines the last that isn't
    blank counts, of a repeated meta field the last one. Values that are no number drop their metric."""
    meta = files.filter("kind = 'meta'").select("run_id", F.posexplode(split_lines(F.col("text"))).alias("n", "line")).filter("line like '%:%' and not ltrim(line) like '#%'")
    pair = F.split("line", ":", 2)
    meta = meta.select("run_id", "n", strip(F.get(pair, F.lit(0))).alias("name"), F.regexp_replace(strip(F.get(pair, F.lit(1))), "^(['\"])(.*)\\1$", "$2").alias("value"))
    meta = meta.groupBy("run_id", "name").agg(F.max_by("value", "n").alias("value")).select("run_id", F.lit("meta").alias("kind"), "name", "value")
    flat = files.filter(F.col("kind").isin("params", "tags")).select("run_id", "kind", "name", strip(F.col("text")).alias("value")).filter((F.col("kind") == "params") | F.col("name").isin(KEPT_TAGS))
    last = F.element_at(F.filter(split_lines(F.col("text")), lambda x: strip(x) != ""), -1)
    value = F.try_element_at(F.split(strip(last), "(?U)\\s+"), F.lit(2))
    metrics = files.filter("kind = 'metrics' and not name like '.%' and trim(text) <> ''").select("run_id", "kind", "name", value.alias("value")).filter(F.lower("value").rlike(FLOAT))
    return meta.unionByName(flat).unionByName(metrics)


def runs(found: DataFrame) -> DataFrame:
    """(run_id, meta, params, tags, metrics): a map each, metrics of doubles."""
    pairs = lambda kind, v: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", v.alias("value"))))))
    text = F.col("value")
    return found.groupBy("run_id").agg(pairs("meta", text).alias("meta"), pairs("params", text).alias("params"), pairs("tags", text).alias("tags"), pairs("metrics", text.try_cast("double")).alias("metrics"))


def run_graph(found: DataFrame, artifacts: DataFrame, figures: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of runs (see `facts`) and their edges. `implements`: the commit that a run's tag names, if commits (id) has it. `produces`: the
    figure that alone among figures (id) has the base name of one of the run's artifacts (run_id, artifact); no or several such give none."""
    one = lambda kind, name: F.max(F.when((F.col("kind") == kind) & (F.col("name") == name), F.nullif("value", F.lit(""))))
    run = F.concat(F.lit("experiment:"), "run_id")
    title = F.coalesce(one("tags", "mlflow.runName"), one("meta", "run_name"), F.col("run_id"))
    per_run = found.groupBy("run_id").agg(title.alias("title"), one("tags", "mlflow.source.git.commit").alias("sha"))
    held = F.to_json(F.struct("run_id", *(F.element_at("meta", F.lit(k)).alias(k) for k in META), "params", "metrics", "tags"))
    nodes = per_run.join(runs(found).select("run_id", held.alias("attrs")), "run_id").select(run.alias("id"), F.lit("experiment").alias("type"), "title", "attrs")
    edge = lambda src, dst, kind, where: [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit("mlflow").alias("extractor"), F.lit("auto").alias("status"), F.lit(1.0).alias("confidence"), where.alias("occurrences")]
    tagged = per_run.withColumn("id", F.concat(F.lit("commit:"), "sha")).join(commits.select("id").distinct(), "id", "left_semi")
    made = tagged.select(*edge(F.col("id"), run, "implements", F.array(F.to_json(F.struct("run_id", "sha")))))
    shown = unique_key_join(artifacts.withColumn("_name", basename(F.col("artifact"))), figures.select("id", basename(F.regexp_replace("id", "^figure:", "")).alias("_name")).distinct(), "_name")
    shown = shown.groupBy("run_id", "id").agg(F.sort_array(F.collect_list(F.to_json(F.struct("run_id", F.col("artifact").alias("artifact_path"))))).alias("o"))
    return nodes, made.unionByName(shown.select(*edge(run, F.col("id"), "produces", F.col("o"))))


# The shape of a saved page, the most characters of a text in a blob and the mark of a cut, and the key of media references.
PAGE = "data struct<project:struct<runs:struct<edges:array<struct<node:struct<name:string,displayName:string,state:string,config:string,summaryMetrics:string,commit:string,tags:array<string>,notes:string,createdAt:string,files:struct<edges:array<struct<node:struct<name:string>>>>>>>,pageInfo:struct<hasNextPage:boolean,endCursor:string>>>>"
TEXT_MOST, TEXT_CUT, MEDIA = 4_000, "...<truncated>", "_type"
#: What a page's files have: names that end like an image.
IMAGE = "(?i)\\.(png|jpe?g|pdf|svg|eps|gif|tiff?)$"


class PageError(ValueError):
    """A saved page has not the shape of an answer."""


def _stripped(x: object) -> object:
    if isinstance(x, dict):
        return {MEDIA: x[MEDIA], "_stripped": True} if MEDIA in x else {k: _stripped(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_stripped(v) for v in x]
    return x[:TEXT_MOST] + TEXT_CUT if isinstance(x, str) and len(x) > TEXT_MOST else x


@F.pandas_udf(T.StringType())
def blob(raw: pd.Series) -> pd.Series:
    """A blob's JSON object without media and with long texts cut; {} for anything that is no object."""

    def one(text: str | None) -> str:
        try:
            found = json.loads(text) if text is not None else {}
        except ValueError:
            found = {}
        return json.dumps(_stripped(found) if isinstance(found, dict) else {}, ensure_ascii=False)

    return raw.map(one, na_action=None)


def numbers(df: DataFrame, keep: list[str], blobs: dict[str, Column]) -> DataFrame:
    """keep, source, name and value (double) of every top-level number in some JSON objects, by their names; texts, booleans and NaN's spellings are no numbers."""
    parts = None
    for source, text in blobs.items():
        found = F.explode(F.try_parse_json(text).cast("map<string,variant>")).alias("name", "_v")
        rows = df.filter(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")).select(*keep, F.lit(source).alias("source"), found)
        rows = rows.filter(F.schema_of_variant("_v").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")).select(*keep, "source", "name", F.expr("try_variant_get(_v, '$', 'double')").alias("value"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """The runs of a web tracker's answers, saved one page a file as JSON: run_id, title, state, config and summary (JSON texts, see `blob`), sha, tags, notes, created_at and files. Runs
    without a name are left out; a page without the shape of an answer raises PageError."""
    read = spark.read.schema(PAGE).option("multiLine", True).json(path)
    if not read.filter("data.project.runs.edges is null").isEmpty():
        raise PageError(path)
    n = read.select(F.explode("data.project.runs.edges.node").alias("n")).select("n.*").filter("coalesce(name, '') <> ''")
    files = F.filter(F.transform("files.edges", lambda e: e["node"]["name"]), lambda f: f.isNotNull() & (f != ""))
    return n.select(F.col("name").alias("run_id"), F.coalesce(F.nullif("displayName", F.lit("")), "name").alias("title"), "state", blob("config").alias("config"), blob("summaryMetrics").alias("summary"), F.nullif(strip(F.col("commit")), F.lit("")).alias("sha"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "notes", F.col("createdAt").alias("created_at"), F.coalesce(files, F.array().cast("array<string>")).alias("files"))


def page_graph(runs: DataFrame, figures: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (with attrs) and edges of `saved_pages`, and what was skipped (reason, n): `implements` from the commit that a run names, if commits (id) has it, and `produces` to the figure that alone among
    figures (id) has the base name of an image of the run."""
    run = F.concat(F.lit("experiment:"), "run_id")
    attrs = F.to_json(F.struct("run_id", "state", "tags", "notes", "created_at", F.from_json("config", "map<string,string>").alias("config"), F.from_json("summary", "map<string,string>").alias("summary_metrics")))
    nodes = runs.select(run.alias("id"), F.lit("experiment").alias("type"), "title", attrs.alias("attrs"))
    edge = lambda src, dst, kind, where: [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit("wandb").alias("extractor"), F.lit("auto").alias("status"), F.lit(1.0).alias("confidence"), where.alias("occurrences")]
    named = runs.filter("sha is not null").withColumn("id", F.concat(F.lit("commit:"), "sha")).join(commits.select("id", F.lit(True).alias("_known")).distinct(), "id", "left")
    made = named.filter("_known").select(*edge(F.col("id"), run, "implements", F.array(F.to_json(F.struct("run_id", "sha")))))
    images = runs.select("run_id", F.explode("files").alias("file_name")).filter(F.col("file_name").rlike(IMAGE)).withColumn("_name", basename(F.col("file_name")))
    known = figures.select("id", basename(F.regexp_replace("id", "^figure:", "")).alias("_name")).distinct()
    shown = unique_key_join(images, known, "_name").groupBy("run_id", "id").agg(F.sort_array(F.collect_list(F.to_json(F.struct("run_id", "file_name")))).alias("o"))
    n = lambda df, why: df.agg(F.lit(why).alias("reason"), F.count("*").alias("n"))
    single = known.groupBy("_name").agg(F.count("*").alias("_n")).filter("_n = 1")
    skipped = n(named.filter("_known is null"), "unknown commit").unionByName(n(images.join(single, "_name", "left_anti"), "no single figure")).unionByName(n(runs.filter("sha is null"), "no commit"))
    return nodes, made.unionByName(shown.select(*edge(run, F.col("id"), "produces", F.col("o")))), skipped
