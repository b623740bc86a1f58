"""One project's folder into the store: every reader's facts become one delta of nodes and one of edges, and one snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..operators import snapshots
from ..operators.graph import EDGE_KEY
from ..operators.joins import rounded_equi_join
from ..sources import bibliography, dataflow, files, history, papers, r_scripts, scripts, store, trackers

# Names of the files of each kind, and the folder of the tracker.
TEX, MARKDOWN, BIB, PYTHON, R, RMD = "*.[tT][eE][xX]", "*.[mM][dD]", "*.[bB][iI][bB]", "*.[pP][yY]", "*.[rR]", "*.[rR][mM][dD]"
TRACKER = "mlruns"
NODES = store.NODES
EDGES = "src string, dst string, type string, extractor string, status string, confidence double, occurrences array<string>"


class Facts:
    """Nodes and edges found so far, each stage's computed once, as later stages look at them. Later stages come later in `seq`, so of equal nodes the last stage's counts."""

    def __init__(self, spark: SparkSession):
        self.nodes, self.edges = [spark.createDataFrame([], NODES + ", seq int")], [spark.createDataFrame([], EDGES + ", seq int")]

    def add(self, nodes: DataFrame, edges: DataFrame | None = None) -> None:
        seq = F.lit(len(self.nodes)).alias("seq")
        self.nodes.append(cut(store.migrated(nodes).select("id", "type", "title", "attrs", "human_fields", seq)))
        if edges is not None:
            self.edges.append(cut(edges.select(*dataflow.EDGE_COLUMNS, seq)))

    def all_nodes(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.nodes)

    def all_edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.edges)


def _papers(spark: SparkSession, root: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headings, lines with their sections, links with their sections) of a project's papers of one format."""
    texts = files.texts(spark, root, TEX if kind == "tex" else MARKDOWN)
    if kind == "md":
        texts = texts.filter(~F.col("path").rlike(papers.NOT_PAPERS))
    lines = cut(files.lines(texts))
    lines = lines.withColumn("line", papers.without_comment(F.col("line"))) if kind == "tex" else papers.without_fences(lines)
    heads = papers.sections(lines, kind)
    placed = papers.with_section(lines, heads)
    where = ["path", "line_no", "section"]
    if kind == "tex":
        placed, where = papers.graphics_path(placed), [*where, "graphics"]
    links = papers.links(lines, kind).join(placed.select(*where), ["path", "line_no"])
    return heads, placed, links


def _claims(found: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of claims and pending edges to every experiment with a metric that agrees at the printed precision."""
    attrs = F.to_json(F.struct("sentence", F.col("value").cast("double").alias("value"), "raw", F.col("number").alias("printed_number"), "unit_form", F.col("places").alias("precision_decimals"), "section", F.col("path").alias("tex_path"), F.col("line_no").alias("line")))
    nodes = found.select("id", F.lit("claim").alias("type"), F.col("sentence").alias("title"), attrs.alias("attrs"))
    matched = rounded_equi_join(found.select(F.col("id").alias("claim_id"), "value", "places", "path", "raw"), metrics)
    where = F.to_json(F.struct(F.col("path").alias("file"), F.col("name").alias("metric"), F.col("metric").alias("metric_value"), F.col("raw").alias("claim_raw"), F.col("value").cast("double").alias("claim_value"), "candidate_count"))
    edges = matched.groupBy(F.col("claim_id").alias("src"), F.col("metric_id").alias("dst")).agg(F.sort_array(F.collect_list(where)).alias("occurrences"))
    return nodes, edges.select("src", "dst", F.lit("backed_by").alias("type"), F.lit("claims").alias("extractor"), F.lit("pending").alias("status"), F.lit(1.0).alias("confidence"), "occurrences")


def _seen(facts: Facts, held: DataFrame | None, kind: str) -> DataFrame:
    """Ids of the nodes of a type found so far or held already."""
    found = facts.all_nodes().filter(F.col("type") == kind).select("id")
    return found if held is None else found.unionByName(held.filter(F.col("type") == kind).select("id"))


def gather(spark: SparkSession, root: str, log: str | None = None, blame: str | None = None, held: DataFrame | None = None) -> Facts:
    """The facts of the folder root: papers, bibliographies, scripts and the tracker's runs; and of an exported history, if log names one
    (see history.LOG_FORMAT), and of the line histories in the folder blame, each named like its script with `.blame` behind. Runs are joined with commits and figures of this call and with those that are held already."""
    facts = Facts(spark)
    known = cut(files.inventory(spark, root))
    if log is not None:
        nodes, edges = history.commit_graph(history.commits(spark.read.text(log, wholetext=True).select(F.lit(log).alias("path"), F.col("value").alias("text"))))
        facts.add(nodes, edges.select("*", F.lit(1.0).alias("confidence"), F.array(F.to_json(F.struct(F.substring("src", 8, 64).alias("commit")))).alias("occurrences")))
    found = []
    entries = bibliography.read(files.texts(spark, root, BIB))
    images = known.filter("category = 'image'")
    for kind, extractor in (("tex", "latex"), ("md", "mdpaper")):
        heads, placed, links = _papers(spark, root, kind)
        cited = links.filter("link = 'cites'")
        refs = bibliography.references(entries, cited) if kind == "tex" else spark.createDataFrame([], "id string, title string")
        facts.add(*dataflow.paper_graph(heads, dataflow.figures(links.filter("link = 'includes'"), images), cited, refs, extractor))
        found.append(papers.claims(papers.prose(placed.select("path", "line_no", "line", "section"), kind)))
    python = scripts.uses(files.texts(spark, root, PYTHON))
    calls = python.union(r_scripts.uses(files.texts(spark, root, R))).union(r_scripts.uses(files.texts(spark, root, RMD)))
    facts.add(*dataflow.script_graph(dataflow.resolve(calls, known, root)))
    if blame is not None:
        blamed = history.blame(files.texts(spark, blame, "*.blame").select(F.regexp_replace("path", "\\.blame$", "").alias("file"), "text"))
        facts.add(*dataflow.figure_graph(python, images, blamed, _seen(facts, held, "commit")))
    metrics = spark.createDataFrame([], "metric_id string, name string, metric double")
    if store.exists(spark, f"{root}/{TRACKER}"):
        runs = cut(trackers.facts(trackers.run_files(files.texts(spark, f"{root}/{TRACKER}"))))
        steps = F.split("path", "/")
        stored = known.filter(F.col("path").startswith(TRACKER + "/") & (F.col("category") == "image") & (F.get(steps, F.lit(3)) == "artifacts"))
        artifacts = stored.select(F.get(steps, F.lit(2)).alias("run_id"), F.array_join(F.slice(steps, 5, 1_000), "/").alias("artifact"))
        artifacts = artifacts.join(runs.select("run_id").distinct(), "run_id", "left_semi")
        facts.add(*trackers.run_graph(runs, artifacts, _seen(facts, held, "figure"), _seen(facts, held, "commit")))
        metrics = runs.filter("kind = 'metrics'").select(F.concat(F.lit("experiment:"), "run_id").alias("metric_id"), "name", F.col("value").try_cast("double").alias("metric"))
    facts.add(*_claims(reduce(DataFrame.unionByName, found), metrics))
    return facts


def ingest(spark: SparkSession, root: str, target: str, log: str | None = None, blame: str | None = None) -> int:
    """Gather the facts of root and commit them to the store at target; the number of its new snapshot. Statuses that a person gave stay.
    Claims that a paper no longer makes go with their edges, unless a person judged one of those. Run again it changes nothing."""
    facts = gather(spark, root, log, blame, store.read(spark, target, "nodes"))
    new_nodes, new_edges = facts.all_nodes(), facts.all_edges()
    scanned = files.inventory(spark, root).filter("category in ('tex', 'md')").select("path")

    def change(nodes: DataFrame | None, edges: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        nodes = spark.createDataFrame([], NODES) if nodes is None else nodes
        edges = spark.createDataFrame([], EDGES) if edges is None else edges
        claims = nodes.filter("type = 'claim'").withColumn("path", F.regexp_extract("id", "^claim:(.*)#[0-9a-f]+$", 1))
        judged = edges.filter((F.col("extractor") == "claims") & F.col("status").isin(list(snapshots.JUDGED))).select(F.col("src").alias("id"))
        gone = cut(snapshots.orphans(claims, "path", scanned, new_nodes, judged, "id").select("id"))
        kept = snapshots.delete_touching(edges, gone, "claims").select(*EDGE_KEY, "confidence", "status", "occurrences")
        return snapshots.upsert(nodes.join(gone, "id", "left_anti"), new_nodes, ["id"], "seq", kept=("human_fields",)), snapshots.upsert_edges(kept, new_edges)

    return store.update(spark, target, change)
