"""A project's table of attempts: kept in step with the store, and checked against files and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..operators import consistency, snapshots
from ..sources import attempts, config, files, git, history, store

SETTINGS = ".quarrygraph/attempts.toml"


def _steps(spark: SparkSession, root: str, settings: config.Attempts) -> DataFrame | None:
    """(file, at) of the files right below the folder of steps, at being when each was modified."""
    if settings.steps_dir is None:
        return None
    folder = settings.steps_dir.rstrip("/") + "/"
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(files.relative(F.col("path"), root).alias("path"), F.col("modificationTime").alias("at"))
    inside = scan.filter(F.col("path").startswith(folder)).select(F.expr(f"substring(path, {len(folder) + 1})").alias("file"), "at")
    return inside.filter(~F.contains("file", F.lit("/")))


def sync(spark: SparkSession, root: str, target: str) -> dict[str, int]:
    """Bring the store's attempts in step with the table; what was done, counted. Attempts that the table no longer has go with their edges, unless a
    person judged one of those. If the table isn't there nothing is touched: attempts.TableNotFound is raised before."""
    settings = config.read(f"{root}/{SETTINGS}")
    text = files.texts(spark, root, settings.file.rsplit("/", 1)[-1]).filter(F.col("path") == settings.file)
    rows = attempts.table(files.lines(text), settings.heading, settings.columns)
    steps = _steps(spark, root, settings)
    new = cut(attempts.attempt_nodes(rows, steps))
    counts = {"rows": rows.count(), "attempts": new.count()}
    counts["repeated"] = counts.pop("rows") - counts["attempts"]

    def change(nodes: DataFrame | None, edges: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        nodes = spark.createDataFrame([], store.NODES) if nodes is None else nodes
        edges = spark.createDataFrame([], "src string, dst string, type string, extractor string, status string, confidence double, occurrences array<string>") if edges is None else edges
        counts["created"] = new.join(nodes, "id", "left_anti").count()
        nodes, edges, gone = snapshots.remove_missing(nodes, edges, f"attempt:{settings.file}#", new)
        counts.update(gone.first().asDict())
        nodes = snapshots.upsert(nodes, new.withColumn("seq", F.lit(0)), ["id"], "seq", kept=("human_fields",))
        return snapshots.set_human_fields(nodes, new.select("id", F.col("human_fields").alias("fields"))), edges

    store.update(spark, target, change)
    return counts


def checks(spark: SparkSession, root: str, target: str) -> dict[str, consistency.Check]:
    """The three checks of the store's attempts; `uses` edges to the commits that last touched their scripts are stored with them."""
    settings = config.read(f"{root}/{SETTINGS}")
    rows = cut(consistency.of_file(attempts.stored(store.read(spark, target, "nodes")), settings.file))
    steps, dated, numbers = _steps(spark, root, settings), None, None
    if steps is not None:
        try:
            log = git.log(spark, root)
        except git.GitError:  # without history the files' own dates count
            log = history.commits(spark.createDataFrame([], "path string, text string"))
        numbers = steps.select(F.regexp_extract("file", r"^(\d+)-", 1).try_cast("int").alias("step")).filter("step is not null")
        modified = steps.select(F.concat(F.lit(settings.steps_dir.rstrip("/") + "/"), "file").alias("file"), "at")
        dated = cut(consistency.script_dates(rows, history.last_touch(log), modified, settings.steps_dir))
        commits, uses = consistency.uses(rows, dated, settings.date_year, log)
        commits, uses = cut(store.migrated(commits).withColumn("seq", F.lit(0))), cut(uses.withColumn("seq", F.lit(0)))
        store.update(spark, target, lambda nodes, edges: (snapshots.upsert(nodes, commits, ["id"], "seq", kept=("human_fields",)), snapshots.upsert_edges(edges, uses)))
    return consistency.run(rows, numbers, dated, settings.dead_variables, settings.active_verdicts, settings.date_year)
