"""Checks of a hand-kept table of attempts against the files and the history of its project.

Attempts have id, number, date, description, variables, verdict, step_files (names below the folder of steps) and step_files_broken (step
numbers without a file). A check that lacks what it needs is skipped, which is neither a pass nor a failure."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import attempt_date, natural_key
from .joins import containing, nearest


class Check(NamedTuple):
    """Findings (None if the check was skipped, and why) and one row of coverage: total and checked attempts."""

    findings: DataFrame | None
    coverage: DataFrame | None = None
    skipped: str | None = None


def of_file(attempts: DataFrame, file: str) -> DataFrame:
    """The attempts that stand in one file's table."""
    return attempts.filter(F.col("id").startswith(f"attempt:{file}#"))


def listing(attempts: DataFrame) -> DataFrame:
    """(number, date, description, verdict, steps) in the natural order of their numbers; steps counts linked files."""
    rows = attempts.select("number", "date", "description", "verdict", F.coalesce(F.size("step_files"), F.lit(0)).alias("steps"))
    return rows.orderBy(*natural_key(F.col("number")))


def _coverage(attempts: DataFrame, checked: Column) -> DataFrame:
    return attempts.agg(F.count("*").alias("total"), F.coalesce(F.sum(checked.cast("long")), F.lit(0)).alias("checked"))


def broken_references(attempts: DataFrame, steps: DataFrame | None) -> Check:
    """(attempt, missing_step, lower, higher): referred steps without a file, and the nearest of steps (step) that there are."""
    if steps is None:
        return Check(None, None, "no folder of steps is configured")
    broken = attempts.select(F.col("id").alias("attempt"), F.explode("step_files_broken").alias("missing_step"))
    # Step numbers have three digits at most, so this window is over a thousand values.
    around = nearest(broken.select("missing_step").distinct(), steps.select("step").distinct(), [], "missing_step", "step")
    return Check(broken.join(F.broadcast(around), "missing_step").select("attempt", "missing_step", "lower", "higher"), _coverage(attempts, F.lit(True)))


def script_dates(attempts: DataFrame, touched: DataFrame, modified: DataFrame, steps_dir: str) -> DataFrame:
    """(attempt, date, script, sha, authored_at, script_date, basis) for every linked script of an attempt: the day of the last commit that touched it, in the author's
    own zone, or, of scripts that no commit has (touched: file, sha, authored_at), the day on which the file was modified (modified: file, at)."""
    rows = attempts.select(F.col("id").alias("attempt"), "date", F.explode("step_files").alias("name")).withColumn("script", F.concat(F.lit(steps_dir.rstrip("/") + "/"), "name"))
    rows = rows.join(touched.select(F.col("file").alias("script"), "sha", "authored_at"), "script", "left").join(modified.select(F.col("file").alias("script"), "at"), "script", "left")
    day = F.when(F.col("sha").isNotNull(), F.try_to_date(F.substring("authored_at", 1, 10), "yyyy-MM-dd")).otherwise(F.to_date("at"))
    basis = F.when(F.col("sha").isNotNull(), "git").when(F.col("at").isNotNull(), "mtime")
    return rows.select("attempt", "date", "script", "sha", "authored_at", day.alias("script_date"), basis.alias("basis")).filter("basis is not null")


def stale_verdicts(attempts: DataFrame, dated: DataFrame | None, year: int | None) -> Check:
    """(attempt, script, attempt_date, script_last_touched, basis) where a script of `script_dates` changed after its attempt's day. Attempts without a plain date aren't checked."""
    if dated is None:
        return Check(None, None, "no folder of steps is configured")
    day = attempt_date(F.col("date"), year)
    late = dated.withColumn("_day", day).filter(F.col("_day") < F.col("script_date"))
    found = late.select("attempt", "script", F.col("date").alias("attempt_date"), F.col("script_date").cast("string").alias("script_last_touched"), "basis")
    return Check(found, _coverage(attempts, day.isNotNull()))


def uses(attempts: DataFrame, dated: DataFrame, year: int | None, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the commits that last touched a checked attempt's scripts, and `uses` edges from attempts to them. commits: sha, message, author_name, author_email, authored_at, files."""
    rows = dated.filter(F.col("sha").isNotNull() & attempt_date(F.col("date"), year).isNotNull())
    attrs = F.to_json(F.struct("message", "authored_at", "author_name", "author_email", "files"))
    nodes = commits.join(rows.select("sha").distinct(), "sha", "left_semi").select(F.concat(F.lit("commit:"), "sha").alias("id"), F.lit("commit").alias("type"), F.split("message", "\n")[0].alias("title"), attrs.alias("attrs"))
    seen = F.transform(F.array_sort(F.collect_set(F.struct("script", F.col("authored_at").alias("commit_time")))), lambda x: F.to_json(x))
    edges = rows.groupBy(F.col("attempt").alias("src"), F.concat(F.lit("commit:"), "sha").alias("dst")).agg(seen.alias("occurrences"))
    return nodes, edges.select("src", "dst", F.lit("uses").alias("type"), F.lit("attempts_consistency").alias("extractor"), F.lit("auto").alias("status"), F.lit(1.0).alias("confidence"), "occurrences")


def alive(verdict: Column, markers: list[str]) -> Column:
    """Whether a verdict has one of the markers, in this spelling."""
    return F.exists(F.array(*(F.lit(m) for m in markers)).cast("array<string>"), lambda m: F.contains(F.coalesce(verdict, F.lit("")), m))


def revived(attempts: DataFrame, dead: list[str] | None, active: list[str] | None) -> Check:
    """(attempt, field, dead_variable, excerpt): living attempts that name a variable given up. An empty list is a statement, None is none."""
    if dead is None or active is None:
        return Check(None, None, f"{'dead variables' if dead is None else 'active verdicts'} are not declared")
    living = attempts.filter(alive(F.col("verdict"), active))
    hits = containing(living, ["description", "variables"], dead, "id") if dead else living.select("id", F.lit("").alias("field"), F.lit("").alias("term")).limit(0)
    text = F.when(F.col("field") == "description", F.col("description")).otherwise(F.col("variables"))
    found = hits.join(living.select("id", "description", "variables"), "id").select(F.col("id").alias("attempt"), "field", F.col("term").alias("dead_variable"), text.alias("excerpt"))
    return Check(found, _coverage(attempts, F.lit(True)))


def run(attempts: DataFrame, steps: DataFrame | None, dated: DataFrame | None, dead: list[str] | None, active: list[str] | None, year: int | None) -> dict[str, Check]:
    """All three checks by name, in their order."""
    return {"broken_references": broken_references(attempts, steps), "stale_verdicts": stale_verdicts(attempts, dated, year), "revived_dead_variables": revived(attempts, dead, active)}
