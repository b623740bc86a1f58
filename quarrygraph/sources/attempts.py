"""Tables of attempts that people keep in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

# Patterns of headings, delimiter rows, cell markup and step references.
HEADING = r"^#{1,6}\s*(.+?)\s*$"
DELIMITER = r"^\s*(?=.*\|)\|?\s*:?-{1,}:?\s*(\|\s*:?-{1,}:?\s*)*\|?\s*$"
STEPS = r"\((\d{1,3})(?:-(\d{1,3}))?\)"
WIDEST = 50


class TableNotFound(ValueError):
    """No table stands under the heading; not the same as a table without rows."""


def clean_cell(cell: Column) -> Column:
    out = F.regexp_replace(cell, r"(?i)<br\s*/?>", "\n")
    for pattern in (r"\[([^\]]*)\]\([^)]*\)", r"`([^`]*)`", r"\*\*([^*]*)\*\*"):
        out = F.regexp_replace(out, pattern, "$1")
    return strip(out)


def cells(line: Column) -> Column:
    """The cells of a row; an escaped bar belongs to its cell."""
    inner = F.regexp_replace(strip(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|")))


def table(lines: DataFrame, heading: str, columns: dict[str, str]) -> DataFrame:
    """(path, line_no and the keys of columns) of the first table under the first heading that starts with `heading`, in lines of one
    file (path, line_no, line). `columns` maps a result's name to the table's own; `number` is required. Rows with too few or too many
    cells or without a number are left out. Raises TableNotFound if there is no such table, so that no clean-up takes it for an empty one."""
    head = strip(F.regexp_extract("line", HEADING, 1))
    w = Window.partitionBy("path").orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("line").rlike(HEADING)
    rows = lines.withColumn("_start", F.min(F.when(is_head & head.startswith(heading), F.col("line_no"))).over(so_far)).filter("_start is not null")
    rows = rows.withColumn("_heads", F.sum(is_head.cast("int")).over(so_far)).filter("_heads = 1")
    begins = F.contains("line", F.lit("|")) & F.coalesce(F.lead("line").over(w).rlike(DELIMITER), F.lit(False))
    rows = rows.withColumn("_top", F.min(F.when(begins, F.col("line_no"))).over(so_far)).filter("_top is not null")
    rows = rows.withColumn("_gaps", F.sum((~F.contains("line", F.lit("|"))).cast("int")).over(so_far)).filter("_gaps = 0")
    first = rows.filter("line_no = _top").select(cells(F.col("line")).alias("c")).limit(1).collect()
    if not first:
        raise TableNotFound(heading)
    names = [" ".join(c.split()) for c in first[0].c]
    absent = [c for c in columns.values() if c not in names]
    if absent:
        raise TableNotFound(f"{heading}: no column {', '.join(absent)}")
    body = rows.filter("line_no > _top + 1").withColumn("_c", cells(F.col("line"))).filter(F.size("_c") == len(names))
    return body.select("path", "line_no", *(clean_cell(F.get("_c", F.lit(names.index(c)))).alias(k) for k, c in columns.items())).filter("number <> ''")


def first_of_number(rows: DataFrame) -> DataFrame:
    """Of rows with an equal number the first; id is the attempt's."""
    n = F.row_number().over(Window.partitionBy("path", "number").orderBy("line_no"))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n").withColumn("id", F.concat(F.lit("attempt:"), "path", F.lit("#"), "number"))


def steps(text: Column) -> Column:
    """The step numbers that a text refers to, (7) or (7-9): sorted, each once. Ranges that fall or are wider than WIDEST don't count."""
    firsts, lasts = F.regexp_extract_all(text, F.lit(STEPS), F.lit(1)), F.regexp_extract_all(text, F.lit(STEPS), F.lit(2))
    spans = F.transform(F.arrays_zip(firsts.alias("a"), lasts.alias("b")), lambda x: F.struct(x["a"].cast("int").alias("a"), F.when(x["b"] == "", x["a"]).otherwise(x["b"]).cast("int").alias("b")))
    good = F.filter(spans, lambda x: (x["b"] - x["a"]).between(0, WIDEST))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(good, lambda x: F.sequence(x["a"], x["b"])))))


def check_steps(attempts: DataFrame, files: DataFrame) -> DataFrame:
    """(id, step, files, broken): each step of attempts (id, step_refs) with the files (file) whose name starts with its number and a hyphen."""
    known = files.select("file", F.regexp_extract(F.regexp_extract("file", "([^/]*)$", 1), "^(\\d+)-", 1).alias("_s")).filter("_s <> ''")
    known = known.select("file", F.col("_s").try_cast("int").alias("step")).groupBy("step").agg(F.sort_array(F.collect_set("file")).alias("files"))
    return attempts.select("id", F.explode("step_refs").alias("step")).join(known, "step", "left").select("id", "step", "files", F.col("files").isNull().alias("broken"))


def attempt_nodes(rows: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Nodes (id, type, title, attrs, human_fields) of a table's rows (see `table`, with number, date, description, variables, result, verdict): of equal
    numbers the first. With steps (file) also the files of the steps that a description refers to, and the steps without one."""
    first = first_of_number(rows).withColumn("step_refs", steps_of("description"))
    if steps is not None:
        linked = check_steps(first.select("id", "step_refs"), steps)
        linked = linked.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("files", F.array().cast("array<string>")))))).alias("step_files"), F.sort_array(F.collect_set(F.when(F.col("broken"), F.col("step")))).alias("step_files_broken"))
        first = first.join(linked, "id", "left")
        first = first.withColumns({c: F.coalesce(c, F.array().cast(f"array<{k}>")) for c, k in (("step_files", "string"), ("step_files_broken", "int"))})
    kept = ["number", "date", "description", "variables", F.col("path").alias("source_file"), F.col("line_no").alias("source_line"), "step_refs", *(["step_files", "step_files_broken"] if steps is not None else [])]
    return first.select("id", F.lit("attempt").alias("type"), F.col("description").alias("title"), F.to_json(F.struct(*kept)).alias("attrs"), F.to_json(F.struct("verdict", "result")).alias("human_fields"))


def steps_of(column: str) -> Column:
    return steps(F.col(column))


# What an attempt's attrs and human fields hold.
ATTRS = "number string, date string, description string, variables string, source_file string, source_line int, step_refs array<int>, step_files array<string>, step_files_broken array<int>"
HUMAN = "verdict string, result string"


def stored(nodes: DataFrame) -> DataFrame:
    """The attempts of a store's nodes, with their attrs and human fields as columns."""
    held = nodes.filter("type = 'attempt'").select("id", F.from_json("attrs", ATTRS).alias("a"), F.from_json("human_fields", HUMAN).alias("h"))
    return held.select("id", "a.*", "h.*")
