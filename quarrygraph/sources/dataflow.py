"""What scripts read and write, and what papers show and cite, as nodes and edges of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import category, content_id, normal_path, suffix
from ..operators.joins import ranked_candidate_join

# The order in which a figure's file is looked for when its name has no extension.
FIGURE_ORDER = ["pdf", "png", "jpg", "jpeg", "eps", "gif", "svg", "tif", "tiff"]
NODE_COLUMNS = ["id", "type", "title"]
EDGE_COLUMNS = ["src", "dst", "type", "extractor", "status", "confidence", "occurrences"]


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def beside(path: Column, target: Column) -> Column:
    """target as seen from the folder of path, in normal form."""
    return F.when(~target.startswith("/"), normal_path(F.concat_ws("/", F.nullif(folder(path), F.lit("")), target)))


def resolve(calls: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """calls (path, target, ...) with file, missing and remapped. A target is looked for from the root, then from the script's folder,
    among files (path); one that is at neither place is missing and gets the name it would have at the first that lies in the project.
    Absolute targets count if they lie below root, as text; targets that leave the project are dropped, those in no known
    category of data or images too."""
    base = None if root is None else root.rstrip("/") + "/"
    inside = F.lit(False) if base is None else F.col("target").startswith(base)
    local = F.col("target") if base is None else F.when(inside, F.substring("target", len(base) + 1, 1 << 30)).otherwise(F.col("target"))
    asked = calls.withColumn("remapped", inside).withColumn("_row", content_id("path", "target"))
    places = asked.select("_row", "path", local.alias("t")).dropDuplicates(["_row"])
    places = places.select("_row", normal_path(F.col("t")).alias("_top"), beside(F.col("path"), F.col("t")).alias("_near"))
    found = ranked_candidate_join(places, [F.col("_top"), F.col("_near")], files.select(F.col("path").alias("_file")), "_file", "_row")
    named = found.select("_row", F.coalesce("target", "_top", "_near").alias("file"), F.col("target").isNull().alias("missing")).filter("file is not null")
    return asked.join(named, "_row").drop("_row").filter(category(F.col("file")).isin("data", "image"))


def _edges(rows: DataFrame, src: Column, dst: Column, kind: Column, extractor: str, order: list[str], occurrence: Column) -> DataFrame:
    """One edge for each end and kind, with what tells where it was seen, as JSON texts in order."""
    seen = F.array_sort(F.collect_list(F.struct(*order, occurrence.alias("o"))))
    grouped = rows.groupBy(src.alias("src"), dst.alias("dst"), kind.alias("type")).agg(F.transform(seen, lambda x: x["o"]).alias("occurrences"))
    return grouped.select("src", "dst", "type", F.lit(extractor).alias("extractor"), F.lit("auto").alias("status"), F.lit(1.0).alias("confidence"), "occurrences")


def script_graph(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of scripts, data sets and figures, and the `reads` and `writes` between them, missing files included, from `resolve`d calls."""
    kind = F.when(category(F.col("file")) == "data", "dataset").otherwise("figure")
    src, dst = F.concat(F.lit("script:"), "path"), F.concat(kind, F.lit(":"), "file")
    scripts = resolved.select(src.alias("id"), F.lit("script").alias("type"), F.col("path").alias("title"))
    nodes = scripts.union(resolved.select(dst.alias("id"), kind.alias("type"), F.col("file").alias("title"))).distinct()
    flag = lambda c: F.when(F.col(c), True).alias(c)
    where = F.to_json(F.struct(F.col("path").alias("file"), F.col("line_no").alias("line"), "callee", "folded_from", flag("missing"), F.when(F.col("remapped"), True).alias("remapped_from_absolute")))
    return nodes, _edges(resolved, src, dst, F.col("kind"), "dataflow", ["path", "line_no", "callee"], where)


def figure_graph(calls: DataFrame, images: DataFrame, blamed: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Figures that Python scripts save, and `generates` from the commit that each call's line is from: calls as `scripts.uses` gives them,
    lines as `history.blame` does. Calls whose figure isn't among images (path), whose line has no commit or whose commit is not among
    commits (id) make no edge."""
    saved = resolve(calls.filter("callee = 'savefig'"), images).filter("not missing and not remapped")
    lines = blamed.select(F.col("file").alias("path"), "line_no", F.concat(F.lit("commit:"), "sha").alias("id"))
    rows = saved.join(lines, ["path", "line_no"]).join(commits.select("id").distinct(), "id", "left_semi")
    nodes = rows.select(F.concat(F.lit("figure:"), "file").alias("id"), F.lit("figure").alias("type"), F.col("file").alias("title")).distinct()
    where = F.to_json(F.struct(F.col("path").alias("file"), F.col("line_no").alias("line"), "callee", "folded_from"))
    return nodes, _edges(rows, F.col("id"), F.concat(F.lit("figure:"), "file"), F.lit("generates"), "pyfig", ["path", "line_no"], where)


def figures(links: DataFrame, images: DataFrame) -> DataFrame:
    """`includes` links (path, section, line_no, target, and `graphics`, a folder below the paper's, if the format has that) with the image (path) that each shows, from
    the paper's folder; a name with an image's extension must be there as it is, another takes the first of FIGURE_ORDER that is. Links to no
    known image, outside any section, with a macro in their name, or to other hosts are dropped, as no figure stands behind them."""
    if "graphics" not in links.columns:
        links = links.withColumn("graphics", F.lit(None).cast("string"))
    bare = F.trim(F.regexp_replace("target", r"^<(.*)>$", "$1"))
    links = links.withColumn("target", bare).filter(F.col("section").isNotNull() & ~F.contains("target", F.lit("\\")) & ~F.col("target").rlike("^(https?:)?//"))
    asked = links.withColumn("_row", content_id("path", F.coalesce("graphics", F.lit("")), "target"))
    below = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat_ws("/", F.nullif(F.regexp_replace("graphics", "^/+|/+$", ""), F.lit("")), "target"))
    rows = asked.select("_row", "path", below.alias("target")).dropDuplicates(["_row"])
    name = beside(F.col("path"), F.col("target"))
    known = suffix(name).isin(FIGURE_ORDER)
    tried = [F.when(known, name), *(F.when(~known, F.concat(name, F.lit(f".{x}"))) for x in FIGURE_ORDER)]
    places = rows.select("_row", F.array(*tried).alias("_c"))
    found = ranked_candidate_join(places, [F.get("_c", F.lit(k)) for k in range(len(tried))], images.select(F.col("path").alias("_file")), "_file", "_row")
    return asked.join(found.select("_row", F.col("target").alias("file")).filter("file is not null"), "_row").drop("_row")


def paper_graph(heads: DataFrame, shown: DataFrame, cited: DataFrame, references: DataFrame, extractor: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of sections, figures and references, and `includes` and `cites` out of sections. Links before the first heading belong to
    the paper's preamble, a section of its own."""
    section = F.coalesce("section", F.concat(F.lit("section:"), "path", F.lit("#preamble")))
    links = shown.select("path", "line_no", section.alias("src"), F.concat(F.lit("figure:"), "file").alias("dst"), F.lit("includes").alias("type"))
    links = links.unionByName(cited.select("path", "line_no", section.alias("src"), F.concat(F.lit("ref:"), F.lower(F.trim("target"))).alias("dst"), F.lit("cites").alias("type")))
    preambles = links.filter(F.col("src").endswith("#preamble")).select(F.col("src").alias("id"), F.lit("section").alias("type"), F.lit("Preamble/Abstract").alias("title"))
    nodes = heads.select("id", F.lit("section").alias("type"), "title").union(preambles.join(heads.select("id"), "id", "left_anti"))
    nodes = nodes.union(shown.select(F.concat(F.lit("figure:"), "file"), F.lit("figure"), "file")).union(references.select("id", F.lit("reference"), "title"))
    where = F.to_json(F.struct(F.col("path").alias("file"), F.col("line_no").alias("line")))
    return nodes.dropDuplicates(["id"]), _edges(links, F.col("src"), F.col("dst"), F.col("type"), extractor, ["path", "line_no"], where)
