"""Papers in LaTeX and Markdown: sections, figures, citations, and the numbers that a text claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_id, normal_sentence, strip
from ..operators.sequences import carry_forward, clamped_depth, islands, section_slugs

# Patterns of the two formats.
TEX_COMMENT = r"(?s)(?<!\\)((?:\\\\)*+)%.*$"
TEX_SECTION = r"\\((?:sub)?section)\*?\{((?:[^{}]++|\{[^{}]*+\}){0,1000}+)\}"
TEX_GRAPHICS_PATH = r"\\graphicspath\s*\{\s*\{([^{}]*)\}"
TEX_NAMES = {"labels": r"\\label\{([^{}]*)\}", "refs": r"\\ref\{([^{}]*)\}"}
TEX_SKIPPED = "tabularx|tabular|tabu|longtable|array|equation\\*?|align\\*?|gather\\*?|multline\\*?|eqnarray\\*?|displaymath|verbatim|lstlisting|minted"
TEX_MARK = rf"\\(?:begin|end)\{{(?:{TEX_SKIPPED})\}}|\\\[|\\\]|\$\$"
# Arguments that are no prose, as the first group; the second group is what follows it in the match.
TEX_ARGUMENTS = [
    r"\\[A-Za-z]+\*?((?:\[[^\[\]]*+\]){1,1000}+)()",
    r"\\(?:ref|label|cite(?:p|t|alp)?|Citep|Citet|parencite|textcite|autocite|input|include|vspace|hspace|scalebox|resizebox|setlength|url)(?![A-Za-z])\*?((?:\s*(?:\[[^\[\]]*\]|\{[^{}]*\})){1,1000})()",
    r"\\begin\{[A-Za-z]+\*?\}((?:\s*(?:\[[^\[\]]*\]|\{[^{}]*\})){1,1000})()",
    r"\\href(?![A-Za-z])\*?\{([^{}]*)(\})",
    r"(https?://[^\s{}]++)()",
]
MD_TABLE = r"^\s*(?=.*\|)\|?\s*:?-{1,}:?\s*(\|\s*:?-{1,}:?\s*)*\|?\s*$"
TEX_FIGURE = r"\\includegraphics(?:\[[^\]]*\])?\{([^{}]*)\}"
TEX_CITE = r"\\(?:cite(?:p|t|alp)?|Citep|Citet|parencite|textcite|autocite)\*?(?:\[[^\]]*\])?(?:\[[^\]]*\])?\{([^{}]*)\}"
MD_HEADING = r"^ {0,3}(#{1,3})\s+(.*?)\s*#*\s*$"
MD_IMAGE = r'!\[[^\]]*\]\(\s*([^)\s]+)(?:\s+"[^"]*")?\s*\)'
MD_FENCE = r"^\s{0,3}(`{3,}|~{3,})"
NOT_PAPERS = r"(^|/)(README|CHANGELOG|LICENSE)[^/]*$"
CLAIM = r"(?U)\\SI\{(\d+(?:\.\d+)?)\}\{\\percent\}|(\d+(?:\.\d+)?)\\?%|(?<!\\)\$\s*(\d+\.\d+)\s*\$|(?<![\w.\\])(\d+\.\d+)(?!\.\d)(?!\w)"
COMPOUND = r"^-[A-Za-z]"
SENTENCE_CAP = 240


def without_comment(line: Column) -> Column:
    """line up to its first percent sign that no backslash escapes; a backslash takes the next character with it."""
    return F.regexp_replace(line, TEX_COMMENT, "$1")


def sections(lines: DataFrame, kind: str) -> DataFrame:
    """(path, line_no, title, level, id) of the headings of lines (path, line_no, line); kind is tex or md."""
    if kind == "tex":
        text = without_comment(F.col("line"))
        level, title = F.regexp_extract(text, TEX_SECTION, 1), F.regexp_extract(text, TEX_SECTION, 2)
    else:
        marks = F.regexp_extract("line", MD_HEADING, 1)
        level, title = F.when(marks != "", F.concat(F.lit("h"), F.length(marks).cast("string"))).otherwise(""), F.regexp_extract("line", MD_HEADING, 2)
    found = lines.select("path", "line_no", strip(title).alias("title"), level.alias("level")).filter("level <> ''")
    return section_slugs(found, "path", "title", "line_no").withColumn("id", F.concat(F.lit("section:"), "path", F.lit("#"), "slug")).drop("slug")


def with_section(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """lines with the id of the section that each stands in; null before the first."""
    marked = lines.join(heads.select("path", "line_no", F.col("id").alias("_id")), ["path", "line_no"], "left")
    return carry_forward(marked, ["path"], ["line_no"], F.col("_id"), "section").drop("_id")


def links(lines: DataFrame, kind: str) -> DataFrame:
    """(path, line_no, link, target): figures as `includes`, citation keys as `cites`, in text order, repeats included."""
    text = without_comment(F.col("line")) if kind == "tex" else F.col("line")
    figures = F.transform(F.regexp_extract_all(text, F.lit(TEX_FIGURE if kind == "tex" else MD_IMAGE), F.lit(1)), lambda x: F.struct(F.lit("includes").alias("link"), F.trim(x).alias("target")))
    found = figures
    if kind == "tex":
        keys = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TEX_CITE), F.lit(1)), lambda x: F.split(x, ",")))
        found = F.concat(figures, F.transform(keys, lambda k: F.struct(F.lit("cites").alias("link"), F.lower(F.trim(k)).alias("target"))))
    return lines.select("path", "line_no", F.explode(found).alias("f")).select("path", "line_no", "f.link", "f.target").filter("target <> ''")


def graphics_path(lines: DataFrame) -> DataFrame:
    """lines with `graphics`, the folder that the file's first \\graphicspath names, from its line on."""
    found = F.nullif(F.regexp_extract(without_comment(F.col("line")), TEX_GRAPHICS_PATH, 1), F.lit(""))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("graphics", F.first(found, ignorenulls=True).over(w))


def names(placed: DataFrame) -> DataFrame:
    """(section, labels, refs) of lines in sections: arrays of (name, line) in text order. What stands before the first section belongs to none."""
    text = without_comment(F.col("line"))
    named = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("name")))
    kinds = [named(k, F.regexp_extract_all(text, F.lit(p), F.lit(1))) for k, p in TEX_NAMES.items()]
    rows = placed.filter("section is not null").select("section", "line_no", F.posexplode(F.concat(*kinds)).alias("n", "x")).select("section", "line_no", "n", "x.kind", "x.name")
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("line_no", "n", "name")))), lambda x: F.struct(x["name"].alias("name"), x["line_no"].alias("line"))).alias(kind)
    return rows.groupBy("section").agg(*(of(k) for k in TEX_NAMES))


def _spaces(text: Column) -> Column:
    return F.repeat(F.lit(" "), F.length(text))


def without_skipped(lines: DataFrame) -> DataFrame:
    """LaTeX lines with the bodies of tables, formulas and listings, and display formulas, as spaces; every character keeps its place.

    Marks are read in each file's order: environments and brackets nest, and a close without its open changes nothing; double dollars toggle."""
    marks = F.regexp_extract_all("line", F.lit(TEX_MARK), F.lit(0))
    found = lines.select("path", "line_no", F.posexplode(marks).alias("k", "mark"))
    opens, closes = F.col("mark").startswith("\\begin") | (F.col("mark") == "\\["), F.col("mark").startswith("\\end") | (F.col("mark") == "\\]")
    found = found.withColumn("step", F.when(opens, 1).when(closes, -1).otherwise(0)).withColumn("dollar", (F.col("mark") == "$$").cast("int"))
    w = Window.partitionBy("path").orderBy("line_no", "k").rowsBetween(Window.unboundedPreceding, 0)
    found = clamped_depth(found, ["path"], ["line_no", "k"], "step").withColumn("inside", (F.col("depth") > 0) | (F.sum("dollar").over(w) % 2 == 1))
    after = found.groupBy("path", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "inside"))), lambda x: x["inside"]).alias("_after"))
    rows = lines.join(after, ["path", "line_no"], "left")
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.last(F.element_at("_after", -1), ignorenulls=True).over(before), F.lit(False)))
    parts = F.zip_with(F.split("line", TEX_MARK, -1), F.concat(F.array("_start"), F.coalesce("_after", F.array().cast("array<boolean>"))), lambda part, inside: F.when(inside, _spaces(part)).otherwise(part))
    joined = F.zip_with(parts, marks, lambda part, mark: F.concat(part, F.coalesce(mark, F.lit(""))))
    return rows.withColumn("line", F.array_join(joined, "")).drop("_after", "_start")


def without_arguments(lines: DataFrame) -> DataFrame:
    """lines with optional arguments, arguments that are names, paths or lengths, and web addresses as spaces. A step for each pattern, as a
    nested expression would work out what it repeats again and again."""
    for pattern in TEX_ARGUMENTS:
        lines = lines.withColumns({f"_{k}": F.regexp_extract_all("line", F.lit(pattern), F.lit(k)) for k in range(3)})
        kept = F.transform(F.arrays_zip("_0", "_1", "_2"), lambda x: F.concat(F.left(x["_0"], F.length(x["_0"]) - F.length(x["_1"]) - F.length(x["_2"])), _spaces(x["_1"]), x["_2"]))
        joined = F.array_join(F.zip_with(F.split("line", pattern, -1), kept, lambda part, k: F.concat(part, F.coalesce(k, F.lit("")))), "")
        lines = lines.withColumn("line", F.when(F.size("_0") > 0, joined).otherwise(F.col("line"))).drop("_0", "_1", "_2")
    return lines


def without_tables(lines: DataFrame) -> DataFrame:
    """Markdown lines with tables as empty lines: from a line with a bar before a delimiter row to the last line with a bar."""
    w = Window.partitionBy("path").orderBy("line_no")
    rows = lines.withColumn("_top", F.coalesce(F.lead("line").over(w).rlike(MD_TABLE), F.lit(False)))
    barred = islands(rows, ["path"], ["line_no"], F.contains("line", F.lit("|")))
    tops = barred.withColumn("_first", F.min(F.when(F.col("_top"), F.col("line_no"))).over(Window.partitionBy("path", "island"))).filter("line_no >= _first").select("path", "line_no", F.lit(True).alias("_table"))
    return lines.join(tops, ["path", "line_no"], "left").withColumn("line", F.when(F.col("_table"), "").otherwise(F.col("line"))).drop("_table")


def without_fences(lines: DataFrame) -> DataFrame:
    """Markdown lines with code fences, and what is in them, as empty lines. A fence ends with the next line that begins like one of its own character, so
    each file's fences are read in order, in one fold over its fence lines."""
    fence = F.regexp_extract("line", MD_FENCE, 1)
    marks = lines.withColumn("_m", fence).filter("_m <> ''").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", F.substring("_m", 1, 1).alias("mark")))).alias("m"))
    state = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        closed = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("a"), x["line_no"].alias("b")))).alias("spans"))
        opened = F.struct(x["mark"].alias("open"), x["line_no"].alias("at"), acc["spans"].alias("spans"))
        return F.when(acc["open"] == "", opened).when(x["mark"] == acc["open"], closed).otherwise(acc)

    folded = F.aggregate("m", state, step)
    endless = F.array(F.struct(F.col("s.at").alias("a"), F.lit(2**31 - 1).alias("b")))
    spans = marks.select("path", folded.alias("s")).select("path", F.explode(F.when(F.col("s.open") == "", F.col("s.spans")).otherwise(F.concat("s.spans", endless))).alias("x"))
    starts = spans.select("path", F.col("x.a").alias("line_no"), F.col("x.b").alias("_end"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = lines.join(starts, ["path", "line_no"], "left").withColumn("_until", F.max("_end").over(w))
    return inside.withColumn("line", F.when(F.col("_until").isNull() | (F.col("line_no") > F.col("_until")), F.col("line")).otherwise("")).drop("_end", "_until")


def claims(lines: DataFrame) -> DataFrame:
    """(path, line_no, section, seq, raw, number, unit_form, value decimal, places, sentence, id) of the numbers in lines (path, line_no, line, section).
    A percentage is a hundredth with two more places. A sentence lies within its line; seq counts the claims that have the same bounds. A
    number right behind a full stop begins a sentence of its own."""
    ends = F.split("line", r"(?<=[.!?])(?=\s|$)")
    parts = lines.select("path", "line_no", "section", F.posexplode(ends).alias("part", "s")).filter(F.col("s").rlike(r"\d"))
    pieces = F.split("s", CLAIM, -1)
    hits = F.arrays_zip(
        F.regexp_extract_all("s", F.lit(CLAIM), F.lit(0)).alias("raw"), *(F.regexp_extract_all("s", F.lit(CLAIM), F.lit(k)).alias(n) for k, n in enumerate(("si", "pct", "math", "plain"), 1)),
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("ahead"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("behind"),
    )
    rows = parts.select("path", "line_no", "section", "part", "s", F.posexplode(hits).alias("k", "h"))
    behind = F.sum(F.length("h.ahead") + F.length("h.raw")).over(Window.partitionBy("path", "line_no", "part").orderBy("k")) - F.length("h.raw")
    rows = rows.withColumn("left", F.when(F.col("h.ahead").rlike(r"[.!?]$"), behind).otherwise(0).cast("int"))
    rows = rows.select("path", "line_no", "section", "part", "left", strip(F.expr("substring(s, left + 1)")).alias("s"), "k", "h").filter(~F.col("h.behind").rlike(COMPOUND))
    percent = (F.col("h.si") != "") | (F.col("h.pct") != "")
    number = F.concat("h.si", "h.pct", "h.math", "h.plain")
    printed = F.length(F.regexp_extract(number, r"\.(\d+)$", 1))
    value = number.try_cast("decimal(38,18)")
    value = F.when(percent, F.try_multiply(value, F.lit("0.01").cast("decimal(2,2)")).cast("decimal(38,18)")).otherwise(value)
    seq = F.row_number().over(Window.partitionBy("path", "line_no", "part", "left").orderBy("k"))
    short = F.when(F.length("s") > SENTENCE_CAP, F.concat(F.regexp_replace(F.substring("s", 1, SENTENCE_CAP - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(F.col("s"))
    rows = rows.select("path", "line_no", "section", seq.alias("seq"), F.col("h.raw").alias("raw"), number.alias("number"), percent.alias("percent"), value.alias("value"), (printed + F.when(percent, 2).otherwise(0)).alias("places"), short.alias("sentence"))
    unit = F.when(F.col("percent"), "percent").when(F.col("value").between(0, 1), "fraction").otherwise("plain")
    ident = content_id(F.coalesce("section", F.lit("")), normal_sentence(F.col("sentence")), F.col("raw"), F.col("seq").cast("string"))
    return rows.withColumn("unit_form", unit).withColumn("id", F.concat(F.lit("claim:"), "path", F.lit("#"), ident)).drop("percent")


def prose(lines: DataFrame, kind: str) -> DataFrame:
    """Lines with only what may claim something: for LaTeX lines without comments, for Markdown lines without fences."""
    if kind == "md":
        return without_tables(lines)
    return without_arguments(without_skipped(lines))
