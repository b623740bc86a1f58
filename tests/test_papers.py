"""What papers claim, show and name: regions that are no prose, long lines, folders of figures."""

import random
import re

import pytest

from quarrygraph.sources import dataflow, files, papers


def lines(spark, *texts):
    return files.lines(spark.createDataFrame([(f"p{k}.tex", t) for k, t in enumerate(texts)], "path string, text string"))


def claimed(spark, text, kind="tex"):
    rows = lines(spark, text)
    rows = rows.withColumn("line", papers.without_comment(rows.line)) if kind == "tex" else papers.without_fences(rows)
    placed = papers.with_section(rows, papers.sections(rows, kind)).select("path", "line_no", "line", "section")
    return [(r.raw, r.unit_form, float(r.value), r.places) for r in papers.claims(papers.prose(placed, kind)).orderBy("line_no", "raw").collect()]


def test_numbers_that_are_no_claims(spark):
    tex = r"""\includegraphics[width=0.5\textwidth]{a.png} $$x=0.25$$ see \ref{eq:1.2} and \cite[0.3]{a1.5} \vspace{0.4em}
\begin{tabular}{lc} a & 0.75 \\
b & 0.85 \end{tabular} but 0.95 counts \begin{minipage}[b]{0.45\textwidth} \href{https://x.y/10.21}{gives 0.61} http://a.b/0.33 ok
\[ y = 0.11
+ 0.12 \] then 0.13. \begin{equation}\begin{array}{c}0.14\end{array}0.15\end{equation} and \end{table} 0.16 \textbf{0.17}"""
    assert [x[0] for x in claimed(spark, tex)] == ["0.61", "0.95", "0.13", "0.16", "0.17"]


def test_forms_of_claims(spark):
    tex = "We get 87.3\\% or \\SI{4.2}{\\percent}, $92.1$ and 0.873. A 1.58-bit net, v1.2.3 and 50\\% % 0.999\nSame 0.5 and 0.5 again 0.5."
    got = claimed(spark, tex)
    assert got == [("$92.1$", "plain", 92.1, 1), ("0.873", "fraction", 0.873, 3), ("50\\%", "percent", 0.5, 2), ("87.3\\%", "percent", 0.873, 3), ("\\SI{4.2}{\\percent}", "percent", 0.042, 3), *[("0.5", "fraction", 0.5, 1)] * 3]
    rows = papers.claims(papers.with_section(lines(spark, tex), papers.sections(lines(spark, tex), "tex")).select("path", "line_no", "line", "section")).filter("line_no = 2").collect()
    assert sorted(r.seq for r in rows) == [1, 2, 3] and len({r.id for r in rows}) == 3


def test_markdown_tables_are_no_claims_but_prose_is(spark):
    md = "# T\nWe reach 0.91.\n| a | b |\n|---|---|\n| 0.1 | 0.2 |\n| 0.3 | 0.4 |\n\nNow 0.92 | piped 0.93\n---\n```\n0.5\n~~~\n0.6\n```x\n0.94 out"
    assert [x[0] for x in claimed(spark, md, "md")] == ["0.91", "0.92", "0.93", "0.94"]


@pytest.mark.parametrize("unit", ["x", "word ", "\\% ", "\\", "{a}", "[b]", "0.5 ", "\\cite{a}[b]", "$$", "| ", "\\\\[2pt]"])
def test_a_line_of_a_megabyte(spark, unit):
    size = 1_000_000 if unit in ("x", "word ", "\\% ", "\\", "{a}") else 20_000  # a sentence stands in each of its claims' rows
    tex = "\\section{One} " + unit * (size // len(unit)) + "%" + "no " * 10
    rows = lines(spark, tex)
    heads = papers.sections(rows, "tex").collect()
    assert [h.title for h in heads] == ["One"]
    placed = papers.with_section(rows, papers.sections(rows, "tex")).select("path", "line_no", "line", "section")
    assert papers.claims(papers.prose(placed.withColumn("line", papers.without_comment(placed.line)), "tex")).count() >= 0


def plain_blank(text):
    depth, dollars, out = 0, False, []
    for line in text.split("\n"):
        at, new = 0, ""
        for m in [*re.finditer(papers.TEX_MARK, line), None]:
            piece = line[at : m.start() if m else len(line)]
            new += " " * len(piece) if depth or dollars else piece
            if m:
                new, at = new + m[0], m.end()
                if m[0] == "$$":
                    dollars = not dollars
                else:
                    depth = max(0, depth + (1 if m[0].startswith("\\begin") or m[0] == "\\[" else -1))
        out.append(new)
    return out


def test_skipped_regions_against_a_plain_scan(spark):
    r = random.Random(3)
    parts = ["\\begin{tabular}", "\\end{tabular}", "\\begin{align*}", "\\end{align*}", "\\[", "\\]", "$$", "$", "0.5", " x ", "\n", "\n", "\\begin{figure}", "\\end{figure}"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) + "e" for _ in range(60)]
    got = {}
    for x in papers.without_skipped(lines(spark, *texts)).collect():
        got.setdefault(x.path, {})[x.line_no] = x.line
    for k, t in enumerate(texts):
        assert [got[f"p{k}.tex"][n + 1] for n in range(t.count("\n") + 1)] == plain_blank(t)


def test_arguments_keep_their_places(spark):
    text = r"a \ref{x1.5} b \includegraphics[w=0.5][c]{d.png} \begin{x}[b]{0.4} \href{u}{v} https://q.r/s t"
    got = papers.without_arguments(lines(spark, text)).first().line
    assert len(got) == len(text) and got.split() == ["a", "\\ref", "b", "\\includegraphics", "{d.png}", "\\begin{x}", "\\href{", "}{v}", "t"]


def test_comments(spark):
    cases = {"a % b": "a ", r"a \% b % c": r"a \% b ", r"a \\% b": r"a \\", r"\\\% x % y": r"\\\% x ", "%": "", "none": "none", "\\": "\\"}
    rows = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r.line: r.out for r in rows.select("line", papers.without_comment(rows.line).alias("out")).collect()} == cases


def test_graphics_path_and_names(spark):
    tex = "\\section{A}\n\\includegraphics{one}\n\\graphicspath{{figs/}{alt/}}\n\\includegraphics{one} \\includegraphics{two.svg} \\includegraphics{\\macro}\n\\graphicspath{{late/}}\n\\label{s:a} \\ref{s:b}\\label{t}\n\\section{B}\n\\includegraphics{three}"
    rows = lines(spark, "\\includegraphics{one}\n" + tex)
    placed = papers.graphics_path(papers.with_section(rows, papers.sections(rows, "tex")))
    links = papers.links(rows, "tex").filter("link = 'includes'").join(placed.select("path", "line_no", "section", "graphics"), ["path", "line_no"])
    images = spark.createDataFrame([(p,) for p in ("one.png", "figs/one.gif", "figs/one.eps", "figs/two.svg", "figs/two.svg.png", "figs/three.tif", "figs/three.svg", "late/three.pdf")], "path string")
    got = sorted((r.line_no, r.file) for r in dataflow.figures(links, images).collect())
    assert got == [(3, "one.png"), (5, "figs/one.eps"), (5, "figs/two.svg"), (9, "figs/three.svg")]
    found = papers.names(placed).collect()
    assert len(found) == 1 and [x.name for x in found[0].labels] == ["s:a", "t"] and [(x.name, x.line) for x in found[0].refs] == [("s:b", 7)]


def test_markdown_image_paths(spark):
    links = spark.createDataFrame([("d/p.md", "s", 1, "../a.png"), ("d/p.md", "s", 2, "<b.png>"), ("d/p.md", "s", 3, "https://h/a.png"), ("d/p.md", "s", 4, "//h/a.png"), ("d/p.md", "s", 5, "/a.png"), ("d/p.md", "s", 6, "../../a.png"), ("d/p.md", "s", 7, "c.png")], "path string, section string, line_no int, target string")
    images = spark.createDataFrame([("a.png",), ("d/b.png",), ("d/a.png",)], "path string")
    assert sorted((r.line_no, r.file) for r in dataflow.figures(links, images).collect()) == [(1, "a.png"), (2, "d/b.png")]
