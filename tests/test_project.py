"""Bibliographies, R scripts, resolved targets, line histories and the graphs they make, on small fixtures."""

import json

from pyspark.sql import functions as F

from quarrygraph.__main__ import main
from quarrygraph.functions.text import norm_path, normal_path
from quarrygraph.sources import bibliography, dataflow, files, history, papers, r_scripts, store, trackers


def test_bibliography(spark):
    text = '@String{a = "b"}\n@Article{Key1, title = {A {B} 50% c}, note = {see author = X}, author="S, T", year = 2020}\n@misc{k2,title="x'
    rows = spark.createDataFrame([("a.bib", text), ("b.bib", "@book{KEY1, year={1999}, year={2000}}"), ("c.bib", None)], "path string, text string")
    found = bibliography.read(rows)
    assert {(r.key, r.entry_type, r.title, r.author, r.year) for r in found.collect()} == {("Key1", "article", "A {B} 50% c", "S, T", "2020"), ("k2", "misc", None, None, None), ("KEY1", "book", None, None, "1999")}
    refs = bibliography.references(found, spark.createDataFrame([("key1 ",), ("gone",), ("gone",), (None,)], "target string")).collect()
    assert {(r.id, r.key, r.unresolved, r.spellings) for r in refs} == {("ref:key1", "KEY1", False, 2), ("ref:k2", "k2", False, 1), ("ref:gone", "gone", True, 0)}


R = """d <- "data"  # dir
out = 'o.csv'
x <- read.csv(file.path(d, "a.csv"), header = TRUE)
readr::write_csv(x, out)
# read.csv("no.csv")
y <- "p"; z <- 1
fread(y)
w <- "w"
5 -> w
fread(w)
f(x = "q"); readRDS(paste("a", "b"))
v <- "v.csv"
assign("v", 2)
fread(v)
saveRDS(x, file = unknown)
png(
  filename = "g\\\\1.png")
"""


def test_r_scripts(spark):
    rmd = 'read.csv("n")\n```{r a}\nread.csv("y")\n```\nfread("z")'
    rows = spark.createDataFrame([("s.R", R), ("d.Rmd", rmd), ("n.R", None), ("bad.R", 'pdf("x'), (None, 'pdf("p")')], "path string, text string")
    got = {(r.path, r.line_no, r.callee, r.kind, r.target, r.folded_from) for r in r_scripts.uses(rows).collect()}
    assert got == {("s.R", 3, "read.csv", "reads", "data/a.csv", 'file.path(d, "a.csv")'), ("s.R", 4, "readr::write_csv", "writes", "o.csv", "out"), ("s.R", 16, "png", "writes", "g\\1.png", None), ("d.Rmd", 3, "read.csv", "reads", "y", None), (None, 1, "pdf", "writes", "p", None)}


def test_normal_path(spark):
    given = ["a/../b", "../x", "/abs", "", "a/./b//c", None, ".", "a/../../a/b", "a/b/..", "..", "a/.."]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(given)], "i int, p string").select("i", normal_path(F.col("p")).alias("n"))
    assert [r.n for r in rows.orderBy("i").collect()] == [norm_path(p) for p in given]


def test_targets_and_script_graph(spark):
    calls = [("s/a.R", 1, "f", "reads", "d.csv", None), ("s/a.R", 1, "f", "reads", "d.csv", None), ("s/a.R", 3, "f", "writes", "../top.png", "x"), ("s/a.R", 4, "f", "reads", "lost.csv", None), ("s/a.R", 5, "f", "reads", "/r/top.csv", None), ("s/a.R", 6, "f", "reads", "/etc/x.csv", None), ("s/a.R", 7, "f", "reads", "../../x.csv", None), ("s/a.R", 8, "f", "reads", "n.txt", None)]
    calls = spark.createDataFrame(calls, "path string, line_no int, callee string, kind string, target string, folded_from string")
    known = spark.createDataFrame([("s/d.csv",), ("top.png",), ("top.csv",)], "path string")
    got = dataflow.resolve(calls, known, "/r/")
    assert sorted((r.line_no, r.file, r.missing, r.remapped) for r in got.collect()) == [(1, "s/d.csv", False, False), (1, "s/d.csv", False, False), (3, "top.png", False, False), (4, "lost.csv", True, False), (5, "top.csv", False, True)]
    nodes, edges = dataflow.script_graph(got)
    assert {(r.id, r.type) for r in nodes.collect()} == {("script:s/a.R", "script"), ("dataset:s/d.csv", "dataset"), ("figure:top.png", "figure"), ("dataset:lost.csv", "dataset"), ("dataset:top.csv", "dataset")}
    by = {r.dst: r for r in edges.collect()}
    assert len(by["dataset:s/d.csv"].occurrences) == 2 and by["figure:top.png"].type == "writes"
    assert json.loads(by["dataset:lost.csv"].occurrences[0]) == {"file": "s/a.R", "line": 4, "callee": "f", "missing": True}


def test_paper_graph(spark):
    text = "\\cite{Early}\n\\section{R}\n\\includegraphics{fig/a} \\cite{B}\n\\includegraphics{ghost}\n"
    lines = files.lines(spark.createDataFrame([("p/x.tex", text)], "path string, text string"))
    heads = papers.sections(lines, "tex")
    links = papers.links(lines, "tex").join(papers.with_section(lines, heads).select("path", "line_no", "section"), ["path", "line_no"])
    shown = dataflow.figures(links.filter("link = 'includes'"), spark.createDataFrame([("p/fig/a.png",), ("p/fig/a.svg",)], "path string"))
    refs = bibliography.references(bibliography.read(spark.createDataFrame([("b.bib", "@misc{b, title={T}}")], "path string, text string")), links.filter("link = 'cites'"))
    nodes, edges = dataflow.paper_graph(heads, shown, links.filter("link = 'cites'"), refs, "latex")
    assert {(r.src, r.dst, r.type) for r in edges.collect()} == {("section:p/x.tex#preamble", "ref:early", "cites"), ("section:p/x.tex#r", "figure:p/fig/a.png", "includes"), ("section:p/x.tex#r", "ref:b", "cites")}
    assert {(r.id, r.title) for r in nodes.collect()} == {("section:p/x.tex#preamble", "Preamble/Abstract"), ("section:p/x.tex#r", "R"), ("figure:p/fig/a.png", "p/fig/a.png"), ("ref:b", "T"), ("ref:early", None)}


def test_blame(spark):
    a, z = "a" * 40, "0" * 40
    text = f"{a} 1 1 2\nauthor X\n\tcode\n{a} 2 2\n\t{a} 9 9\n{z} 3 3 1\n\tnew\n"
    rows = history.blame(spark.createDataFrame([("f.py", text), ("g.py", None)], "file string, text string"))
    assert sorted((r.file, r.line_no, r.sha) for r in rows.collect()) == [("f.py", 1, a), ("f.py", 2, a)]


def test_project_ingest_and_command_line(spark, tmp_path, capsys):
    root, target = tmp_path / "p", str(tmp_path / "store")

    def put(name, text):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    put("paper/x.tex", "\\section{Results}\nWe reach 92.1\\% here. % 55.5\\%\n\\includegraphics{fig/a} \\cite{B}\n")
    put("paper/fig/a.png", "")
    put("refs.bib", "@misc{b, title={T}}")
    put("notes.md", "# Notes\nIt was 0.42 then.\n")
    put("README.md", "# R\n0.42\n")
    put("s.R", 'x <- read.csv("d.csv")\nggsave("paper/fig/a.png")\n')
    put("t.py", "pd.read_csv('lost.csv')\nplt.savefig('paper/fig/a.png')\nplt.savefig('gone.png')\n")
    sha = "5" * 40
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "t.py.blame").write_text(f"{'6' * 40} 1 1 1\n\tx\n{sha} 2 2 2\n\ty\n{sha} 3 3\n\tz\n")
    put("d.csv", "a\n")
    put("mlruns/0/r1/meta.yaml", "run_id: r1\n")
    put("mlruns/0/r1/metrics/acc", "1 0.9214 0\n")
    put("mlruns/0/r1/tags/mlflow.source.git.commit", sha + "\n")
    put("mlruns/0/r1/artifacts/plots/a.png", "")
    put("old/d.csv", "")
    (tmp_path / "log").write_text(f"\x1e{sha}\x1fAnn\x1fa@x\x1f2024-01-02T00:00:00Z\x1ffirst\x1f\n\x00s.R\x00")
    run = lambda *a: main(["--store", target, *a], spark)
    assert run("find", "x") == 1  # an empty store
    assert run("ingest", str(root), "--log", str(tmp_path / "log"), "--blame", str(tmp_path / "lines")) == 0
    edges = {(r.src.split("#")[0], r.dst, r.type, r.status) for r in store.read(spark, target, "edges").collect()}
    assert edges == {
        ("section:paper/x.tex", "figure:paper/fig/a.png", "includes", "auto"), ("section:paper/x.tex", "ref:b", "cites", "auto"),
        ("script:s.R", "dataset:d.csv", "reads", "auto"), ("script:s.R", "figure:paper/fig/a.png", "writes", "auto"), ("script:t.py", "dataset:lost.csv", "reads", "auto"),
        ("claim:paper/x.tex", "experiment:r1", "backed_by", "pending"), (f"commit:{sha}", "contributor:a@x", "authored_by", "auto"),
        (f"commit:{sha}", "experiment:r1", "implements", "auto"), (f"commit:{sha}", "figure:paper/fig/a.png", "generates", "auto"),
        ("script:t.py", "figure:paper/fig/a.png", "writes", "auto"), ("script:t.py", "figure:gone.png", "writes", "auto"), ("experiment:r1", "figure:paper/fig/a.png", "produces", "auto"),
    }
    claim = store.read(spark, target, "edges").filter("type = 'backed_by'").first()
    assert run("confirm", claim.src, claim.dst, "backed_by", "claims") == 0 and run("confirm", "no", claim.dst, "backed_by", "claims") == 1
    put("paper/x.tex", "\\section{Results}\nNothing.\n")
    put("notes.md", "# Notes\nNothing.\n")
    assert run("ingest", str(root)) == 0
    left = store.read(spark, target, "nodes").filter("type = 'claim'").collect()
    assert [r.id for r in left] == [claim.src]  # a person judged it; the other claim is gone
    assert store.read(spark, target, "edges").filter("type = 'backed_by'").first().status == "confirmed"
    capsys.readouterr()
    assert run("query", claim.src) == 0 and run("query", "no") == 1
    assert run("trace", "experiment:r1", "--hops", "1") == 0 and run("status") == 0 and run("status", "--pending") == 0
    shown = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert run("lineage", str(root)) == 1
    blocks = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(b["block"], b.get("target") or b.get("path")) for b in blocks] == [("scanned", None), ("orphans", "dataset:d.csv"), ("orphans", "dataset:lost.csv"), ("broken_links", "dataset:lost.csv"), ("broken_links", "figure:gone.png"), *[("duplicates", p) for p in sorted({b["path"] for b in blocks if b["block"] == "duplicates"})]]
    assert {b["path"] for b in blocks if b["block"] == "duplicates" and b["is_read"]} == {"d.csv"} and sum(b["block"] == "duplicates" for b in blocks) == 2
    assert (blocks[0]["scripts"], blocks[0]["targets"], blocks[0]["reads_edges"], blocks[0]["writes_edges"]) == (2, 4, 2, 3)
    assert shown[0]["type"] == "claim" and shown[1]["direction"] == "out" and all(x["depth"] == 1 for x in shown[2:5])


def test_run_graph(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    found = rows([("r1", "meta", "run_name", "m"), ("r1", "tags", "mlflow.source.git.commit", "s1"), ("r2", "tags", "mlflow.source.git.commit", "gone"), ("r3", "tags", "mlflow.runName", "")], "run_id string, kind string, name string, value string")
    artifacts = rows([("r1", "x/a.png"), ("r1", "y/a.png"), ("r1", "b.png"), ("r1", "c.png")], "run_id string, artifact string")
    figures = rows([("figure:a.png",), ("figure:p/b.png",), ("figure:q/b.png",)], "id string")
    nodes, edges = trackers.run_graph(found, artifacts, figures, rows([("commit:s1",)], "id string"))
    assert {(r.id, r.title) for r in nodes.collect()} == {("experiment:r1", "m"), ("experiment:r2", "r2"), ("experiment:r3", "r3")}
    assert {(r.src, r.dst, r.type, len(r.occurrences)) for r in edges.collect()} == {("commit:s1", "experiment:r1", "implements", 1), ("experiment:r1", "figure:a.png", "produces", 2)}
