"""Readers on small fixtures, the store's commits, and streaming ingest."""

import json

import pytest
from pyspark.sql import functions as F

from quarrygraph.sources import attempts, files, history, papers, scripts, store, trackers
from quarrygraph.streaming import ingest


def as_lines(spark, text, path="p"):
    return files.lines(spark.createDataFrame([(path, text)], "path string, text string"))


def test_inventory_and_texts(spark, tmp_path):
    for name in ("a b/x.TEX", "a b/f.png", ".hid/x.tex", "node_modules/x.tex", "x+y.md", "none.xyz"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("one\ntwo\n")
    (tmp_path / "a b" / "empty.csv").write_text("")
    root = str(tmp_path)
    assert {(r.path, r.category, r.length) for r in files.inventory(spark, root).collect()} == {("a b/x.TEX", "tex", 8), ("a b/f.png", "image", 8), ("x+y.md", "md", 8), ("a b/empty.csv", "data", 0)}
    assert [(r.line_no, r.line) for r in files.lines(files.texts(spark, root, "*.md")).collect()] == [(1, "one"), (2, "two")]


def test_history(spark):
    log = "\x1es1\x1fAnn\x1f Ann@X.org \x1f2024-01-02T00:00:00+09:00\x1ffirst\nmore\n\x1f\n\x00a.py\x00b.py\x00\x1ebad\x1es2\x1fBo\x1f\x1f2024-01-03T00:00:00Z\x1fsecond\x1f\n\x00b.py\x00"
    c = history.commits(spark.createDataFrame([("log", log)], "path string, text string"))
    assert [(r.sha, r.files) for r in c.orderBy("ordinal").collect()] == [("s1", ["a.py", "b.py"]), ("s2", ["b.py"])]
    assert {(r.file, r.sha) for r in history.last_touch(c).collect()} == {("a.py", "s1"), ("b.py", "s2")}
    nodes, edges = history.commit_graph(c)
    assert {(r.id, r.title) for r in nodes.collect()} == {("commit:s1", "first"), ("commit:s2", "second"), ("contributor:ann@x.org", "Ann")}
    assert [(r.src, r.dst) for r in edges.collect()] == [("commit:s1", "contributor:ann@x.org")]


def test_tex(spark):
    lines = as_lines(spark, "\\cite{Early}\n\\section{Results \\emph{x}}\n\\includegraphics[w=1]{fig/a} \\citep[see][]{A, b} % \\cite{no}\n5\\% \\cite{c}\n")
    heads = papers.sections(lines, "tex")
    assert [(r.line_no, r.level, r.id) for r in heads.collect()] == [(2, "section", "section:p#results-emph-x")]
    assert sorted((r.line_no, r.link, r.target) for r in papers.links(lines, "tex").collect()) == [(1, "cites", "early"), (3, "cites", "a"), (3, "cites", "b"), (3, "includes", "fig/a"), (4, "cites", "c")]
    assert [r.section is None for r in papers.with_section(lines, heads).orderBy("line_no").collect()] == [True, False, False, False]


def test_markdown_fences_and_claims(spark):
    text = "# Head #\n```py\n~~~\n0.5\n```\nWe reach 92.1% and 0.873. Then 2.5-fold, v1.2.3 and $0.75$.\n~~~\n# no\n"
    lines = papers.without_fences(as_lines(spark, text))
    assert [r.line_no for r in lines.filter("line <> ''").orderBy("line_no").collect()] == [1, 6]
    got = papers.claims(papers.with_section(lines, papers.sections(lines, "md"))).orderBy("line_no", "sentence", "seq").collect()
    assert sorted((r.raw, float(r.value), r.places, r.unit_form, r.seq) for r in got) == [("$0.75$", 0.75, 2, "fraction", 1), ("0.873", 0.873, 3, "fraction", 2), ("92.1%", 0.921, 3, "percent", 1)]
    assert len({r.id for r in got}) == 3 and all(r.id.startswith("claim:p#") for r in got)


def test_tracker_folder(spark):
    rows = [("0/r1/meta.yaml", "run_id: 'r1'\n# c\nstatus: 3\nstatus: 4\n"), ("0/r1/params/lr", "0.1\n"), ("0/r1/metrics/acc", "1 0.5 0\n2 0.75 1\n\n"), ("0/r1/metrics/bad", "1 x 0"), ("0/r1/metrics/d", "1 1d 0"), ("0/r1/tags/mlflow.user", "u"), ("0/r1/tags/other", "v"), ("0/r2/params/lr", "1"), ("models/r3/meta.yaml", "a: b"), ("0/tags/meta.yaml", "a: b")]
    got = trackers.runs(trackers.facts(trackers.run_files(spark.createDataFrame(rows, "path string, text string")))).collect()
    assert [(r.run_id, r.meta, r.params, r.tags, r.metrics) for r in got] == [("r1", {"run_id": "r1", "status": "4"}, {"lr": "0.1"}, {"mlflow.user": "u"}, {"acc": 0.75})]


def test_saved_pages(spark, tmp_path):
    node = lambda n: {"node": {"name": n, "state": "finished", "config": "{}", "summaryMetrics": '{"a": 1}'}}
    (tmp_path / "1.json").write_text(json.dumps({"data": {"project": {"runs": {"edges": [node("a"), node("")]}}}}))
    assert [(r.run_id, r.summary) for r in trackers.saved_pages(spark, str(tmp_path)).collect()] == [("a", '{"a": 1}')]


def test_attempt_table(spark):
    text = "# Log\n| x |\n|---|\n## Attempts so far\ntext\n| # | What |\n|---|:-:|\n| 1 | **a** `b` (3-5) |\n| 1 | again |\n| | none |\n| 2 | c \\| d | e |\n| 3 | p \\| [q](u) (9-7) |\n\n| 4 | late |\n"
    columns = {"number": "#", "what": "What"}
    rows = attempts.first_of_number(attempts.table(as_lines(spark, text), "Attempts", columns))
    got = rows.withColumn("s", attempts.steps(F.col("what"))).orderBy("line_no").collect()
    assert [(r.id, r.what, r.s) for r in got] == [("attempt:p#1", "a b (3-5)", [3, 4, 5]), ("attempt:p#3", "p | q (9-7)", [])]
    with pytest.raises(attempts.TableNotFound):
        attempts.table(as_lines(spark, "# Other\n| # | What |\n|---|---|\n"), "Attempts", columns)
    assert attempts.table(as_lines(spark, "# Attempts\n| # | What |\n|---|---|\n"), "Attempts", columns).count() == 0
    refs = spark.createDataFrame([("a", [1, 2])], "id string, step_refs array<int>")
    found = attempts.check_steps(refs, spark.createDataFrame([("s/1-x.R",), ("s/y.R",)], "file string"))
    assert {(r.step, r.broken) for r in found.collect()} == {(1, False), (2, True)}


def test_scripts(spark):
    code = "import os\nD = 'data'\nP = D + '/x.csv'\nQ = 'q'\nQ = 'r'\npd.read_csv(P)\ndf.to_csv(os.path.join(D, f'{D}.csv'))\nopen(Q)\nopen('a', 'w')\nopen('b', 'ab')\nplt.savefig(fname='f.png')\nread_csv(Q)\n"
    rows = spark.createDataFrame([("s.py", code), ("bad.py", "def ("), ("none.py", None), ("star.py", "from m import *\nD='x'\nread_csv(D)")], "path string, text string")
    assert sorted((r.line_no, r.kind, r.target, r.folded_from) for r in scripts.uses(rows).collect()) == [(6, "reads", "data/x.csv", "P"), (7, "writes", "data/data.csv", "os.path.join(D, f'{D}.csv')"), (9, "writes", "a", None), (11, "writes", "f.png", None)]


EDGES = "src string, dst string, type string, extractor string, status string"


def test_store_commits_and_conflicts(spark, tmp_path):
    root = str(tmp_path / "store")
    nodes = spark.createDataFrame([("a", "claim", None), ("b", "experiment", "t")], "id string, type string, title string")
    edges = spark.createDataFrame([("a", "b", "backed_by", "t", "pending")], EDGES)
    assert store.version(spark, root) == 0 and store.read(spark, root, "nodes") is None
    assert store.commit(spark, root, nodes, edges, 0) == 1
    with pytest.raises(store.Conflict):
        store.commit(spark, root, nodes, edges, 0)
    with pytest.raises(ValueError, match="end of an edge"):
        store.commit(spark, root, nodes.filter("id = 'a'"), edges, 1)
    assert store.update(spark, root, lambda n, e: (n, e.withColumn("status", F.lit("confirmed")))) == 2
    assert store.read(spark, root, "edges").first().status == "confirmed" and store.read(spark, root, "edges", 1).first().status == "pending"


def test_streaming_ingest(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    put = lambda name, *rows: (landing / name).write_text("\n".join(json.dumps(r) for r in rows))
    put("1.json", {"seq": 1, "id": "a", "type": "claim", "title": "x"}, {"seq": 2, "id": "a", "type": "claim", "title": "y"}, {"seq": 3, "id": None})
    run = lambda: ingest.follow_nodes(spark, str(landing), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    run()
    put("2.json", {"seq": 1, "id": "b", "type": "commit", "title": "z"}, {"seq": 2, "id": "a", "type": "claim", "title": "w"})
    run()
    assert {(r.id, r.title) for r in store.read(spark, str(tmp_path / "store"), "nodes").collect()} == {("a", "w"), ("b", "z")}
