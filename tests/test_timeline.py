"""A table of attempts from file to store to findings; repositories, settings, saved pages and reviews."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrygraph.__main__ import main
from quarrygraph.operators import review, snapshots
from quarrygraph.plans import timeline
from quarrygraph.sources import attempts, config, git, store, trackers

TABLE = """# Map
## Attempts
| # | Date | What | Vars | Result | Verdict |
|---|---|---|---|---|---|
| 1 | 2020-01-05 | step (1) uses old_x | a | r1 | alive |
| 14a | 01-09 | steps (2-4) | old_x | r2 | alive |
| 2 | soon | step (1) | b | r3 | dead, old_x |
| 2 | 2020-01-01 | again | c | r4 | alive |
| 3 | 2020 | ragged |
"""
SETTINGS = 'file = "map.md"\nheading = "Attempts"\nsteps_dir = "steps"\ndead_variables = ["OLD_X"]\nactive_verdicts = ["alive"]\ndate_year = 2020\n[columns]\nnumber = "#"\ndate = "Date"\ndescription = "What"\nvariables = "Vars"\nresult = "Result"\nverdict = "Verdict"\n'


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "p"
    (root / "steps").mkdir(parents=True)
    (root / ".quarrygraph").mkdir()
    (root / timeline.SETTINGS).write_text(SETTINGS)
    (root / "map.md").write_text(TABLE)
    for n in ("1-a.py", "2-b ü.py", "7-c.py"):
        (root / "steps" / n).write_text("x = 1\n")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=A", "-c", "user.email=A@X.org", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "steps/1-a.py", "steps/2-b ü.py")
    run("commit", "-qm", "first\n\nbody", "--date", "2020-01-07T23:30:00-0800")
    return root


def test_repository(spark, project, tmp_path):
    log = git.log(spark, str(project)).collect()
    assert [(r.message, sorted(r.files), r.authored_at[:10]) for r in log] == [("first\n\nbody", ["steps/1-a.py", "steps/2-b ü.py"], "2020-01-07")]
    assert git.head(str(project)) == log[0].sha
    assert [r.path for r in git.tracked(spark, str(project)).orderBy("path").collect()] == ["steps/1-a.py", "steps/2-b ü.py"]
    assert [(r.file, r.line_no, r.sha) for r in git.blame(spark, str(project), ["steps/1-a.py", "steps/7-c.py"]).collect()] == [("steps/1-a.py", 1, log[0].sha)]
    assert not git.readable("a\udcff") and git.readable("ü")
    with pytest.raises(git.NotARepository):
        git.log(spark, str(tmp_path))
    empty = tmp_path / "empty"
    subprocess.run(["git", "init", "-q", str(empty)], check=True)
    assert git.head(str(empty)) is None and git.log(spark, str(empty)).count() == 0


def test_attempts_and_checks(spark, project, tmp_path, capsys):
    target = str(tmp_path / "store")
    counts = timeline.sync(spark, str(project), target)
    assert counts == {"attempts": 3, "repeated": 1, "created": 3, "removed": 0, "edges_removed": 0, "preserved": 0}
    held = {r.number: r for r in attempts.stored(store.read(spark, target, "nodes")).collect()}
    assert (held["1"].verdict, held["1"].step_files, held["14a"].step_files_broken, held["14a"].step_refs) == ("alive", ["1-a.py"], [3, 4], [2, 3, 4])
    found = timeline.checks(spark, str(project), target)
    broken = {(r.attempt[-3:], r.missing_step, r.lower, r.higher) for r in found["broken_references"].findings.collect()}
    assert broken == {("14a", 3, 2, 7), ("14a", 4, 2, 7)}
    stale = [(r.attempt[-2:], r.script, r.script_last_touched, r.basis) for r in found["stale_verdicts"].findings.collect()]
    assert stale == [("#1", "steps/1-a.py", "2020-01-07", "git")]
    assert found["stale_verdicts"].coverage.first().asDict() == {"total": 3, "checked": 2}
    assert {(r.attempt[-3:], r.field) for r in found["revived_dead_variables"].findings.collect()} == {("d#1", "description"), ("14a", "variables")}
    edges = store.read(spark, target, "edges")
    assert edges.filter("type = 'uses'").count() == 2 and store.read(spark, target, "nodes").filter("type = 'commit'").count() == 1
    assert main(["--store", target, "attempts", str(project)], spark) == 0
    listed = [json.loads(x).get("number") for x in capsys.readouterr().out.splitlines() if x.startswith("{")][1:]
    assert listed == ["1", "2", "14a"]
    assert main(["--store", target, "attempts", str(project), "--check"], spark) == 1
    # A row that goes takes its edges along, unless one was judged.
    key = edges.filter("src like '%#14a'").first()
    store.update(spark, target, lambda n, e: (n, snapshots.set_status(e, spark.createDataFrame([(key.src, key.dst, key.type, key.extractor, "confirmed")], "src string, dst string, type string, extractor string, new_status string"))))
    (project / "map.md").write_text("\n".join(x for x in TABLE.split("\n") if not x.startswith(("| 1 ", "| 14a"))).replace("dead, old_x", "revised"))
    counts = timeline.sync(spark, str(project), target)
    assert (counts["removed"], counts["edges_removed"], counts["preserved"]) == (1, 1, 1)
    assert {r.number: r.verdict for r in attempts.stored(store.read(spark, target, "nodes")).collect()} == {"14a": "alive", "2": "revised"}
    # A table that isn't there removes nothing.
    (project / "map.md").write_text("# Map\n")
    with pytest.raises(attempts.TableNotFound):
        timeline.sync(spark, str(project), target)
    assert main(["--store", target, "attempts", str(project)], spark) == 1
    assert attempts.stored(store.read(spark, target, "nodes")).count() == 2


def test_skipped_checks(spark, project, tmp_path):
    (project / timeline.SETTINGS).write_text("\n".join(x for x in SETTINGS.split("\n") if not x.startswith(("steps_dir", "dead"))))
    target = str(tmp_path / "store")
    timeline.sync(spark, str(project), target)
    found = timeline.checks(spark, str(project), target)
    assert all(c.findings is None and c.skipped for c in found.values())
    (project / timeline.SETTINGS).write_text(SETTINGS.replace('["OLD_X"]', "[]"))
    assert timeline.checks(spark, str(project), target)["revived_dead_variables"].findings.count() == 0


@pytest.mark.parametrize("text", ["file = 1", "= x", SETTINGS.replace('date = "Date"\n', ""), SETTINGS.replace("2020", '"2020"')])
def test_wrong_settings(tmp_path, text):
    (tmp_path / "s.toml").write_text(text)
    with pytest.raises(config.ConfigError):
        config.read(str(tmp_path / "s.toml"))
    with pytest.raises(config.ConfigError):
        config.read(str(tmp_path / "none.toml"))


def test_saved_pages_graph(spark, tmp_path):
    node = lambda name, **k: {"node": {"name": name, "displayName": f"Run {name}", "state": "finished", "config": json.dumps({"lr": 0.1, "img": {"_type": "image-file", "path": "x"}, "long": "y" * 5_000}), "summaryMetrics": '{"acc": 0.9, "n": 3, "flag": true, "text": "0.5"}', "tags": ["t"], **k}}
    files = lambda *n: {"edges": [{"node": {"name": x}} for x in n]}
    edges = [node("a", commit=" s1 ", files=files("media/one.png", "two.png", "log.txt")), node("b", commit="s9", config="no json", files=files("one.PNG")), node("c", summaryMetrics="[1]"), node("")]
    (tmp_path / "1.json").write_text(json.dumps({"data": {"project": {"runs": {"edges": edges, "pageInfo": {"hasNextPage": False}}}}}))
    runs = trackers.saved_pages(spark, str(tmp_path))
    blobs = {r.run_id: json.loads(r.config) for r in runs.collect()}
    assert blobs["a"] == {"lr": 0.1, "img": {"_type": "image-file", "_stripped": True}, "long": "y" * 4_000 + "...<truncated>"} and blobs["b"] == {}
    numbers = {(r.run_id, r.source, r.name, r.value) for r in trackers.numbers(runs, ["run_id"], {"summary": F.col("summary"), "config": F.col("config")}).collect()}
    assert {x for x in numbers if x[0] == "a"} == {("a", "summary", "acc", 0.9), ("a", "summary", "n", 3.0), ("a", "config", "lr", 0.1)} and not any(x[:2] == ("c", "summary") for x in numbers)
    figures = spark.createDataFrame([("figure:f/one.png",), ("figure:f/two.png",), ("figure:g/two.png",)], "id string")
    nodes, found, skipped = trackers.page_graph(runs, figures, spark.createDataFrame([("commit:s1",)], "id string"))
    assert {(r.src, r.dst) for r in found.collect()} == {("commit:s1", "experiment:a"), ("experiment:a", "figure:f/one.png")}
    assert {r.reason: r.n for r in skipped.collect()} == {"unknown commit": 1, "no single figure": 2, "no commit": 1} and nodes.count() == 3
    (tmp_path / "2.json").write_text('{"errors": []}')
    with pytest.raises(trackers.PageError):
        trackers.saved_pages(spark, str(tmp_path))


def test_what_counts_of_an_answer():
    ok = {"related": False, "reason": " x " + "y" * 400, "better_match": "acc"}
    assert review.sanitized(ok, ["acc"])[2:] == ("acc", False) and review.sanitized(ok, ["lr"])[2:] == (None, True)
    assert review.sanitized(ok, [])[1].endswith("y ...") and len(review.sanitized(ok, [])[1]) == 304
    for bad in (None, [], {}, {"related": 1, "reason": "x"}, {"related": True, "reason": " "}, {"related": True, "reason": 3}):
        with pytest.raises(review.ReviewError):
            review.sanitized(bad, [])
    review.conforms({"a": [1, 2.5], "b": None}, {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "number"}}, "b": {"type": ["string", "null"]}}, "required": ["a"]})
    for value, form in (([True], {"type": "array", "items": {"type": "number"}}), ("x", {"enum": ["y"]}), ({}, review.ANSWER)):
        with pytest.raises(review.ReviewError):
            review.conforms(value, form)
    with pytest.raises(review.ReviewError):
        review.parsed("{no")


def test_reviews_of_which_all_or_none_succeed(spark):
    """A batch in which a text column has nothing, or nothing but errors, keeps its columns' types."""
    rows = [(f"c{k}", "r", "backed_by", "x", "pending", [f'{{"metric":"acc","metric_value":0.5,"claim_raw":"{k}"}}']) for k in range(4)]
    edges = spark.createDataFrame(rows, "src string, dst string, type string, extractor string, status string, occurrences array<string>").coalesce(1)
    claims = spark.createDataFrame([(f"c{k}", "s", "x") for k in range(4)], "id string, sentence string, raw string")
    runs = spark.createDataFrame([("r", "t", {"lr": "1"}, {"acc": 0.5})], "id string, title string, params map<string,string>, metrics map<string,double>")

    def one_fails(text):
        if "Printed number: 2" in text:
            raise RuntimeError
        return {"related": True, "reason": "ok", "better_match": None}

    def all_fail(text):
        raise RuntimeError("none")

    for answer, want in ((one_fails, [None, None, "RuntimeError", None]), (all_fail, ["none"] * 4), (lambda text: {"related": True, "reason": "ok"}, [None] * 4)):
        got = sorted(review.review(edges, claims, runs, answer, "stub").coalesce(1).collect())
        assert [r.error for r in got] == want and {r.better_match for r in got} == {None}
        assert [r.related for r in got] == [True if e is None else None for e in want] and {r.metric_value for r in got} == {0.5}
    lost = review.totals(review.review(edges, claims.limit(0), runs, all_fail, "stub")).first()
    assert tuple(lost) == (4, 0, 4)
