"""Single operators on small inputs: traversal, keys, folds, and the places where languages differ."""

import pytest
from pyspark.sql import functions as F

from quarrygraph.functions import evidence, text
from quarrygraph.operators import graph, joins, lineage, sequences, snapshots

EDGE = "src string, dst string, type string, extractor string, status string"


def small(spark):
    nodes = spark.createDataFrame([(x, x.split(":")[0], x) for x in ("commit:a", "experiment:x", "figure:f", "section:s", "reference:r", "contributor:c", "claim:lone")], "id string, type string, title string")
    edges = spark.createDataFrame([("commit:a", "experiment:x", "implements", "t", "auto"), ("experiment:x", "figure:f", "produces", "t", "auto"), ("section:s", "figure:f", "includes", "t", "auto"), ("section:s", "reference:r", "cites", "t", "auto"), ("commit:a", "contributor:c", "authored_by", "t", "auto")], EDGE)
    return nodes, edges


def test_trace_depths(spark):
    nodes, edges = small(spark)
    found = {(r.type, r.depth) for r in graph.trace(nodes, edges, "figure:f").collect()}
    assert found == {("produces", 1), ("includes", 1), ("implements", 2), ("cites", 2), ("authored_by", 3)}
    assert {r.type for r in graph.trace(nodes, edges, "figure:f", 1).collect()} == {"produces", "includes"}


def test_trace_cycle_isolated_unknown(spark):
    nodes, edges = small(spark)
    ring = edges.filter("type = 'includes'").union(spark.createDataFrame([("figure:f", "section:s", "supports", "t", "auto")], EDGE))
    assert graph.trace(nodes, ring, "figure:f").count() == 2
    assert graph.trace(nodes, edges, "claim:lone").count() == 0
    assert graph.trace(nodes, edges, "claim:none").count() == 0
    with pytest.raises(ValueError):
        graph.trace(nodes, edges, "figure:f", 0)


def test_evidence_fold_rotates_and_readmits(spark):
    df = spark.createDataFrame([(["a", "b"], ["c", "b", "d", "a"])], "held array<string>, new array<string>")
    assert df.select(evidence.fold(F.col("held"), F.col("new"), 3).alias("x")).first().x == ["c", "d", "a"]
    many = spark.createDataFrame([([], [str(i) for i in range(30)])], "held array<string>, new array<string>")
    assert many.select(evidence.fold(F.col("held"), F.col("new")).alias("x")).first().x == [str(i) for i in range(10, 30)]


def test_half_up_by_row(spark):
    df = spark.createDataFrame([(0.285, 2), (0.8735, 3), (2.5, 0), (float("inf"), 1), (float("nan"), 1)], "v double, p int")
    got = [r.x for r in df.select(text.half_up(text.exact_decimal(F.col("v")), F.col("p")).cast("string").alias("x")).collect()]
    assert [x and float(x) for x in got] == [0.29, 0.874, 3.0, None, None]


def test_lines_and_strip(spark):
    df = spark.createDataFrame([("a\r\nb\x0bc d\n", "  x\t")], "t string, s string")
    r = df.select(text.split_lines(F.col("t")).alias("l"), text.strip(F.col("s")).alias("s")).first()
    assert r.l == ["a", "b", "c", "d"] and r.s == "x"


def test_paths():
    assert [text.norm_path(p) for p in ("a/../b", "../x", "/abs", "", "a/./b//c", None, ".")] == ["b", None, None, None, "a/b/c", None, None]


def test_slugs_do_not_depend_on_order(spark):
    rows = [("f", 1, "Intro"), ("f", 2, "Intro"), ("f", 3, "intro!"), ("f", 4, "引言")]
    df = spark.createDataFrame(rows, "file string, pos int, title string")
    got = {r.pos: r.slug for r in sequences.section_slugs(df, "file", "title", "pos").collect()}
    assert got[2] == got[1] + "-2" and got[1].startswith("intro-") and got[3] != got[1] and got[4].startswith("section-ef6fba91")


def test_sticky_status_and_orphans(spark):
    e = "src string, dst string, type string, extractor string, confidence double, status string, occurrences array<string>"
    held = spark.createDataFrame([("a", "b", "backed_by", "claims", 0.5, "confirmed", ["1"])], e)
    delta = spark.createDataFrame([("a", "b", "backed_by", "claims", 1.0, "pending", ["2"], 1), ("a", "c", "backed_by", "claims", 1.0, "pending", ["3"], 2)], e + ", seq int")
    got = {r.dst: r for r in snapshots.upsert_edges(held, delta).collect()}
    assert got["b"].status == "confirmed" and got["b"].occurrences == ["1", "2"] and got["b"].confidence == 1.0
    assert got["c"].status == "pending" and got["c"].occurrences == ["3"]
    again = snapshots.upsert_edges(snapshots.upsert_edges(held, delta), delta)
    assert {r.dst: r.occurrences for r in again.collect()} == {"b": ["1", "2"], "c": ["3"]}


def test_unique_key_and_ranked(spark):
    left = spark.createDataFrame([(1, "a.png"), (2, "b.png"), (3, "c.png")], "run int, base string")
    right = spark.createDataFrame([("a.png", "x/a.png"), ("b.png", "x/b.png"), ("b.png", "y/b.png")], "base string, path string")
    assert [tuple(r) for r in joins.unique_key_join(left, right, "base").collect()] == [("a.png", 1, "x/a.png")]


def test_lineage(spark):
    uses = spark.createDataFrame([("s1", "d1", "reads", False, True), ("s2", "d2", "writes", True, True), ("s1", "d2", "reads", False, True), ("s1", "f1", "reads", False, False)], "script string, target string, kind string, missing boolean, is_data boolean")
    assert [r.target for r in lineage.orphans(uses).collect()] == ["d1"]
    assert [(r.target, r.writers, r.readers) for r in lineage.chains(uses).collect()] == [("d2", "s2", "s1")]
    assert [(r.script, r.kind) for r in lineage.broken(uses).collect()] == [("s2", "writes")]
    assert tuple(lineage.scanned(uses.limit(0)).first()) == (0, 0, 0, 0)


def test_clamped_depth(spark):
    steps = [1, -1, -1, 1, 1, -1]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(steps)], "g int, i int, s int")
    assert [r.depth for r in sequences.clamped_depth(df, ["g"], ["i"], "s").orderBy("i").collect()] == [1, 0, 0, 1, 2, 1]
