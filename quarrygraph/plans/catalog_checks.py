"""Queries of the store's operators, the checks of attempts and the reviews, made of the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consistency, graph, review, snapshots
from ..sources import history
from .catalog import query
from .standin import EDGES, NODES, edges, nodes, table


def located(spark, sf_dir):
    attrs = F.when(F.expr("substring(id, 7) % 5 = 0"), F.lit('{"tex_path":"p.tex"}')).otherwise(F.concat(F.lit('{"tex_path":"p.tex","line":'), F.expr("substring(id, 7) % 1000").cast("int"), F.lit("}")))
    return nodes(spark, sf_dir).withColumn("attrs", F.when(F.col("type") == "claim", attrs).otherwise("{}"))


@query(f"WITH {EDGES}, e AS (SELECT * FROM edges WHERE dst = 'customer:7' OR src = 'customer:7') SELECT src, dst, type, status, CASE WHEN type = 'backed_by' AND TRY_CAST(substr(src, 7) AS BIGINT) % 5 <> 0 THEN 'p.tex' END AS source_file, CASE WHEN type = 'backed_by' AND TRY_CAST(substr(src, 7) AS BIGINT) % 5 <> 0 THEN CAST(TRY_CAST(substr(src, 7) AS BIGINT) % 1000 AS INTEGER) END AS source_line FROM e")
def trace_locations(spark, sf_dir):
    n = located(spark, sf_dir)
    found = graph.trace(n, edges(spark, sf_dir), "customer:7", 1)
    return graph.with_location(found, n).select("src", "dst", "type", "status", "source_file", "source_line")


@query(f"WITH {EDGES} SELECT * FROM edges WHERE type = 'backed_by' AND status = 'rejected'")
def select_edges(spark, sf_dir):
    return graph.select(edges(spark, sf_dir), type="backed_by", status="rejected", src=None)


@query(f"WITH {EDGES} SELECT * FROM edges WHERE status = 'pending' ORDER BY src, dst, type, extractor LIMIT 1 OFFSET 6")
def queue_nth(spark, sf_dir):
    return graph.nth(edges(spark, sf_dir), "pending", 7)


@query(f"WITH {NODES} SELECT id, type, CASE WHEN type = 'commit' AND id LIKE '%1' THEN '{{\"verdict\":\"kept\"}}' ELSE '{{}}' END AS human_fields FROM nodes")
def human_fields(spark, sf_dir):
    n = nodes(spark, sf_dir).withColumn("human_fields", F.lit("{}"))
    said = n.filter("type = 'commit' AND id LIKE '%1'").select("id", F.lit('{"verdict":"kept"}').alias("fields")).union(spark.createDataFrame([("nobody", "{}")], "id string, fields string"))
    return snapshots.set_human_fields(n, said).select("id", "type", "human_fields")


@query(f"WITH {NODES} SELECT id, type, title FROM nodes WHERE NOT (type = 'project' AND id LIKE '%9')")
def delete_nodes(spark, sf_dir):
    n = nodes(spark, sf_dir)
    loose = n.filter("type = 'project'").select(F.concat("id", F.lit("9")).alias("id"), "type", "title")
    return snapshots.delete_nodes(n.union(loose), edges(spark, sf_dir), loose)


@query(f"""WITH {NODES}, {EDGES}, gone AS (SELECT id FROM nodes WHERE id LIKE 'order:%' AND CAST(substr(id, 7) AS BIGINT) % 3 = 0), j AS (SELECT src AS id FROM edges WHERE status IN ('confirmed', 'rejected') UNION SELECT dst FROM edges WHERE status IN ('confirmed', 'rejected')),
r AS (SELECT id FROM gone WHERE id NOT IN (SELECT id FROM j)) SELECT (SELECT count(*) FROM r) AS removed, (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM r) OR dst IN (SELECT id FROM r)) AS edges_removed, (SELECT count(*) FROM gone) - (SELECT count(*) FROM r) AS preserved""")
def remove_missing(spark, sf_dir):
    n = nodes(spark, sf_dir)
    found = n.filter("id LIKE 'order:%' AND substring(id, 7) % 3 <> 0").select("id")
    return snapshots.remove_missing(n, edges(spark, sf_dir), "order:", found)[2]


def attempt_table(spark, sf_dir):
    """Orders as attempts: a script is one of 500 by order, and two steps are referred to that may not be there."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    date = F.when(k % 11 == 0, "soon").when(k % 2 == 0, F.date_format("o_orderdate", "MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(
        F.concat(F.lit("attempt:map.md#"), k).alias("id"), k.cast("string").alias("number"), date.alias("date"), F.col("o_orderpriority").alias("description"), F.concat(F.lit("var_"), k % 9).alias("variables"),
        F.when(F.col("o_orderstatus") == "O", "running well").otherwise("given up").alias("verdict"), F.array(F.concat((k % 500).cast("string"), F.lit("-run.py"))).alias("step_files"), F.array((k % 700).cast("int")).alias("step_files_broken"),
    )


_ATTEMPTS = """a AS (SELECT o_orderkey AS k, 'attempt:map.md#' || o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'soon' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderpriority AS description, 'var_' || o_orderkey % 9 AS variables, o_orderstatus = 'O' AS alive FROM orders)"""
_DATED = """t AS (SELECT l_orderkey % 500 AS f, max(struct_pack(d := strftime(l_shipdate, '%Y-%m-%d'), o := l_orderkey * 10 + l_linenumber)) AS x FROM lineitem WHERE l_orderkey % 500 % 3 <> 0 GROUP BY 1),
d AS (SELECT a.*, 'steps/' || k % 500 || '-run.py' AS script, x IS NOT NULL AS git, CASE WHEN x IS NOT NULL THEN CAST(x.d AS DATE) WHEN k % 500 % 6 = 3 THEN DATE '1996-06-17' END AS sd, CASE WHEN date = 'soon' THEN NULL WHEN k % 2 = 0 THEN try_cast('1995-' || date AS DATE) ELSE CAST(date AS DATE) END AS ad, x.o AS o FROM a LEFT JOIN t ON f = k % 500)"""


def _dated(spark, sf_dir, rows):
    item = table(spark, sf_dir, "lineitem").filter("l_orderkey % 500 % 3 <> 0")
    ordinal = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    log = item.select(F.array(F.concat(F.lit("steps/"), F.col("l_orderkey") % 500, F.lit("-run.py"))).alias("files"), F.struct(F.to_date("l_shipdate"), ordinal).alias("ordinal"), F.concat(F.lit("s"), ordinal).alias("sha"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T23:00:00-08:00")).alias("authored_at"))
    modified = spark.range(500).filter("id % 6 = 3").select(F.concat(F.lit("steps/"), "id", F.lit("-run.py")).alias("file"), F.lit("1996-06-17 22:00:00").cast("timestamp").alias("at"))
    return consistency.script_dates(rows, history.last_touch(log), modified, "steps")


@query(f"WITH {_ATTEMPTS}, {_DATED} SELECT id AS attempt, script, date AS attempt_date, CAST(sd AS VARCHAR) AS script_last_touched, CASE WHEN git THEN 'git' ELSE 'mtime' END AS basis FROM d WHERE ad < sd")
def stale_verdicts(spark, sf_dir):
    rows = attempt_table(spark, sf_dir)
    return consistency.stale_verdicts(rows, _dated(spark, sf_dir, rows), 1995).findings


@query(f"WITH {_ATTEMPTS}, {_DATED} SELECT count(*) AS total, count(ad) AS checked FROM d")
def stale_coverage(spark, sf_dir):
    rows = attempt_table(spark, sf_dir)
    return consistency.stale_verdicts(rows, _dated(spark, sf_dir, rows), 1995).coverage


@query(f"WITH {_ATTEMPTS}, {_DATED} SELECT DISTINCT id AS src, 'commit:s' || o AS dst, 'uses' AS type FROM d WHERE git AND ad IS NOT NULL")
def attempt_uses(spark, sf_dir):
    rows = attempt_table(spark, sf_dir)
    commits = spark.createDataFrame([], "sha string, message string, authored_at string, author_name string, author_email string, files array<string>")
    return consistency.uses(rows, _dated(spark, sf_dir, rows), 1995, commits)[1].select("src", "dst", "type")


@query(f"WITH {_ATTEMPTS}, s AS (SELECT x * 7 AS step FROM range(1, 90) t(x)) SELECT id AS attempt, CAST(k % 700 AS INTEGER) AS missing_step, (SELECT max(step) FROM s WHERE step < k % 700) AS lower, (SELECT min(step) FROM s WHERE step > k % 700) AS higher FROM a")
def broken_references(spark, sf_dir):
    steps = spark.range(1, 90).select((F.col("id") * 7).cast("int").alias("step"))
    return consistency.broken_references(attempt_table(spark, sf_dir), steps).findings


@query(f"WITH {_ATTEMPTS}, v AS (VALUES ('VAR_3'), ('urgent')) SELECT id AS attempt, 'description' AS field, col0 AS dead_variable, description AS excerpt FROM a, v WHERE alive AND contains(lower(description), lower(col0)) UNION ALL SELECT id, 'variables', col0, variables FROM a, v WHERE alive AND contains(lower(variables), lower(col0))")
def revived_variables(spark, sf_dir):
    return consistency.revived(attempt_table(spark, sf_dir), ["VAR_3", "urgent"], ["running", "open"]).findings


@query(f"WITH {_ATTEMPTS} SELECT CAST(k AS VARCHAR) AS number, date, description, CASE WHEN alive THEN 'running well' ELSE 'given up' END AS verdict, 1 AS steps FROM a")
def attempt_listing(spark, sf_dir):
    return consistency.listing(consistency.of_file(attempt_table(spark, sf_dir), "map.md"))


def _reviews(spark, sf_dir, limit=None):
    seen = F.array(F.lit("{}"), F.concat(F.lit('{"metric":"acc","metric_value":0.5,"claim_raw":"'), F.expr("substring(src, 7)"), F.lit('"}')))
    e = edges(spark, sf_dir).filter("type = 'backed_by'").withColumn("occurrences", seen)
    claims = table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0").select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("sentence"), F.lit("x").alias("raw"))
    runs = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.col("c_name").alias("title"), F.create_map(F.lit("lr"), F.lit("0.1")).alias("params"), F.create_map(F.lit("acc"), F.lit(0.5)).alias("metrics"))

    def answer(prompt: str) -> dict:
        n = int(prompt.split("Printed number: ")[1].split("\n")[0])
        if n % 10 == 7:
            raise RuntimeError("no answer")
        return {"related": n % 2 == 0, "reason": "r" * (n % 10 * 50 + 1), "better_match": {1: "lr", 2: "made up"}.get(n % 10)}

    return e, review.review(e, claims, runs, answer, "stub", limit)


_REVIEWED = f"WITH {EDGES}, q AS (SELECT *, CAST(substr(src, 7) AS BIGINT) AS n FROM edges WHERE type = 'backed_by' AND status = 'pending')"


@query(f"{_REVIEWED} SELECT src, dst, CASE WHEN n % 10 NOT IN (0, 7) THEN n % 2 = 0 END AS related, CASE WHEN n % 10 IN (0, 7) THEN NULL WHEN n % 10 * 50 + 1 > 300 THEN 304 ELSE n % 10 * 50 + 1 END AS reason_length, CASE WHEN n % 10 = 1 THEN 'lr' END AS better_match, CASE WHEN n % 10 NOT IN (0, 7) THEN n % 10 = 2 END AS made_up, 'acc' AS metric, CASE n % 10 WHEN 0 THEN 'an end of the edge is no node' WHEN 7 THEN 'no answer' END AS error FROM q")
def reviews(spark, sf_dir):
    return _reviews(spark, sf_dir)[1].select("src", "dst", "related", F.length("reason").alias("reason_length"), "better_match", "made_up", "metric", "error")


@query(f"{_REVIEWED}, f AS (SELECT * FROM q ORDER BY src, dst LIMIT 100) SELECT count(*) AS reviewed, CAST(sum(CASE WHEN n % 10 NOT IN (0, 7) THEN 1 ELSE 0 END) AS BIGINT) AS written, CAST(sum(CASE WHEN n % 10 IN (0, 7) THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM f")
def review_totals(spark, sf_dir):
    return review.totals(_reviews(spark, sf_dir, 100)[1])


@query(f"WITH {EDGES}, b AS (SELECT *, CAST(substr(src, 7) AS BIGINT) AS n FROM edges WHERE type = 'backed_by') SELECT src, dst, status, status = 'pending' AND n % 10 NOT IN (0, 7) AS has_review FROM b")
def review_annotations(spark, sf_dir):
    e, found = _reviews(spark, sf_dir)
    return review.annotate(e, found).select("src", "dst", "status", F.col("review").isNotNull().alias("has_review"))


@query("SELECT c_custkey, 'f1,loss' AS skipped, 'acc,f1,lr' AS names FROM customer")
def review_names(spark, sf_dir):
    o = F.array(*(F.lit(f'{{"metric":"{m}"}}') for m in ("loss", "acc", "f1", "acc")))
    names = review.names(F.create_map(F.lit("lr"), F.lit("1"), F.lit("acc"), F.lit("2")), F.create_map(F.lit("f1"), F.lit(0.5), F.lit("acc"), F.lit(0.1)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(review.skipped_metrics(o), ",").alias("skipped"), F.array_join(names, ",").alias("names"))
