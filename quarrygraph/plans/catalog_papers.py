"""Queries of the readers: papers, bibliographies, scripts, histories, trackers and tables of attempts, made of the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import lineage
from ..sources import attempts, bibliography, dataflow, files, history, papers, r_scripts, scripts, trackers
from .catalog import ORACLES, QUERIES, query
from .standin import table

_LINE = r"""CASE p_partkey % 8 WHEN 0 THEN '\section{' || p_type || '}' WHEN 1 THEN 'see \cite{' || p_brand || ', ' || upper(p_type) || '} and \citep[p. 3]{x' || p_size || '} % \cite{no}'
  WHEN 2 THEN 'About ' || p_size || '.25 and ' || p_size || '.5\% of it. Then 0.' || p_size || ' holds. A ' || p_size || '.5-fold gain'
  WHEN 3 THEN '\includegraphics[width=0.5\textwidth]{figs/f' || p_partkey % 50 || '}' WHEN 4 THEN '$$ 0.' || p_size || ' $$ \label{l' || p_size || '} \ref{r1.' || p_size || '}'
  WHEN 5 THEN '\begin{tabular}{lc}' WHEN 6 THEN '\end{tabular}' ELSE 'text % \section{no} 0.7' END"""
#: Papers: one for each brand, a line for each part; what stands between the begin and the end of a tabular claims nothing.
LINES = f"lines AS (SELECT p_brand AS path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS line_no, {_LINE} AS line, p_partkey AS k, p_size AS s, p_type AS t FROM part)"
_SECTIONS = r"""b AS (SELECT path, line_no, t AS title, regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM lines WHERE k % 8 = 0),
sec AS (SELECT path, line_no, title, base, row_number() OVER (PARTITION BY path, base ORDER BY line_no) AS n FROM b),
heads AS (SELECT path, line_no, title, 'section:' || path || '#' || CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS id FROM sec)"""
_PLACED = "placed AS (SELECT l.*, last_value(h.id IGNORE NULLS) OVER (PARTITION BY l.path ORDER BY l.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM lines l LEFT JOIN heads h ON h.path = l.path AND h.line_no = l.line_no)"


def lines(spark, sf_dir):
    # The texts of the SQL are made by the same expression, with Spark's escapes.
    spark_line = _LINE.replace("\\", "\\\\")
    return table(spark, sf_dir, "part").selectExpr("p_brand AS path", "CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS line_no", f"{spark_line} AS line")


def placed(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return papers.with_section(rows, papers.sections(rows, "tex"))


@query(f"WITH {LINES}, {_SECTIONS} SELECT path, line_no, title, 'section' AS level, id FROM heads")
def tex_sections(spark, sf_dir):
    return papers.sections(lines(spark, sf_dir), "tex")


@query(f"WITH {LINES}, {_SECTIONS}, {_PLACED} SELECT path, line_no, section FROM placed")
def tex_placed(spark, sf_dir):
    return placed(spark, sf_dir).select("path", "line_no", "section")


@query(f"""WITH {LINES}, c AS (SELECT path, line_no, unnest([lower(path), lower(t), 'x' || s]) AS target FROM lines WHERE k % 8 = 1) SELECT path, line_no, 'cites' AS link, target FROM c""")
def tex_citations(spark, sf_dir):
    return papers.links(lines(spark, sf_dir), "tex").filter("link = 'cites'")


@query(f"""WITH {LINES}, {_SECTIONS}, {_PLACED}, f AS (SELECT path, line_no, 'figs/f' || k % 50 AS f, k % 50 AS n FROM placed WHERE k % 8 = 3 AND section IS NOT NULL)
SELECT path, line_no, f || CASE WHEN n % 3 = 0 THEN '.png' WHEN n % 3 = 1 THEN '.eps' END AS file FROM f WHERE n % 3 < 2""")
def tex_figures(spark, sf_dir):
    at = placed(spark, sf_dir).select("path", "line_no", "section")
    links = papers.links(lines(spark, sf_dir), "tex").filter("link = 'includes'").join(at, ["path", "line_no"])
    n = F.col("id") % 3
    names = spark.range(50).select(F.explode(F.when(n == 0, F.array(F.lit(".svg"), F.lit(".png"))).when(n == 1, F.array(F.lit(".svg"), F.lit(".eps"))).otherwise(F.array(F.lit(".txt")))).alias("x"), "id")
    return dataflow.figures(links, names.select(F.concat(F.lit("figs/f"), "id", "x").alias("path"))).select("path", "line_no", "file")


@query(f"""WITH {LINES}, {_SECTIONS}, {_PLACED}, m AS (SELECT section, line_no, k % 8 = 4 AS has, 'l' || s AS label, 'r1.' || s AS ref FROM placed WHERE section IS NOT NULL)
SELECT section, string_agg(label || '@' || line_no, ',' ORDER BY line_no) AS labels, string_agg(ref || '@' || line_no, ',' ORDER BY line_no) AS refs FROM m WHERE has GROUP BY section""")
def tex_labels(spark, sf_dir):
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("@", x["name"], x["line"].cast("string"))), ",").alias(c)
    return papers.names(placed(spark, sf_dir)).select("section", joined("labels"), joined("refs"))


_DEPTH = """st AS (SELECT *, sum(CASE k % 8 WHEN 5 THEN 1 WHEN 6 THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS sm FROM placed),
dp AS (SELECT *, sm - least(0, min(sm) OVER (PARTITION BY path ORDER BY line_no)) AS depth FROM st)"""
_CLAIMS = rf"""WITH {LINES}, {_SECTIONS}, {_PLACED}, {_DEPTH}, src AS (SELECT *, 'About ' || s || '.25 and ' || s || '.5\% of it.' AS one, 'Then 0.' || s || ' holds.' AS two FROM dp WHERE k % 8 = 2 AND depth = 0),
c AS (SELECT path, line_no, section, 1 AS seq, s || '.25' AS raw, 'plain' AS unit_form, s + 0.25::DOUBLE AS value, 2 AS places, one AS sentence FROM src
  UNION ALL SELECT path, line_no, section, 2, s || '.5\%', CASE WHEN true THEN 'percent' END, (s + 0.5::DOUBLE) / 100, 3, one FROM src
  UNION ALL SELECT path, line_no, section, 1, '0.' || s, 'fraction', CAST('0.' || s AS DOUBLE), length(CAST(s AS VARCHAR)), two FROM src)"""


@query(rf"{_CLAIMS} SELECT path, line_no, seq, raw, unit_form, round(value, 6) AS value, CAST(places AS INTEGER) AS places, sentence, 'claim:' || path || '#' || substr(sha256(coalesce(section, '') || chr(31) || lower(sentence) || chr(31) || raw || chr(31) || seq), 1, 16) AS id FROM c")
def tex_claims(spark, sf_dir):
    rows = placed(spark, sf_dir)
    found = papers.claims(papers.prose(rows.withColumn("line", papers.without_comment(F.col("line"))), "tex"))
    return found.select("path", "line_no", "seq", "raw", "unit_form", F.round(F.col("value").cast("double"), 6).alias("value"), "places", "sentence", "id")


@query(r"""WITH e AS (SELECT c_custkey, c_name, c_mktsegment, c_custkey % 40 AS f FROM customer), k AS (SELECT 'b' || f || '.bib' AS path, CAST(row_number() OVER (PARTITION BY f ORDER BY c_custkey) - 1 AS BIGINT) AS seq, 'Key' || c_custkey AS key, 'article' AS entry_type, c_name AS title, c_mktsegment AS author, '19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS year FROM e) SELECT * FROM k""")
def bib_entries(spark, sf_dir):
    entry = F.format_string('@Article{Key%d,\n  Title = {%s}, author="%s", year = 19%02d, title = {other}}\n@comment{ignored {x}}\n', "c_custkey", "c_name", "c_mktsegment", (F.col("c_custkey") % 100).cast("int"))
    texts = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("b"), F.col("c_custkey") % 40, F.lit(".bib")).alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", entry.alias("e")))), lambda x: x["e"]), "").alias("text"))
    return bibliography.read(texts)


_CALLS = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS line_no FROM events)"""


def _texts(spark, sf_dir, suffix, line):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("n", F.row_number().over(w))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))).alias("x"))
    return rows.select(F.concat(F.lit("s"), "user_id", F.lit(suffix)).alias("path"), F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("text"))


@query(f"""WITH {_CALLS} SELECT 's' || user_id || '.py' AS path, line_no, CASE event_type WHEN 'purchase' THEN 'to_csv' WHEN 'view' THEN 'read_csv' ELSE 'open' END AS callee, CASE event_type WHEN 'purchase' THEN 'writes' ELSE 'reads' END AS kind,
  CASE event_type WHEN 'purchase' THEN 'out/' || k || '.csv' WHEN 'view' THEN 'data/' || k || '.csv' ELSE 'raw/a-' || k || '.json' END AS target FROM ev WHERE event_type IN ('purchase', 'view', 'click')""")
def python_uses(spark, sf_dir):
    kind, k = F.col("event_type"), F.col("k")
    line = F.when(kind == "purchase", F.format_string("df.to_csv('out/%d.csv', index=False)", k)).when(kind == "view", F.format_string("x = pd.read_csv(filepath_or_buffer=1, *[], path='data/%d.csv')", k))
    line = F.when(kind == "view", F.format_string("x = pd.read_csv('data/%d.csv')", k)).when(kind == "click", F.format_string("open('raw/' + 'a-%d.json')", k)).when(kind == "signup", "y = unknown(x)").when(kind == "error", "open(name)").otherwise(line)
    return scripts.uses(_texts(spark, sf_dir, ".py", line)).select("path", "line_no", "callee", "kind", "target")


@query(f"""WITH {_CALLS} SELECT 's' || user_id || '.R' AS path, line_no, CASE event_type WHEN 'purchase' THEN 'writes' ELSE 'reads' END AS kind, CASE event_type WHEN 'purchase' THEN 'out/' || k || '.csv' ELSE 'data/' || k || '.csv' END AS target FROM ev WHERE event_type IN ('purchase', 'view')""")
def r_uses(spark, sf_dir):
    kind, k = F.col("event_type"), F.col("k")
    line = F.when(kind == "purchase", F.format_string('write.csv(df, file = "out/%d.csv")', k)).when(kind == "view", F.format_string('x <- read.csv(paste0("data/", "%d.csv"))', k)).when(kind == "click", "# read.csv('no.csv')").otherwise("z <- 1")
    return r_scripts.uses(_texts(spark, sf_dir, ".R", line)).select("path", "line_no", "kind", "target")


@query("""WITH c AS (SELECT user_id, event_id, 'd/' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 || '.csv' AS target FROM events),
f AS (SELECT 'd/' || x || '.csv' AS path FROM range(0, 12) t(x) UNION ALL SELECT 's' || user_id || '/d/' || x || '.csv' FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0) u, range(8, 16) t(x))
SELECT DISTINCT 's' || user_id || '/run.py' AS path, target, CASE WHEN target IN (SELECT path FROM f) THEN target WHEN 's' || user_id || '/' || target IN (SELECT path FROM f) THEN 's' || user_id || '/' || target ELSE target END AS file,
  NOT (target IN (SELECT path FROM f) OR 's' || user_id || '/' || target IN (SELECT path FROM f)) AS missing FROM c""")
def resolved_targets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    target = F.concat(F.lit("d/"), F.get_json_object("props", "$.k").cast("int") % 20, F.lit(".csv"))
    calls = e.select(F.concat(F.lit("s"), "user_id", F.lit("/run.py")).alias("path"), target.alias("target")).distinct()
    top = spark.range(12).select(F.concat(F.lit("d/"), "id", F.lit(".csv")).alias("path"))
    near = e.filter("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(8), F.lit(15))).alias("x")).select(F.concat(F.lit("s"), "user_id", F.lit("/d/"), "x", F.lit(".csv")).alias("path"))
    return dataflow.resolve(calls, top.union(near)).select("path", "target", "file", "missing")


def _log(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    record = F.concat(F.lit("\x1e"), F.sha1(F.col("o_orderkey").cast("string")), F.lit("\x1f"), F.concat(F.lit("Name "), F.col("o_custkey") % 7), F.lit("\x1f"), F.when(F.col("o_custkey") % 5 == 0, "").otherwise(F.concat(F.lit(" U"), F.col("o_custkey") % 7, F.lit("@X.org "))), F.lit("\x1f"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00+05:00\x1f"), F.col("o_orderpriority"), F.lit("\n\nbody\n\x1f\x00\n"), F.concat(F.lit("f/"), F.col("o_orderkey") % 90, F.lit(".py\x00g h "), F.col("o_orderkey") % 13, F.lit("\x00")))
    return history.commits(o.groupBy((F.col("o_custkey") % 4).cast("string").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", record.alias("r")))), lambda x: x["r"]), "").alias("text")))


@query(r"""SELECT CAST(o_custkey % 4 AS VARCHAR) AS path, sha1(CAST(o_orderkey AS VARCHAR)) AS sha, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE ' U' || o_custkey % 7 || '@X.org ' END AS author_email, strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00+05:00' AS authored_at, o_orderpriority || chr(10) || chr(10) || 'body' AS message, 'f/' || o_orderkey % 90 || '.py,g h ' || o_orderkey % 13 AS files FROM orders""")
def git_commits(spark, sf_dir):
    return _log(spark, sf_dir).select("path", "sha", "author_email", "authored_at", "message", F.array_join("files", ",").alias("files"))


@query(r"""WITH t AS (SELECT CAST(o_custkey % 4 AS VARCHAR) AS repo, o_orderkey, unnest(['f/' || o_orderkey % 90 || '.py', 'g h ' || o_orderkey % 13]) AS file FROM orders WHERE o_custkey % 4 = 1)
SELECT file, sha1(CAST(max(o_orderkey) AS VARCHAR)) AS sha FROM t GROUP BY file""")
def git_last_touch(spark, sf_dir):
    return history.last_touch(_log(spark, sf_dir).filter("path = '1'")).select("file", "sha")


@query(r"""WITH a AS (SELECT DISTINCT 'contributor:u' || o_custkey % 7 || '@x.org' AS dst, 'commit:' || sha1(CAST(o_orderkey AS VARCHAR)) AS src FROM orders WHERE o_custkey % 5 <> 0) SELECT src, dst, 'authored_by' AS type FROM a""")
def git_authors(spark, sf_dir):
    return history.commit_graph(_log(spark, sf_dir))[1].select("src", "dst", "type")


@query("SELECT 'f' || l_orderkey % 50 AS file, CAST(l_partkey AS INTEGER) AS line_no, sha1(CAST(l_orderkey AS VARCHAR)) AS sha FROM lineitem WHERE l_suppkey % 9 <> 0")
def git_blame(spark, sf_dir):
    sha = F.when(F.col("l_suppkey") % 9 == 0, "0" * 40).otherwise(F.sha1(F.col("l_orderkey").cast("string")))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_orderkey") % 50).alias("file"), F.concat(sha, F.lit(" 1 "), "l_partkey", F.lit(" 1\nauthor x\n\tcode of it")).alias("r"))
    return history.blame(rows.groupBy("file").agg(F.array_join(F.collect_list("r"), "\n").alias("text")))


@query("""SELECT 'r' || user_id AS run_id, event_type AS name, arg_max(event_id, event_id) + 0.5::DOUBLE AS value FROM events WHERE user_id % 3 <> 0 GROUP BY user_id, event_type""")
def tracker_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    metric = e.groupBy("user_id", "event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: F.concat_ws(" ", F.lit("17"), (x + 0.5).cast("string"), F.lit("3"))), "\n").alias("text"))
    base = F.concat(F.lit("0/r"), "user_id")
    found = metric.select(F.concat(base, F.lit("/metrics/"), "event_type").alias("path"), F.concat("text", F.lit("\n\n")).alias("text")).unionByName(e.filter("user_id % 3 <> 0").select(F.concat(base, F.lit("/meta.yaml")).alias("path"), F.lit("run_name: 'x'\nstatus: FINISHED\n").alias("text")).distinct())
    return trackers.facts(trackers.run_files(found)).filter("kind = 'metrics'").select("run_id", "name", F.col("value").try_cast("double").alias("value"))


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'commit:s' || c_custkey % 20 END AS sha FROM customer) SELECT sha AS src, 'experiment:r' || c_custkey AS dst FROM r WHERE sha IS NOT NULL AND CAST(substr(sha, 9) AS INTEGER) < 10""")
def tracker_commits(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    run = F.concat(F.lit("r"), "c_custkey")
    meta = c.select(run.alias("run_id"), F.lit("meta").alias("kind"), F.lit("run_name").alias("name"), F.col("c_name").alias("value"))
    tags = c.filter("c_custkey % 3 = 0").select(run.alias("run_id"), F.lit("tags").alias("kind"), F.lit("mlflow.source.git.commit").alias("name"), F.concat(F.lit("s"), F.col("c_custkey") % 20).alias("value"))
    none = c.select(run.alias("run_id"), F.lit("x.png").alias("artifact")).limit(0)
    commits = spark.range(10).select(F.concat(F.lit("commit:s"), "id").alias("id"))
    return trackers.run_graph(meta.union(tags), none, commits.limit(0), commits)[1].select("src", "dst")


@query("""SELECT event_id, 'props' AS source, 'k' AS name, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events UNION ALL SELECT event_id, 'summary', 'n', CAST(user_id AS DOUBLE) FROM events UNION ALL SELECT event_id, 'summary', 'v', value FROM events WHERE value IS NOT NULL""")
def tracker_numbers(spark, sf_dir):
    summary = F.to_json(F.struct(F.col("user_id").alias("n"), F.col("value").alias("v"), F.col("event_type").alias("text"), F.lit(True).alias("flag"), F.lit("0.9").alias("quoted")))
    return trackers.numbers(table(spark, sf_dir, "events"), ["event_id"], {"props": F.col("props"), "summary": summary})


@query(r"""SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN CAST(p_size AS VARCHAR) WHEN p_size % 4 = 2 THEN p_size || ',' || p_size + 1 || ',' || p_size + 2 ELSE '5' END AS steps FROM part""")
def step_references(spark, sf_dir):
    n = F.col("p_size")
    said = F.when(n % 4 == 0, F.lit("(1234) none (9-3) (1-99)")).when(n % 4 == 1, F.format_string("(%d) and (%d)", n, n)).when(n % 4 == 2, F.format_string("steps (%d-%d)", n, n + 2)).otherwise("only (5)")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(attempts.steps(said), ",").alias("steps"))


@query(r"""SELECT p_partkey AS id, p_type || chr(10) || p_brand || ' ' || p_name || '|x' AS cell FROM part""")
def table_cells(spark, sf_dir):
    row = F.concat(F.lit("| **"), "p_type", F.lit("**<br>["), "p_brand", F.lit("](http://x) `"), "p_name", F.lit("`\\|x | second |"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), attempts.clean_cell(F.get(attempts.cells(row), F.lit(0))).alias("cell"))


@query(r"""WITH n AS (SELECT p_size AS number, min(p_partkey) AS k FROM part WHERE p_brand = 'Brand#11' GROUP BY p_size) SELECT CAST(number AS VARCHAR) AS number, 'attempt:map.md#' || number AS id, p_type AS description FROM n JOIN part ON p_partkey = k""")
def attempt_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part").filter("p_brand = 'Brand#11'").select((F.row_number().over(Window.orderBy("p_partkey")) + 4).alias("line_no"), F.format_string("| %d | %s | v |", "p_size", "p_type").alias("line"))
    head = spark.createDataFrame([(1, "# Map"), (2, "## Attempts of it"), (3, "| Nr | What | Verdict |"), (4, "|---|:-:|---|")], "line_no int, line string")
    rows = attempts.table(head.union(part).select(F.lit("map.md").alias("path"), "line_no", "line"), "Attempts", {"number": "Nr", "description": "What"})
    return attempts.first_of_number(rows).select("number", "id", "description")


@query(r"""WITH t AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS l FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM t) SELECT CAST(doc_id AS VARCHAR) AS path, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(l) AS x FROM u) GROUP BY 1""")
def text_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return files.lines(docs).groupBy("path").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query("""WITH t AS (SELECT CASE page_id % 4 WHEN 0 THEN 'a/.git/x' WHEN 1 THEN 'node_modules/y.py' WHEN 2 THEN 'src/_cache/z' ELSE 'src/ok.py' END AS path, page_id FROM pages) SELECT page_id, path FROM t WHERE path = 'src/ok.py'""")
def visible_paths(spark, sf_dir):
    k = F.col("page_id") % 4
    path = F.when(k == 0, "a/.git/x").when(k == 1, "node_modules/y.py").when(k == 2, "src/_cache/z").otherwise("src/ok.py")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).filter(files.visible(F.col("path")))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'a/./b' WHEN 2 THEN 'a/../b' WHEN 3 THEN '../b' WHEN 4 THEN '/abs' WHEN 5 THEN 'a//b/' ELSE 'x' || l_orderkey END AS path FROM lineitem) SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'a/b' WHEN 2 THEN 'b' WHEN 5 THEN 'a/b' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE path END AS normal FROM p""")
def normal_paths(spark, sf_dir):
    n = F.col("l_linenumber")
    path = F.when(n == 1, "a/./b").when(n == 2, "a/../b").when(n == 3, "../b").when(n == 4, "/abs").when(n == 5, "a//b/").otherwise(F.concat(F.lit("x"), "l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.normal_path(path).alias("normal"))


@query("""WITH t AS (SELECT DISTINCT 'dataset:d' || l_partkey % 300 AS target FROM lineitem), n AS (SELECT 'dataset:d' || p_partkey AS id, p_name AS title FROM part WHERE p_partkey % 2 = 0) SELECT target, coalesce(title, substr(target, 9)) AS title, 'dataset' AS node_type FROM t LEFT JOIN n ON id = target""")
def named_targets(spark, sf_dir):
    targets = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("dataset:d"), F.col("l_partkey") % 300).alias("target")).distinct()
    nodes = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("dataset:d"), "p_partkey").alias("id"), F.lit("dataset").alias("type"), F.col("p_name").alias("title"))
    return lineage.named(targets, nodes)


__all__ = ["ORACLES", "QUERIES"]
