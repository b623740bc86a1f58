"""All queries of the provenance engine, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence, text
from ..operators import graph, joins, lineage, sequences, snapshots
from ..sources import bibliography, history, trackers
from .standin import EDGES, NODES, USES, edges, nodes, table, uses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TRACED = ", ".join(f"'{t}'" for t in graph.TRACE_TYPES)
_TRACE_SQL = f"""WITH RECURSIVE {EDGES}, e AS (SELECT * FROM edges WHERE type IN ({_TRACED})),
both_ways AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
reach(node, d) AS (SELECT '%s', 0 UNION SELECT b, d + 1 FROM reach JOIN both_ways ON a = node WHERE d < %d),
dist AS (SELECT node, min(d) AS d FROM reach GROUP BY node)
SELECT src, dst, type, extractor, status, depth FROM (
  SELECT e.*, least(coalesce(s.d, 99), coalesce(t.d, 99)) + 1 AS depth FROM e LEFT JOIN dist s ON s.node = src LEFT JOIN dist t ON t.node = dst) WHERE depth <= %d"""


@query(_TRACE_SQL % ("customer:7", 3, 3))
def trace_khop(spark, sf_dir):
    return graph.trace(nodes(spark, sf_dir), edges(spark, sf_dir), "customer:7", 3)


@query(_TRACE_SQL % ("region:0", 2, 2))
def trace_hub(spark, sf_dir):
    return graph.trace(nodes(spark, sf_dir), edges(spark, sf_dir), "region:0", 2)


@query(f"WITH {EDGES} SELECT 'out' AS direction, * FROM edges WHERE src = 'nation:3' UNION ALL SELECT 'in', * FROM edges WHERE dst = 'nation:3'")
def node_neighbors(spark, sf_dir):
    return graph.neighbors(edges(spark, sf_dir), "nation:3")


_values = lambda xs: ", ".join(f"('{x}')" for x in xs)


@query(f"WITH {NODES} SELECT t.type, count(id) AS n FROM (VALUES {_values(graph.NODE_TYPES)}) t(type) LEFT JOIN nodes ON nodes.type = t.type GROUP BY 1")
def status_nodes(spark, sf_dir):
    return graph.counts_by_type(nodes(spark, sf_dir), graph.NODE_TYPES)


@query(f"WITH {EDGES} SELECT t.type, count(src) AS n FROM (VALUES {_values(graph.EDGE_TYPES)}) t(type) LEFT JOIN edges ON edges.type = t.type GROUP BY 1")
def status_edges(spark, sf_dir):
    return graph.counts_by_type(edges(spark, sf_dir), graph.EDGE_TYPES)


@query(f"WITH {EDGES} SELECT status, count(*) AS n FROM edges GROUP BY 1")
def status_queue(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {NODES} SELECT * FROM nodes WHERE contains(lower(id), 'n:1') OR contains(lower(title), 'n:1')")
def find_nodes(spark, sf_dir):
    return graph.find(nodes(spark, sf_dir), "N:1")


@query(f"WITH {EDGES} SELECT * FROM edges WHERE status = 'pending' ORDER BY src, dst, type, extractor LIMIT 20")
def pending_queue_topn(spark, sf_dir):
    return graph.queue(edges(spark, sf_dir), n=20)


@query(f"WITH {NODES}, {EDGES}, few AS (SELECT * FROM nodes WHERE NOT (id LIKE 'supplier:%3')) SELECT * FROM edges WHERE src NOT IN (SELECT id FROM few) OR dst NOT IN (SELECT id FROM few)")
def dangling_edges(spark, sf_dir):
    return graph.dangling(nodes(spark, sf_dir).filter(~F.col("id").like("supplier:%3")), edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src, dst, type, extractor, status FROM edges WHERE NOT (type = 'uses' AND dst LIKE 'supplier:1%')")
def delete_touching(spark, sf_dir):
    doomed = nodes(spark, sf_dir).filter(F.col("id").like("supplier:1%")).select("id")
    by_hand = F.when(F.col("type") == "uses", F.col("extractor")).otherwise("hand")
    left = snapshots.delete_touching(edges(spark, sf_dir).withColumn("extractor", by_hand), doomed, "tables")
    return left.withColumn("extractor", F.lit("tables"))


_BY_TARGET = f"""WITH {USES}, t AS (SELECT target, max(is_data) AS is_data, count(*) FILTER (kind = 'reads') AS n_reads, count(*) FILTER (kind = 'writes') AS n_writes,
  coalesce(string_agg(DISTINCT script, ',' ORDER BY script) FILTER (kind = 'writes'), '') AS writers, coalesce(string_agg(DISTINCT script, ',' ORDER BY script) FILTER (kind = 'reads'), '') AS readers FROM uses GROUP BY target)"""


@query(f"WITH {USES} SELECT count(DISTINCT script) AS scripts, count(DISTINCT target) AS targets, count(*) FILTER (kind = 'reads') AS reads, count(*) FILTER (kind = 'writes') AS writes FROM uses")
def lineage_scanned(spark, sf_dir):
    return lineage.scanned(uses(spark, sf_dir))


@query(f"{_BY_TARGET} SELECT target, n_reads, n_writes, writers, readers FROM t WHERE n_reads > 0 AND n_writes > 0")
def lineage_chains(spark, sf_dir):
    return lineage.chains(uses(spark, sf_dir))


@query(f"{_BY_TARGET} SELECT target, n_reads, readers FROM t WHERE n_reads > 0 AND n_writes = 0 AND is_data")
def lineage_orphans(spark, sf_dir):
    return lineage.orphans(uses(spark, sf_dir))


@query(f"WITH {USES} SELECT DISTINCT script, target, kind FROM uses WHERE missing")
def lineage_broken(spark, sf_dir):
    return lineage.broken(uses(spark, sf_dir))


@query(r"""WITH f AS (SELECT DISTINCT url AS path, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages), g AS (SELECT base, count(*) AS n FROM f GROUP BY base HAVING count(*) > 1)
SELECT base, path, n, true AS is_read FROM f JOIN g USING (base)""")
def lineage_duplicates(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return lineage.duplicates(files, files)


_AT = "CASE c.places WHEN 1 THEN round({0}, 1)::DECIMAL(38,18) WHEN 2 THEN round({0}, 2)::DECIMAL(38,18) ELSE round({0}, 3)::DECIMAL(38,18) END"


@query(f"""WITH claims AS (SELECT DISTINCT CAST(CAST(p_retailprice AS VARCHAR) AS DECIMAL(18,4)) * 0.1::DECIMAL(2,1) AS v, p_size % 3 + 1 AS places FROM part),
c AS (SELECT CAST(CAST(v AS DECIMAL(20,3)) AS VARCHAR) || '/' || places AS claim_id, CAST(v AS DECIMAL(38,18)) AS value, places FROM claims),
m AS (SELECT event_id AS metric_id, CAST(CAST(value AS VARCHAR) AS DECIMAL(38,18)) AS m FROM events WHERE value IS NOT NULL),
k AS (SELECT c.claim_id, c.places, m.metric_id FROM c JOIN m ON {_AT.format('c.value')} = {_AT.format('m.m')})
SELECT claim_id, places, metric_id, count(*) OVER (PARTITION BY claim_id) AS candidate_count FROM k""")
def rounded_match(spark, sf_dir):
    value = text.exact_decimal(F.col("p_retailprice")).cast("decimal(38,18)")
    part = table(spark, sf_dir, "part").select((value / F.lit(10).cast("decimal(2,0)")).cast("decimal(38,18)").alias("value"), (F.col("p_size") % 3 + 1).alias("places")).distinct()
    claims = part.withColumn("claim_id", F.concat_ws("/", F.round("value", 3).cast("decimal(20,3)").cast("string"), F.col("places").cast("string")))
    metrics = table(spark, sf_dir, "events").select(F.col("event_id").alias("metric_id"), F.col("value").alias("metric"))
    return joins.rounded_equi_join(claims, metrics, range(1, 4)).select("claim_id", "places", "metric_id", "candidate_count")


@query(r"""WITH f AS (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS b FROM pages), u AS (SELECT b, min(page_id) AS page_id FROM f GROUP BY b HAVING count(*) = 1),
a AS (SELECT page_id + 1 AS run, b FROM f) SELECT a.run, a.b AS base, u.page_id AS figure FROM a JOIN u USING (b)""")
def unique_basename_join(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("base"))
    return joins.unique_key_join(pages.select((F.col("page_id") + 1).alias("run"), "base"), pages.select("base", F.col("page_id").alias("figure")), "base")


@query("""WITH k AS (SELECT p_partkey AS row, [p_brand || '-' || (p_size + 40), p_brand || '-' || p_size, p_brand || '-1'] AS c FROM part), t AS (SELECT DISTINCT p_brand || '-' || (p_size * 2) AS key FROM part)
SELECT row, CASE WHEN c[1] IN (SELECT key FROM t) THEN c[1] WHEN c[2] IN (SELECT key FROM t) THEN c[2] WHEN c[3] IN (SELECT key FROM t) THEN c[3] END AS target FROM k""")
def ranked_candidate_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = lambda n: F.concat_ws("-", "p_brand", n.cast("string"))
    size = F.col("p_size")
    left = part.select(F.col("p_partkey").alias("row"), key(size + 40).alias("a"), key(size).alias("b"), key(F.lit(1)).alias("c"))
    return joins.ranked_candidate_join(left, ["a", "b", "c"], part.select(key(size * 2).alias("key")), "key", "row").select("row", "target")


_CITES = "cites AS (SELECT o_orderkey AS row, '  ' || upper(o_orderpriority) || ' ' AS cite FROM orders), bib AS (SELECT DISTINCT lower(trim(o_orderpriority)) AS k FROM orders WHERE o_orderpriority NOT LIKE '%LOW%')"


def _cites(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cites = orders.select(F.col("o_orderkey").alias("row"), F.concat(F.lit("  "), F.upper("o_orderpriority"), F.lit(" ")).alias("cite"))
    bib = orders.filter(~F.col("o_orderpriority").like("%LOW%")).groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("seq")).select(F.col("o_orderpriority").alias("bibkey"), "seq")
    return cites, bib


@query(f"WITH {_CITES} SELECT row, lower(trim(cite)) AS key, bib.k IS NOT NULL AS resolved FROM cites LEFT JOIN bib ON bib.k = lower(trim(cite))")
def normal_key_join(spark, sf_dir):
    cites, bib = _cites(spark, sf_dir)
    return joins.normal_key_join(cites, bib, "cite", "bibkey", "seq").select("row", "key", F.col("bibkey").isNotNull().alias("resolved"))


@query(f"WITH {_CITES} SELECT DISTINCT 'ref:' || lower(trim(cite)) AS id FROM cites WHERE lower(trim(cite)) NOT IN (SELECT k FROM bib)")
def unresolved_placeholders(spark, sf_dir):
    cites, bib = _cites(spark, sf_dir)
    entries = bib.select("seq", F.col("bibkey").alias("key"), *(F.lit("x").alias(c) for c in ("path", "title", "entry_type", "author", "year")))
    return bibliography.references(entries, cites.select(F.col("cite").alias("target"))).filter("unresolved").select("id")


@query("WITH k AS (SELECT c_mktsegment AS k FROM customer UNION ALL SELECT lower(c_mktsegment) FROM customer WHERE c_mktsegment LIKE 'A%') SELECT lower(k) AS key, count(DISTINCT k) AS spellings FROM k GROUP BY 1 HAVING count(DISTINCT k) > 1")
def key_collisions(spark, sf_dir):
    seg = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("k"))
    keys = seg.union(seg.filter("k LIKE 'A%'").select(F.lower("k")))
    entries = keys.distinct().select(F.col("k").alias("key"), F.lit(0).alias("seq"), *(F.lit("x").alias(c) for c in ("path", "title", "entry_type", "author", "year")))
    found = bibliography.references(entries, entries.select(F.col("key").alias("target"))).filter("spellings > 1")
    return found.select(F.expr("substring(id, 5)").alias("key"), "spellings")


@query("""WITH k AS (SELECT DISTINCT p_brand AS g, p_partkey AS x FROM part WHERE p_partkey % 7 <> 0), m AS (SELECT DISTINCT p_brand AS g, p_partkey AS missing FROM part WHERE p_partkey % 7 = 0)
SELECT g, missing, (SELECT max(x) FROM k WHERE k.g = m.g AND x < missing) AS lower, (SELECT min(x) FROM k WHERE k.g = m.g AND x > missing) AS higher FROM m""")
def nearest_steps(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("at"))
    return joins.nearest(part.filter("at % 7 = 0").withColumnRenamed("at", "missing"), part.filter("at % 7 <> 0"), ["g"], "missing", "at")


_TERMS = ["worthless", "MIT License", "token", "the of"]


@query(f"SELECT doc_id AS row, 'text' AS field, term FROM documents, (VALUES {_values(_TERMS)}) t(term) WHERE contains(lower(text), lower(term)) UNION ALL SELECT doc_id, 'source', term FROM documents, (VALUES {_values(_TERMS)}) t(term) WHERE contains(lower(source), lower(term))")
def revived_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row")
    return joins.containing(docs, ["text", "source"], _TERMS, "row")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_touch(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.array("user_id").alias("files"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("sha"), F.col("event_id").alias("authored_at"))
    return history.last_touch(log).select(F.col("file").alias("user_id"), F.col("authored_at").alias("event_id"), F.col("sha").alias("event_type"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations")
def section_ffill(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return sequences.carry_forward(turns, ["conv_id"], ["turn", "role", "text"], F.when(F.col("role") == "user", F.col("turn")), "section").select("conv_id", "turn", "section")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS seq FROM lineitem")
def seq_in_group(spark, sf_dir):
    return sequences.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_linenumber"], "seq").select("l_orderkey", "l_linenumber", "seq")


@query(r"""WITH s AS (SELECT p_brand AS file, p_partkey AS pos, CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN p_type || '!' ELSE p_type END AS title FROM part),
b AS (SELECT *, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM s),
c AS (SELECT b.*, (SELECT count(DISTINCT x.title) FROM b x WHERE x.file = b.file AND x.base = b.base) AS titles FROM b),
d AS (SELECT *, CASE WHEN titles > 1 THEN base || '-' || substr(sha256(title), 1, 8) ELSE base END AS sl FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY file, sl ORDER BY pos) AS n FROM d)
SELECT file, pos, CASE WHEN n > 1 THEN sl || '-' || n ELSE sl END AS slug FROM e""")
def slug_numbering(spark, sf_dir):
    pos, kind = F.col("p_partkey"), F.col("p_type")
    title = F.when(pos % 3 == 0, F.upper(kind)).when(pos % 3 == 1, F.concat(kind, F.lit("!"))).otherwise(kind)
    return sequences.section_slugs(table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), pos.alias("pos"), title.alias("title")), "file", "title", "pos").select("file", "pos", "slug")


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END AS step FROM events), r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY event_id) AS sm FROM s)
SELECT user_id, event_id, CAST(sm - least(0, min(sm) OVER (PARTITION BY user_id ORDER BY event_id)) AS BIGINT) AS depth FROM r""")
def clamped_depth(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("view", "click"), 1).otherwise(-1).alias("step"))
    return sequences.clamped_depth(steps, ["user_id"], ["event_id"], "step").select("user_id", "event_id", "depth")


@query("""WITH s AS (SELECT user_id, event_id, event_type = 'view' AS i FROM events), l AS (SELECT *, i AND NOT coalesce(lag(i) OVER (PARTITION BY user_id ORDER BY event_id), false) AS b FROM s),
n AS (SELECT *, sum(CAST(b AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM l) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM n WHERE i GROUP BY 1, 2""")
def table_islands(spark, sf_dir):
    rows = sequences.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "view")
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("""WITH h AS (SELECT o_custkey AS id, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS id, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(h.id, n.id) AS id, CASE WHEN n.id IS NULL THEN (SELECT o_orderstatus FROM orders WHERE o_orderkey = h.k) ELSE (SELECT o_orderstatus FROM orders WHERE o_orderkey = n.k) END AS attrs,
  CASE WHEN h.id IS NOT NULL THEN 'human' END AS human FROM h FULL JOIN n ON h.id = n.id""")
def upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("attrs"), F.col("o_orderkey").alias("seq"))
    held = snapshots.latest(o.filter("seq % 2 = 0"), ["id"], "seq").select("id", "attrs", F.lit("human").alias("human"))
    return snapshots.upsert(held, o.filter("seq % 2 = 1"), ["id"], "seq", kept=("human",))


@query("""WITH h AS (SELECT DISTINCT 'order:' || l_orderkey AS src, 'supplier:' || l_suppkey AS dst, CASE l_suppkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'auto' END AS status FROM lineitem WHERE l_returnflag <> 'A'),
n AS (SELECT DISTINCT 'order:' || l_orderkey AS src, 'supplier:' || l_suppkey AS dst FROM lineitem WHERE l_returnflag <> 'N')
SELECT coalesce(h.src, n.src) AS src, coalesce(h.dst, n.dst) AS dst, CASE WHEN h.status IN ('confirmed', 'rejected') OR n.src IS NULL THEN h.status ELSE 'pending' END AS status FROM h FULL JOIN n ON h.src = n.src AND h.dst = n.dst""")
def sticky_status(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order:"), "l_orderkey").alias("src"), F.concat(F.lit("supplier:"), "l_suppkey").alias("dst"), "l_suppkey", "l_returnflag", "l_linenumber")
    item = item.withColumns({"type": F.lit("uses"), "extractor": F.lit("t"), "confidence": F.lit(1.0), "occurrences": F.array(F.lit("seen")), "seq": F.col("l_linenumber")})
    status = F.when(F.col("l_suppkey") % 3 == 0, "confirmed").when(F.col("l_suppkey") % 3 == 1, "rejected").otherwise("auto")
    held = item.filter("l_returnflag <> 'A'").withColumn("status", status).select(*graph.EDGE_KEY, "confidence", "status", "occurrences").dropDuplicates(graph.EDGE_KEY)
    return snapshots.upsert_edges(held, item.filter("l_returnflag <> 'N'").withColumn("status", F.lit("pending"))).select("src", "dst", "status")


@query("""SELECT o_orderkey AS id, o_custkey AS file FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderstatus <> 'P'""")
def orphan_cleanup(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file"), "o_orderstatus")
    scanned = stored.filter("file % 2 = 0").select("file").distinct()
    return snapshots.orphans(stored, "file", scanned, stored.filter("id % 3 = 0"), stored.filter("o_orderstatus = 'P'"), "id").select("id", "file")


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS occurrences, count(*) AS n FROM f GROUP BY 1""")
def evidence_fold(spark, sf_dir):
    new = table(spark, sf_dir, "events").groupBy("user_id").agg(evidence.in_order(F.col("event_id"), F.col("event_type")).alias("new"))
    folded = new.select("user_id", evidence.fold(F.array().cast("array<string>"), F.col("new")).alias("o"))
    return folded.select("user_id", F.array_join("o", ",").alias("occurrences"), F.size("o").cast("long").alias("n"))


@query("""WITH l AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'x' || p_size WHEN 1 THEN p_size || 'a' ELSE CAST(p_size AS VARCHAR) END AS label FROM part)
SELECT label, row_number() OVER (ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(label, '^(\\d+)', 1), '') AS DOUBLE), 'inf'::DOUBLE), regexp_replace(label, '^\\d+', '')) AS place FROM l""".replace("\\\\", "\\"))
def natural_order(spark, sf_dir):
    n = F.col("p_size")
    label = F.when(n % 4 == 0, F.concat(F.lit("x"), n)).when(n % 4 == 1, F.concat(n, F.lit("a"))).otherwise(n.cast("string"))
    labels = table(spark, sf_dir, "part").select(label.alias("label")).distinct()
    # The labels of one table of attempts: a single sort of a list that people keep by hand.
    from pyspark.sql.window import Window

    return labels.select("label", F.row_number().over(Window.orderBy(*text.natural_key(F.col("label")))).alias("place"))


@query(r"""WITH p AS (SELECT CASE page_id % 5 WHEN 0 THEN 'a/b.TEX' WHEN 1 THEN 'data/x.csv' WHEN 2 THEN 'fig.v2.PNG' WHEN 3 THEN 'notes.md' ELSE url END AS path FROM pages),
e AS (SELECT path, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.]\.([^.]+)$', 1)) AS x FROM p)
SELECT coalesce(CASE WHEN x = 'tex' THEN 'tex' WHEN x IN ('png','jpg','jpeg','pdf','svg','eps','gif','tiff','tif') THEN 'image' WHEN x = 'md' THEN 'md' WHEN x IN ('csv','xlsx','parquet','rds','dta','json') THEN 'data' END, 'none') AS category, count(*) AS n FROM e GROUP BY 1""")
def inventory_by_suffix(spark, sf_dir):
    k = F.col("page_id") % 5
    path = F.when(k == 0, "a/b.TEX").when(k == 1, "data/x.csv").when(k == 2, "fig.v2.PNG").when(k == 3, "notes.md").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select(F.coalesce(text.category(path), F.lit("none")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, 'claim:' || source || '#' || substr(sha256(source || chr(31) || lower(trim(regexp_replace(text, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) || chr(31) || CAST(n_chars AS VARCHAR)), 1, 16) AS id FROM documents WHERE text IS NOT NULL""")
def content_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    cid = text.content_id(F.col("source"), text.normal_sentence(F.col("text")), F.col("n_chars").cast("string"))
    return docs.select("doc_id", F.concat(F.lit("claim:"), "source", F.lit("#"), cid).alias("id"))


@query("""SELECT event_id, 'k' AS name, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') UNION ALL SELECT event_id, 'value', value FROM events WHERE value IS NOT NULL""")
def json_metric_flatten(spark, sf_dir):
    blobs = {"props": F.col("props"), "value": F.to_json(F.struct("value"))}
    return trackers.numbers(table(spark, sf_dir, "events"), ["event_id"], blobs).drop("source")


@query(r"""WITH d AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%m-%d') AS md, strftime(o_orderdate, '%d') AS dd, CAST(o_orderdate AS DATE) AS ymd FROM orders),
f AS (SELECT *, CASE k % 7 WHEN 0 THEN CAST(ymd AS VARCHAR) WHEN 1 THEN md WHEN 2 THEN '<=' || md WHEN 3 THEN md || '~28' WHEN 4 THEN md || '~12-31' WHEN 5 THEN md || ' evening' ELSE 'later' END AS form FROM d)
SELECT k, form, CAST(CASE k % 7 WHEN 0 THEN ymd WHEN 6 THEN NULL WHEN 3 THEN CASE WHEN try_cast('2023-' || md AS DATE) IS NOT NULL THEN greatest(CAST('2023-' || md AS DATE), CAST('2023-' || md[:3] || '28' AS DATE)) END
  WHEN 4 THEN CASE WHEN try_cast('2023-' || md AS DATE) IS NOT NULL THEN DATE '2023-12-31' END ELSE try_cast('2023-' || md AS DATE) END AS VARCHAR) AS date FROM f""")
def date_forms(spark, sf_dir):
    k, md = F.col("o_orderkey") % 7, F.date_format("o_orderdate", "MM-dd")
    tail = {1: "", 3: "~28", 4: "~12-31", 5: " evening"}
    form = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.concat(F.lit("<="), md)).when(k == 6, "later")
    for n, t in tail.items():
        form = form.when(k == n, F.concat(md, F.lit(t)))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), form.alias("form"))
    return rows.select("k", "form", text.attempt_date(F.col("form"), 2023).cast("string").alias("date"))


from . import catalog_checks, catalog_papers  # noqa: E402, F401 - they add their queries here
