"""Registered queries over the supplied tables, each with the SQL that says the same.

The tables hold no source code, so every operator runs on a relational shape like its own: parts and suppliers as
functions and files, order lines as calls, documents as added code, events as findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import spec
from ..functions import lines
from ..operators import authorship as au
from ..operators import cost, detect, diffs, evaluate, graph, rank, snapshots, stats, traverse, windows
from . import code_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


CALLS = "SELECT DISTINCT concat('p', l_partkey) AS src, concat('s', l_suppkey) AS dst FROM lineitem"
HOLDS = "SELECT concat('s', p_partkey % 50) AS src, concat('p', p_partkey) AS dst FROM part"
NODES = "SELECT concat('p', p_partkey) AS id, 'function' AS type, p_name AS name FROM part UNION ALL SELECT DISTINCT concat('s', p_partkey % 50), 'file', NULL FROM part"
EDGES = f"SELECT src, dst, 'calls' AS type FROM ({CALLS}) UNION ALL SELECT src, dst, 'contains' FROM ({HOLDS})"


def call_edges(s: SparkSession, sf: str) -> DataFrame:
    li = t(s, sf, "lineitem")
    return li.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct().withColumn("type", F.lit("calls"))


def edges(s: SparkSession, sf: str) -> DataFrame:
    holds = t(s, sf, "part").select(F.concat(F.lit("s"), F.col("p_partkey") % 50).alias("src"), F.concat(F.lit("p"), "p_partkey").alias("dst"), F.lit("contains").alias("type"))
    return call_edges(s, sf).unionByName(holds)


def nodes(s: SparkSession, sf: str) -> DataFrame:
    p = t(s, sf, "part")
    fn = p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("function").alias("type"), F.col("p_name").alias("name"), F.concat(F.lit("s"), F.col("p_partkey") % 50).alias("file"))
    files = p.select(F.concat(F.lit("s"), F.col("p_partkey") % 50).alias("id")).distinct().select("id", F.lit("file").alias("type"), F.lit(None).cast("string").alias("name"), F.col("id").alias("file"))
    return fn.unionByName(files)


# ---- graph


@query(f"WITH RECURSIVE e AS ({EDGES}), r(node, depth) AS (SELECT src, 1 FROM e WHERE dst = 's7' UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 5) SELECT node, min(depth)::INT AS depth, min(depth) = 1 AS direct_caller FROM r GROUP BY node")
def q_blast_radius(s, sf):
    return traverse.blast_radius(edges(s, sf), "s7", 5).select("node", F.col("depth").cast("int").alias("depth"), "direct_caller")


@query(f"WITH RECURSIVE e AS ({EDGES}), r(node, depth) AS (SELECT src, 1 FROM e WHERE dst = 's7' UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 5), m AS (SELECT node, min(depth) AS d FROM r GROUP BY node) SELECT count(*) FILTER (WHERE d = 1) AS direct, count(*) FILTER (WHERE d > 1) AS indirect FROM m")
def q_blast_summary(s, sf):
    return traverse.blast_summary(traverse.blast_radius(edges(s, sf), "s7", 5)).select("direct", "indirect")


_TWO = f"""WITH e AS ({EDGES}), u1 AS (SELECT DISTINCT src AS node FROM e WHERE dst = 's7' AND src <> 's7'),
u2 AS (SELECT DISTINCT e.src AS node FROM e JOIN u1 ON e.dst = u1.node WHERE e.src <> 's7' AND e.src NOT IN (SELECT node FROM u1)),
up AS (SELECT 's7' AS node UNION SELECT node FROM u1 UNION SELECT node FROM u2),
d1 AS (SELECT DISTINCT dst AS node FROM e WHERE src = 's7' AND dst NOT IN (SELECT node FROM up)),
d2 AS (SELECT DISTINCT e.dst AS node FROM e JOIN d1 ON e.src = d1.node WHERE e.dst NOT IN (SELECT node FROM up) AND e.dst NOT IN (SELECT node FROM d1)),
area AS (SELECT node FROM up UNION SELECT node FROM d1 UNION SELECT node FROM d2)"""


@query(_TWO + " SELECT node FROM area")
def q_neighborhood(s, sf):
    return traverse.neighborhood(edges(s, sf), "s7", 2, 1 << 30).select("node")


@query(
    _TWO.replace("WITH e", "WITH RECURSIVE e")
    + """, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), i AS (SELECT * FROM b WHERE src IN (SELECT node FROM area) AND dst IN (SELECT node FROM area)),
w(node, d) AS (SELECT 's7', 0 UNION SELECT i.dst, w.d + 1 FROM w JOIN i ON i.src = w.node WHERE w.d < 6), m AS (SELECT node, min(d) AS dist FROM w GROUP BY node)
SELECT area.node, coalesce(m.dist, 999)::INT AS dist FROM area LEFT JOIN m USING (node) ORDER BY dist, node LIMIT 30"""
)
def q_subgraph_cap(s, sf):
    return traverse.neighborhood(edges(s, sf), "s7", 2, 30).select("node", F.col("dist").cast("int").alias("dist"))


TREE = """SELECT concat('o', o_orderkey) AS src, concat('c', o_custkey) AS dst FROM orders UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation"""


def tree_edges(s, sf):
    """Orders to customers to nations to regions: a graph of all rows in which two steps stay of the size of the tables."""
    pair = lambda d, a, x, b, y: t(s, sf, d).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return pair("orders", "o", "o_orderkey", "c", "o_custkey").union(pair("customer", "c", "c_custkey", "n", "c_nationkey")).union(pair("nation", "n", "n_nationkey", "r", "n_regionkey"))


@query(f"WITH e AS ({TREE}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n AS (SELECT concat('n', n_nationkey) AS node FROM nation), one AS (SELECT n.node AS source, b.dst AS node FROM n JOIN b ON b.src = n.node), two AS (SELECT source, node FROM one UNION SELECT one.source, b.dst FROM one JOIN b ON b.src = one.node) SELECT n.node AS source, (SELECT count(DISTINCT node) FROM two WHERE two.source = n.node AND two.node <> n.node) + 1 AS size FROM n")
def q_neighborhood_sizes(s, sf):
    return traverse.neighborhood_sizes(tree_edges(s, sf), t(s, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node")), 2)


@query(f"WITH z AS (SELECT src AS node, count(*) AS size FROM ({EDGES}) GROUP BY src), l AS (SELECT list_sort(list(size)) AS s, count(*) AS n, count(*) FILTER (WHERE size > 5) AS o, median(size) AS m, max(size) AS x FROM z) SELECT m::DOUBLE AS median, s[(floor(0.9 * (n - 1)) + 1)::INT] AS p90, x AS most, round(100.0 * o / n, 6) AS over_pct FROM l")
def q_cap_study(s, sf):
    return traverse.cap_study(edges(s, sf).groupBy("src").agg(F.count("*").alias("size")), 5).withColumn("over_pct", F.round("over_pct", 6))


@query(f"WITH RECURSIVE e AS ({TREE}), st AS (SELECT DISTINCT src AS source FROM e), r(source, node, depth) AS (SELECT source, source, 0 FROM st UNION SELECT r.source, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 50), m AS (SELECT source, node, min(depth) AS d FROM r GROUP BY ALL) SELECT source, max(d)::BIGINT AS depth FROM m GROUP BY source")
def q_downstream_depth(s, sf):
    e = tree_edges(s, sf)
    return traverse.downstream_depth(e, e.select(F.col("src").alias("node")).distinct())


@query(f"WITH n AS ({NODES}), e AS ({EDGES}) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE type = 'file') AS file_nodes, (SELECT count(*) FROM n WHERE type = 'function') AS function_nodes, 0::BIGINT AS class_nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE type = 'contains') AS contains_edges, 0::BIGINT AS imports_edges, (SELECT count(*) FROM e WHERE type = 'calls') AS calls_edges")
def q_graph_stats(s, sf):
    return graph.stats(nodes(s, sf), edges(s, sf))


@query(f"WITH d AS (SELECT dst AS id, count(*) AS in_degree FROM ({CALLS}) GROUP BY dst), n AS ({NODES}) SELECT d.id, n.name, d.in_degree FROM d JOIN n ON n.id = d.id ORDER BY in_degree DESC, d.id LIMIT 15")
def q_hotspots(s, sf):
    return graph.hotspots(nodes(s, sf), edges(s, sf))


@query(f"SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM ({EDGES}) GROUP BY type")
def q_edge_histogram(s, sf):
    return graph.edge_histogram(edges(s, sf))


@query("SELECT 's' || (p_partkey % 50) AS parent, string_agg(p_name, ',' ORDER BY p_name) AS names FROM part GROUP BY ALL")
def q_file_tree(s, sf):
    f = t(s, sf, "part").select(F.concat(F.lit("s"), F.col("p_partkey") % 50, F.lit("/"), "p_name").alias("rel"))
    return graph.file_tree(f).select("parent", F.array_join("names", ",").alias("names"))


def snapshot(s, sf, post: bool):
    """Parts and who ships them, before and after 1995: every order line is in one of the two."""
    li = t(s, sf, "lineitem").filter(F.col("l_shipdate") >= "1995-01-01" if post else F.col("l_shipdate") < "1995-01-01")
    e = li.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct().withColumn("type", F.lit("calls"))
    n = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return n.join(nodes(s, sf).select("id", "name"), "id", "left"), e


_SNAP = "a AS (SELECT DISTINCT concat('p', l_partkey) AS src, concat('s', l_suppkey) AS dst FROM lineitem WHERE l_shipdate < '1995-01-01'), b AS (SELECT DISTINCT concat('p', l_partkey) AS src, concat('s', l_suppkey) AS dst FROM lineitem WHERE l_shipdate >= '1995-01-01'), pre AS (SELECT src AS id FROM a UNION SELECT dst FROM a), post AS (SELECT src AS id FROM b UNION SELECT dst FROM b)"


@query(f"WITH {_SNAP} SELECT id FROM post EXCEPT SELECT id FROM pre")
def q_diff_activated(s, sf):
    return snapshots.activated(snapshot(s, sf, False)[0], snapshot(s, sf, True)[0])


@query(f"WITH {_SNAP} SELECT id FROM pre EXCEPT SELECT id FROM post")
def q_diff_deleted(s, sf):
    return snapshots.deleted(snapshot(s, sf, False)[0], snapshot(s, sf, True)[0])


@query(f"WITH {_SNAP} SELECT src AS caller, dst AS missing_callee, 'calls' AS edge_type FROM a WHERE src IN (SELECT id FROM post) AND dst NOT IN (SELECT id FROM post)")
def q_broken_edges(s, sf):
    return snapshots.broken_edges(snapshot(s, sf, False)[1], snapshot(s, sf, True)[0]).select("caller", "missing_callee", "edge_type")


@query(f"WITH {_SNAP}, g AS (SELECT p.id, n.p_name AS name FROM pre p JOIN part n ON p.id = concat('p', n.p_partkey) WHERE p.id NOT IN (SELECT id FROM post)) SELECT id, name, concat_ws(',', CASE WHEN contains(name, 'bolt') THEN 'bolt' END, CASE WHEN contains(name, 'ring') THEN 'ring' END, CASE WHEN contains(name, 'widget') THEN 'widget' END) AS matched, (SELECT count(*) FROM a WHERE a.dst = g.id) AS in_degree FROM g WHERE contains(name, 'bolt') OR contains(name, 'ring') OR contains(name, 'widget')")
def q_security_deletions(s, sf):
    (pre, e), (post, _) = snapshot(s, sf, False), snapshot(s, sf, True)
    return snapshots.security_deletions(pre, e, post, ["bolt", "ring", "widget"]).select("id", "name", F.array_join("matched", ",").alias("matched"), "in_degree")


@query("WITH i AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS k FROM part UNION SELECT DISTINCT array_to_string(string_split(p_type, ' ')[1:2], ' ') FROM part WHERE p_size > 25), n AS (SELECT DISTINCT p_type AS name FROM part), p AS (SELECT name, unnest(range(1, len(string_split(name, ' ')) + 1)) AS j FROM n), c AS (SELECT name, j, array_to_string(string_split(name, ' ')[1:j], ' ') AS k FROM p) SELECT c.name, arg_max(c.k, c.j) AS rel, max(c.j)::INT AS segments FROM c JOIN i ON i.k = c.k GROUP BY c.name")
def q_longest_prefix(s, sf):
    p = t(s, sf, "part")
    index = p.select(F.substring_index("p_type", " ", 1).alias("module")).union(p.filter("p_size > 25").select(F.substring_index("p_type", " ", 2))).distinct().withColumn("rel", F.col("module"))
    out = graph.longest_prefix(p.select(F.col("p_type").alias("name")), index, sep=" ")
    return out.select("name", "rel", F.col("segments").cast("int").alias("segments"))


@query("WITH c AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS name FROM pages), i AS (SELECT split_part(name, '/', 1) AS key, max(page_id) AS id FROM c GROUP BY 1 UNION ALL SELECT reverse(split_part(reverse(name), '.', 1)), min(page_id) FROM c WHERE contains(name, '.') GROUP BY 1), u AS (SELECT key, min(id) AS id FROM i GROUP BY key) SELECT c.page_id, coalesce(a.id, b.id) AS target FROM c LEFT JOIN u a ON a.key = c.name LEFT JOIN u b ON contains(c.name, '.') AND b.key = reverse(split_part(reverse(c.name), '.', 1))")
def q_call_resolution(s, sf):
    c = t(s, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("name"))
    index = c.groupBy(F.substring_index("name", "/", 1).alias("key")).agg(F.max("page_id").alias("id")).union(c.filter(F.col("name").contains(".")).groupBy(F.substring_index("name", ".", -1).alias("key")).agg(F.min("page_id").alias("id")))
    return graph.resolve_calls(c, index.groupBy("key").agg(F.min("id").alias("id"))).select("page_id", "target")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def q_first_last_wins(s, sf):
    o = t(s, sf, "orders")
    a = graph.winner(o, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    b = graph.winner(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return a.join(b, "o_custkey")


_SPANS = "sp AS (SELECT user_id, event_type, min(event_id) + (max(event_id) - min(event_id)) // 4 AS a, max(event_id) - (max(event_id) - min(event_id)) // 3 AS b FROM events GROUP BY ALL)"


def spans(s, sf):
    """Of each user and type of event, the middle of its ids."""
    g = t(s, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return g.select("user_id", "event_type", F.expr("lo + (hi - lo) div 4").alias("a"), F.expr("hi - (hi - lo) div 3").alias("b"))


@query(f"WITH {_SPANS}, top AS (SELECT e.event_id, max(sp.a) AS a FROM events e JOIN sp ON sp.user_id = e.user_id AND e.event_id BETWEEN sp.a AND sp.b GROUP BY 1) SELECT e.event_id, e.user_id, min(sp.event_type) AS event_type FROM events e LEFT JOIN top ON top.event_id = e.event_id LEFT JOIN sp ON sp.user_id = e.user_id AND sp.a = top.a AND e.event_id BETWEEN sp.a AND sp.b GROUP BY 1, 2")
def q_range_enclosing(s, sf):
    return detect.enclosing(t(s, sf, "events").select("event_id", "user_id"), spans(s, sf), ["user_id"], "event_id", "a", "b", "event_type")


@query(f"WITH {_SPANS} SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.user_id = e.user_id AND e.event_id BETWEEN sp.a AND sp.b)")
def q_range_antijoin(s, sf):
    return detect.outside(t(s, sf, "events").select("event_id", "user_id"), spans(s, sf), ["user_id"], "event_id", "a", "b")


@query("WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), w AS (SELECT doc_id, l, len(l) AS n, unnest(range(1, len(l) + 1, 16)) AS st FROM d) SELECT doc_id, st::INT AS start, least(st + 19, n)::INT AS stop, md5(array_to_string(list_transform(l[st:least(st + 19, n)], lambda x, i: (st + i - 1)::VARCHAR || ': ' || x), chr(10))) AS body FROM w WHERE st = 1 OR st + 3 < n")
def q_line_windows(s, sf):
    return windows.line_windows(t(s, sf, "documents").select("doc_id", "text"), window=20, overlap=4).select("doc_id", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.md5("body").alias("body"))


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, md5(array_to_string(string_split(text, chr(10))[1:5], chr(10))) AS head, len(string_split(text, chr(10))) > 5 AS truncated FROM documents")
def q_truncate_preview(s, sf):
    return windows.preview(t(s, sf, "documents").select("doc_id", "text"), most=5).select("doc_id", "n_lines", F.md5("head").alias("head"), "truncated")


# ---- text


@query("WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS a, doc_id % 7 AS r FROM documents) SELECT doc_id, round(CASE WHEN a >= 50 AND a / greatest(r, 1) >= 5 THEN least(1.0, a / 100 * (a / greatest(r, 1)) / 10) WHEN a >= 20 AND a / greatest(r, 1) >= 3 THEN 0.4 ELSE 0 END, 6)::DOUBLE AS score FROM d")
def q_bulk_addition(s, sf):
    return t(s, sf, "documents").select("doc_id", F.round(au.bulk_addition(F.size(lines("text")), F.col("doc_id") % 7), 6).alias("score"))


_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_STOCK = ", ".join(f"'{x}'" for x in spec.BOILERPLATE_LINES)
_BOILER = f"""b0 AS (SELECT doc_id, string_split(trim(text, {_WS}), chr(10)) AS l FROM src), b1 AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM b0),
b2 AS (SELECT doc_id, i, trim(raw, {_WS}) AS x, contains(raw, repeat(chr(34), 3)) OR contains(raw, repeat(chr(39), 3)) AS q FROM b1),
b3 AS (SELECT *, coalesce(sum(q::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM b2),
b4 AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE q OR inside) AS doc, count(*) FILTER (WHERE NOT (q OR inside) AND x = '') AS blank,
count(*) FILTER (WHERE NOT (q OR inside) AND (starts_with(x, '#') OR starts_with(x, '//') OR x IN ({_STOCK}))) AS said FROM b3 GROUP BY doc_id),
b5 AS (SELECT doc_id, total, (doc + said) / greatest(total - blank, 1) AS r FROM b4),
boiler AS (SELECT doc_id, (CASE WHEN total < 5 THEN 0 WHEN r > 0.4 THEN 0.9 WHEN r > 0.3 THEN 0.6 WHEN r > 0.2 THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM b5)"""
#: Texts with every kind of line among their own, so that no rung stays empty.
_CODED = """src AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(10) || '# note' || chr(10)) WHEN 2 THEN replace(text, chr(10), chr(10) || '  try:' || chr(10) || 'finally:' || chr(10) || '  pass ' || chr(10) || 'tried' || chr(10)) ELSE replace(text, chr(10), chr(10) || 'x = ' || repeat(chr(34), 3) || chr(10)) END AS text FROM documents)"""


def coded(s, sf):
    d, k = t(s, sf, "documents"), F.col("doc_id") % 4
    put = lambda by: F.replace(F.col("text"), F.lit("\n"), F.lit(f"\n{by}\n"))
    return d.select("doc_id", F.when(k == 1, put("# note")).when(k == 2, put("  try:\nfinally:\n  pass \ntried")).when(k == 3, put('x = \"\"\"')).otherwise(F.col("text")).alias("text"))


@query(f"WITH {_CODED}, {_BOILER} SELECT doc_id, score FROM boiler")
def q_boilerplate(s, sf):
    return coded(s, sf).select("doc_id", au.boilerplate_density(F.col("text")).alias("score"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), k AS (SELECT doc_id, x, length(x) - length(ltrim(x, ' ' || chr(9))) AS i FROM l WHERE trim(x, ' ' || chr(9) || chr(13)) <> ''), a AS (SELECT doc_id, count(*) AS n, coalesce(stddev_samp(length(x)), 0) AS sl, coalesce(stddev_samp(i) FILTER (WHERE i > 0), 0) AS si, count(*) FILTER (WHERE i % 4 <> 0) AS odd FROM k GROUP BY doc_id) SELECT d.doc_id, round(CASE WHEN coalesce(n, 0) < 10 THEN 0 ELSE (CASE WHEN si < 2 AND odd = 0 THEN 0.4 ELSE 0 END) + (CASE WHEN sl < 15 THEN 0.3 ELSE 0 END) END, 6)::DOUBLE AS score FROM documents d LEFT JOIN a USING (doc_id)")
def q_uniform_style(s, sf):
    return t(s, sf, "documents").select("doc_id", au.uniform_style(F.col("text")).alias("score"))


def _hits(patterns):
    return " + ".join("len(regexp_extract_all(text, '" + p.replace("'", "''") + "', 0, 'im'))" for p in patterns)


@query(f"SELECT doc_id, ({_hits(spec.DEFENSIVE_PATTERNS)})::INT AS safe, ({_hits(spec.RISKY_PATTERNS)})::INT AS risky, ({_hits(spec.COMMENT_PATTERNS)})::INT AS telltale FROM documents")
def q_pattern_counts(s, sf):
    from ..functions import count_matches

    return t(s, sf, "documents").select("doc_id", count_matches("text", spec.DEFENSIVE_PATTERNS, au.INSENSITIVE).alias("safe"), count_matches("text", spec.RISKY_PATTERNS, au.INSENSITIVE).alias("risky"), count_matches("text", spec.COMMENT_PATTERNS, au.INSENSITIVE).alias("telltale"))


@query(f"WITH c AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, {_hits(spec.DEFENSIVE_PATTERNS)} AS a, {_hits(spec.RISKY_PATTERNS)} AS r FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents)) SELECT doc_id, (CASE WHEN n < 10 OR r = 0 THEN 0 WHEN a / greatest(r, 1) < 0.3 THEN 0.7 WHEN a / greatest(r, 1) < 0.5 THEN 0.4 WHEN a / greatest(r, 1) < 1 THEN 0.2 ELSE 0 END)::DOUBLE AS score FROM c")
def q_missing_edge_cases(s, sf):
    return t(s, sf, "documents").select("doc_id", au.missing_edge_cases(F.col("text")).alias("score"))


@query(f"WITH c AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS n, {_hits(spec.COMMENT_PATTERNS)} AS m FROM documents) SELECT doc_id, (CASE WHEN n < 5 THEN 0 WHEN m / (n / 20) >= 3 THEN 0.9 WHEN m / (n / 20) >= 2 THEN 0.6 WHEN m / (n / 20) >= 1 THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM c")
def q_comment_density(s, sf):
    return t(s, sf, "documents").select("doc_id", au.generated_comments(F.col("text")).alias("score"))


@query("WITH c AS (SELECT page_id, len(regexp_extract_all(html, '^[+\\s]*(?:class |function |def |const \\w+ = (?:async )?\\()', 0, 'm')) AS m, len(list_filter(string_split(trim(html, ' ' || chr(9) || chr(10) || chr(13)), chr(10)), lambda x: NOT starts_with(x, '-'))) AS n FROM pages) SELECT page_id, (CASE WHEN m = 0 OR n < 10 THEN 0 WHEN m / (n / 100) >= 3 THEN 0.8 WHEN m / (n / 100) >= 2 THEN 0.5 WHEN m / (n / 100) >= 1 THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM c")
def q_complete_functions(s, sf):
    return t(s, sf, "pages").select("page_id", au.complete_functions(F.col("html")).alias("score"))


_MESSAGE = " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "', 'im')" for p in spec.MESSAGE_PATTERNS)


@query(f"SELECT conv_id, turn, (CASE WHEN regexp_matches(text, '{spec.MESSAGE_NAMES}', 'i') THEN 1.0 WHEN {_MESSAGE} THEN 0.6 WHEN length(text) > 200 THEN 0.4 ELSE 0.0 END)::DOUBLE AS score FROM conversations")
def q_commit_message(s, sf):
    return t(s, sf, "conversations").select("conv_id", "turn", au.commit_message(F.col("text")).alias("score"))


_START = spec.FUNCTION_START.replace("'", "''")


@query(
    f"""WITH src AS (SELECT doc_id, regexp_replace(text, chr(10) || '$', '') AS text FROM documents), {_BOILER},
u AS ({ORACLE["q_uniform_style"].replace("documents", "src")}), m AS ({ORACLE["q_missing_edge_cases"].replace("documents", "src")}), k AS ({ORACLE["q_comment_density"].replace("documents", "src")}),
d AS (SELECT doc_id, '+' || replace(text, chr(10), chr(10) || '+') AS t, len(string_split(text, chr(10))) AS n FROM src),
g AS (SELECT doc_id, n, len(regexp_extract_all(t, '{_START}', 0, 'm')) AS f, len(string_split(trim(t, {_WS}), chr(10))) AS r FROM d),
p AS (SELECT doc_id, n, CASE WHEN n >= 50 THEN least(1.0, n / 100 * n / 10) WHEN n >= 20 THEN 0.4 ELSE 0 END AS bulk, CASE WHEN f = 0 OR r < 10 THEN 0 WHEN f / (r / 100) >= 3 THEN 0.8 WHEN f / (r / 100) >= 2 THEN 0.5 WHEN f / (r / 100) >= 1 THEN 0.3 ELSE 0 END AS whole FROM g),
c AS (SELECT p.doc_id, n, (0.2 * bulk + 0.15 * boiler.score + 0.1 * u.score + 0.15 * whole + 0.15 * m.score + 0.1 * k.score) / 0.85 AS x FROM p JOIN boiler USING (doc_id) JOIN u USING (doc_id) JOIN m USING (doc_id) JOIN k USING (doc_id))
SELECT doc_id, n::INT AS lines_added, 0::INT AS lines_removed, round(least(1, x), 6)::DOUBLE AS confidence, x >= 0.5 AS likely_ai FROM c"""
)
def q_ai_confidence(s, sf):
    d = t(s, sf, "documents").select("doc_id", au.pseudo_diff(F.col("text")).alias("diff"))
    return au.analyze(d).select("doc_id", "lines_added", "lines_removed", F.round("confidence", 6).alias("confidence"), "likely_ai")


@query("SELECT sum(CASE WHEN n_chars >= 2000 AND quality = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN n_chars >= 2000 AND quality <> 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN n_chars < 2000 AND quality = 1 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN n_chars < 2000 AND quality <> 1 THEN 1 ELSE 0 END)::BIGINT AS tn FROM documents JOIN labels USING (doc_id)")
def q_threshold_classifier(s, sf):
    d = t(s, sf, "documents").select("doc_id", "n_chars").join(t(s, sf, "labels"), "doc_id")
    return au.classifier(d, "n_chars", "quality", 2000).select("tp", "fp", "fn", "tn")


@query("WITH x AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), p AS (SELECT * FROM x WHERE quality = 1), n AS (SELECT * FROM x WHERE quality = 0) SELECT round(avg(CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5 ELSE 0 END), 6)::DOUBLE AS auc FROM p, n")
def q_auc(s, sf):
    d = t(s, sf, "documents").select("doc_id", "n_chars").join(t(s, sf, "labels"), "doc_id")
    return au.auc(d, "n_chars", "quality").select(F.round("auc", 6).alias("auc"))


_DIFF = "concat('diff --git a/', lang, '.py b/', lang, '.py', chr(10), '+++ b/', lang, '.py', chr(10), text)"


def doc_diffs(s, sf):
    d = t(s, sf, "documents")
    w = F.concat(F.lit("diff --git a/"), "lang", F.lit(".py b/"), "lang", F.lit(".py\n+++ b/"), "lang", F.lit(".py\n"), "text")
    return d.groupBy(F.col("source").alias("diff_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", w.alias("x")))), lambda r: r["x"]), "\n").alias("diff"))


@query(f"WITH b AS (SELECT source AS diff_id, lang || '.py' AS file, doc_id, {_DIFF} AS x FROM documents WHERE text NOT LIKE '%diff --git%') SELECT diff_id, file, md5(arg_max(x, doc_id)) AS text FROM b GROUP BY 1, 2")
def q_diff_split(s, sf):
    return diffs.split_by_file(diffs.diff_lines(doc_diffs(s, sf))).select("diff_id", "file", F.md5("text").alias("text"))


@query("SELECT source AS diff_id, lang || '.py' AS file, (sum(len(string_split(text, chr(10)))) + 2 * count(*))::BIGINT AS n FROM documents GROUP BY 1, 2")
def q_current_file(s, sf):
    d = t(s, sf, "documents").select(F.concat("source", F.lit(":"), "doc_id").alias("diff_id"), F.concat(F.lit("--- a/"), "lang", F.lit(".py\n+++ b/"), "lang", F.lit(".py\n"), "text").alias("diff"))
    r = diffs.current_file(diffs.diff_lines(d))
    return r.groupBy(F.substring_index("diff_id", ":", 1).alias("diff_id"), "file").agg(F.count("*").alias("n"))


# ---- ranking and cache


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 20")
def q_cosine_topk(s, sf):
    e = t(s, sf, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()
    return rank.nearest(e, list(q[0]) if q else [], "vec_id", "embedding")


@query("WITH c AS (SELECT doc_id % 97 AS path, sha256(text) AS hash FROM documents WHERE doc_id % 2 = 0) SELECT d.doc_id, EXISTS (SELECT 1 FROM c WHERE c.path = d.doc_id % 97 AND c.hash = sha256(d.text)) AS hit FROM documents d")
def q_cache_hit_miss(s, sf):
    d = t(s, sf, "documents").select("doc_id", (F.col("doc_id") % 97).alias("path"), F.col("text").alias("content"))
    cache = d.filter("doc_id % 2 = 0").select("path", F.sha2("content", 256).alias("hash"))
    return rank.cache_lookup(d, cache).select("doc_id", "hit")


@query("SELECT path, ((row_number() OVER (ORDER BY path) - 1) // 20)::BIGINT AS batch FROM (SELECT p_partkey AS path FROM part)")
def q_cache_batches(s, sf):
    return rank.batches(t(s, sf, "part").select(F.col("p_partkey").alias("path"))).select("path", "batch")


# ---- evaluation


def _tokens(col):
    return "concat_ws(',', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({col}), '{n}')" for n in needles) + f" THEN '{k}' END" for k, needles in sorted(spec.CATEGORY_NEEDLES.items())) + ")"


@query(f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents")
def q_category_tokens(s, sf):
    return t(s, sf, "documents").select("doc_id", F.array_join(evaluate.category_tokens(F.col("text")), ",").alias("tokens"))


@query("WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS tp, count(*) FILTER (WHERE o_orderstatus = 'O') AS fp, count(*) FILTER (WHERE o_orderstatus = 'P') AS fn FROM orders GROUP BY o_custkey) SELECT o_custkey, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6)::DOUBLE AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6)::DOUBLE AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6)::DOUBLE AS f1 FROM c")
def q_prf(s, sf):
    c = t(s, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("tp"), F.count_if(F.col("o_orderstatus") == "O").alias("fp"), F.count_if(F.col("o_orderstatus") == "P").alias("fn"))
    out = evaluate.scores(c)
    return out.select("o_custkey", "tp", "fp", "fn", *(F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")))


@query("WITH m AS (SELECT o_orderkey AS id, count(DISTINCT l_linenumber) AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderpriority AS category, count(*) AS n, count(m.c) AS any_run, round(coalesce(sum(m.c), 0) / (count(*) * 7), 6)::DOUBLE AS mean_recall FROM orders LEFT JOIN m ON m.id = o_orderkey GROUP BY 1")
def q_per_category(s, sf):
    truth = t(s, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"))
    got = t(s, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("run"))
    return evaluate.per_category(truth, got, 7).withColumn("mean_recall", F.round("mean_recall", 6))


@query("SELECT o_custkey, round(avg(o_totalprice), 4) AS price_mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS price_std, len(list(o_totalprice))::INT AS n FROM orders GROUP BY o_custkey")
def q_over_runs(s, sf):
    r = evaluate.over_runs(t(s, sf, "orders").withColumnRenamed("o_totalprice", "price"), ["o_custkey"], ["price"], "o_orderkey")
    return r.select("o_custkey", F.round("price_mean", 4).alias("price_mean"), F.round("price_std", 4).alias("price_std"), F.size("price_values").alias("n"))


_KIND = "CASE event_type WHEN 'error' THEN 'SQL injection' WHEN 'purchase' THEN 'Auth Bypass' WHEN 'click' THEN 'Injection' ELSE 'XSS' END"
_FOUND = f"f AS (SELECT user_id AS run, event_id AS ord, {_KIND} AS category, concat('src/F', event_id % 2, '.py') AS file, trunc(value)::BIGINT AS line FROM events)"


def event_findings(s, sf):
    """Events as findings of a run for each user, in one of two files."""
    kind = F.when(F.col("event_type") == "error", "SQL injection").when(F.col("event_type") == "purchase", "Auth Bypass").when(F.col("event_type") == "click", "Injection").otherwise("XSS")
    place = F.struct(F.concat(F.lit("src/F"), F.col("event_id") % 2, F.lit(".py")).alias("file"), F.col("value").cast("long").alias("line"))
    return t(s, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), kind.alias("category"), F.array(place).alias("locations"))


@query(f"WITH {_FOUND}, g AS (SELECT run, list_sort(list({{'ord': ord, 'category': category, 'file': file, 'line': line}})) AS l FROM f GROUP BY run) SELECT run, len(list_reduce(list_prepend([{{'ord': 0::BIGINT, 'category': '', 'file': '', 'line': -1000000::BIGINT}}], list_transform(l, lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.file = x[1].file AND (k.category = x[1].category OR (contains(k.category, 'njection') AND contains(x[1].category, 'njection'))) AND abs(k.line - x[1].line) <= 3)) > 0 THEN acc ELSE list_concat(acc, x) END)) - 1 AS kept FROM g")
def q_dedupe_greedy(s, sf):
    return evaluate.dedupe(event_findings(s, sf)).groupBy("run").agg(F.count("*").alias("kept"))


_TRUTHS = "tr AS (SELECT p_partkey - 1 AS ord, concat('lib/f', p_partkey % 2, '.PY') AS file, (p_partkey * 7) % 500 AS a, (p_partkey * 7) % 500 + p_size % 5 AS b, p_size % 3 AS k FROM part WHERE p_partkey <= 60)"
_PAIRS = f"{_FOUND}, {_TRUTHS}, c AS (SELECT run, f.ord AS f, tr.ord AS t, greatest(a - line, line - b, 0) AS dist, (k = 0 AND category IN ('SQL injection', 'Injection')) OR (k = 1 AND category = 'Auth Bypass') OR (k = 2 AND category = 'XSS') AS agree FROM f JOIN tr ON lower(replace(f.file, 'src/', '')) = lower(replace(tr.file, 'lib/', '')) AND greatest(a - line, line - b, 0) <= 5)"


def part_truth(s, sf):
    """Sixty planted flaws, of three categories, from the first parts."""
    p, k = F.col("p_partkey"), F.col("p_size") % 3
    kind = F.when(k == 0, "sqli").when(k == 1, "permission").otherwise("cross-site scripting")
    return t(s, sf, "part").filter("p_partkey <= 60").select((p - 1).alias("ord"), p.cast("string").alias("id"), F.concat(F.lit("lib/f"), p % 2, F.lit(".PY")).alias("file"), ((p * 7) % 500).alias("line_start"), ((p * 7) % 500 + F.col("p_size") % 5).alias("line_end"), F.array(kind).alias("accepted"), kind.alias("category"), F.lit(False).alias("provisional"))


@query(f"WITH {_PAIRS}, g AS (SELECT run, list_sort(list({{'dist': dist, 'f': f, 't': t}})) AS l FROM c WHERE agree GROUP BY run), m AS (SELECT run, list_reduce(list_prepend([{{'dist': -1::BIGINT, 'f': -9::BIGINT, 't': -9::BIGINT}}], list_transform(l, lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.f = x[1].f OR k.t = x[1].t)) > 0 THEN acc ELSE list_concat(acc, x) END) AS m FROM g) SELECT run, len(m) - 1 AS matched, (SELECT sum(x.dist) FROM unnest(m) AS u(x)) + 1 AS distance FROM m")
def q_match_greedy(s, sf):
    matched, _ = evaluate.match(event_findings(s, sf), part_truth(s, sf))
    return matched.groupBy("run").agg(F.count("*").alias("matched"), F.sum("dist").alias("distance"))


@query(f"WITH {_PAIRS} SELECT run, count(DISTINCT t) AS located FROM c GROUP BY run")
def q_loc_only_recall(s, sf):
    return evaluate.location_recall(event_findings(s, sf), part_truth(s, sf)).groupBy("run").agg(F.count("*").alias("located"))


@query("WITH h AS (SELECT DISTINCT c_nationkey AS k FROM customer), a AS (SELECT s_suppkey::VARCHAR AS file, s_nationkey IN (SELECT k FROM h WHERE k % 3 <> 1) AS hit FROM supplier) SELECT count(*) AS n_files, count(*) FILTER (WHERE hit) AS n_detected, round(count(*) FILTER (WHERE hit) / count(*), 6)::DOUBLE AS recall, string_agg(CASE WHEN NOT hit THEN file END, ',' ORDER BY file) AS missed FROM a")
def q_file_detection(s, sf):
    f = t(s, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), "s_nationkey")
    home = t(s, sf, "customer").select(F.col("c_nationkey").alias("s_nationkey")).filter("s_nationkey % 3 <> 1").distinct()
    hit = f.join(home, "s_nationkey", "left_semi").select("file")
    out = evaluate.file_detection(f, hit)
    return out.select("n_files", "n_detected", F.round("recall", 6).alias("recall"), F.nullif(F.array_join("missed", ","), F.lit("")).alias("missed"))


# ---- statistics


@query("SELECT source, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS both, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS only_b, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS neither FROM documents JOIN labels USING (doc_id) GROUP BY source")
def q_paired_table(s, sf):
    d = t(s, sf, "documents").select("doc_id", "source").join(t(s, sf, "labels"), "doc_id").select("source", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return stats.paired_table(d, "a", "b", ["source"])


@query("WITH m AS (SELECT r_name AS k, avg(n_nationkey) AS v FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1) SELECT x.k AS a, y.k AS b, round(x.v - y.v, 6) AS difference FROM m x JOIN m y ON x.k < y.k")
def q_pair_differences(s, sf):
    arms = t(s, sf, "region").join(t(s, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("k")).agg(F.avg("n_nationkey").alias("v"))
    return stats.pair_differences(arms, "k", "v").withColumn("difference", F.round("difference", 6))


@query("WITH r AS (SELECT DISTINCT l_linenumber AS k FROM lineitem), f AS (SELECT l_partkey, min(l_linenumber) AS k FROM lineitem GROUP BY 1) SELECT r.k, (SELECT count(*) FROM f WHERE f.k = r.k) AS new, (SELECT count(*) FROM f WHERE f.k <= r.k) AS pooled FROM r")
def q_pooling_curve(s, sf):
    return stats.pooling_curve(t(s, sf, "lineitem"), "l_linenumber", "l_partkey")


@query("SELECT l_returnflag = 'R' AS caught, count(*) AS n, round(avg(l_linenumber / l_quantity), 6) AS depth_ratio FROM lineitem GROUP BY 1")
def q_positional(s, sf):
    return stats.positional(t(s, sf, "lineitem").withColumn("caught", F.col("l_returnflag") == "R"), "l_linenumber", "l_quantity", "caught").withColumn("depth_ratio", F.round("depth_ratio", 6))


@query("SELECT c_mktsegment, min(c_acctbal) AS least, max(c_acctbal) AS most, round(avg(c_acctbal), 4) AS mean, count(*)::INT AS n FROM customer GROUP BY 1")
def q_run_distribution(s, sf):
    d = stats.distribution(t(s, sf, "customer"), "c_mktsegment", "c_acctbal")
    return d.select("c_mktsegment", "least", "most", F.round("mean", 4).alias("mean"), F.size("points").alias("n"))


_LN = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_SIZES = "(VALUES (0), (1), (2), (3), (5), (8), (12), (40), (150), (600), (900), (2500)) AS {0}({0})"


@query(f"WITH p AS (SELECT b, c, least(b, c) AS m, b + c AS n FROM {_SIZES.format('b')}, {_SIZES.format('c')}), q AS (SELECT b, c, n, unnest(range(0, m + 1)) AS i FROM p) SELECT b::INT AS b, c::INT AS c, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp({_LN.format('n', 'i')} - n * ln(2.0)))) END, 6)::DOUBLE AS p FROM q GROUP BY b, c, n")
def q_mcnemar(s, sf):
    one = lambda k: s.createDataFrame([(x,) for x in (0, 1, 2, 3, 5, 8, 12, 40, 150, 600, 900, 2500)], f"{k} int")
    return one("b").crossJoin(one("c")).select("b", "c", F.round(stats.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))  # a fixed grid


@query(f"WITH t AS (SELECT source, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS a, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS d FROM documents JOIN labels USING (doc_id) GROUP BY source), x AS (SELECT *, a + b AS r, a + c AS k, b + d AS k2, a + b + c + d AS n, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i FROM t), p AS (SELECT *, exp({_LN.format('k', 'i')} + {_LN.format('k2', '(r - i)')} - {_LN.format('n', 'r')}) AS p, exp({_LN.format('k', 'a')} + {_LN.format('k2', '(r - a)')} - {_LN.format('n', 'r')}) AS seen FROM x) SELECT source, a, b, c, d, round(least(1.0, sum(p) FILTER (WHERE p <= seen * (1 + 1e-9) + 1e-12)), 6)::DOUBLE AS p FROM p GROUP BY source, a, b, c, d")
def q_fisher(s, sf):
    d = t(s, sf, "documents").select("doc_id", "source").join(t(s, sf, "labels"), "doc_id").select("source", (F.col("quality") == 1).alias("x"), (F.col("toxic") == 1).alias("y"))
    tab = stats.paired_table(d, "x", "y", ["source"]).select("source", F.col("both").alias("a"), F.col("only_a").alias("b"), F.col("only_b").alias("c"), F.col("neither").alias("d"))
    return stats.fisher_table(tab).withColumn("p", F.round("p", 6))


@query()
def q_bootstrap(s, sf):
    """Seeded draws of Python's generator: beyond SQL; the tests repeat them plainly."""
    r = t(s, sf, "region").join(t(s, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("arm"), "n_nationkey", F.col("n_nationkey").cast("double").alias("v"))
    return stats.bootstrap(r, "arm", "v", "n_nationkey", 2000)


# ---- cost


@query("SELECT user_id, round(sum(value / 1e6 * CASE event_type WHEN 'click' THEN 1.0 WHEN 'error' THEN 5.0 WHEN 'purchase' THEN 3.0 ELSE 15.0 END), 10) AS usd FROM events GROUP BY user_id")
def q_usd(s, sf):
    meter = F.when(F.col("event_type").isin("click", "error", "purchase"), F.col("event_type")).otherwise("other")
    prices = s.createDataFrame([("click", 1.0), ("error", 5.0), ("purchase", 3.0), ("other", 15.0)], "meter string, per_million double")
    return cost.usd(t(s, sf, "events").select("user_id", meter.alias("meter"), F.col("value").alias("tokens")), prices, ["user_id"]).withColumn("usd", F.round("usd", 10))


def ledger(s, sf):
    return t(s, sf, "events").select("user_id", "event_id", "ts", F.col("value").cast("long").alias("cost"))


@query("SELECT user_id, event_id, (sum(trunc(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM events")
def q_running_spend(s, sf):
    return cost.running_spend(ledger(s, sf), ["user_id"], ["ts", "event_id"], "cost").select("user_id", "event_id", "spent")


@query("SELECT user_id, event_id, 500 - (sum(trunc(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) >= 0.3 AS allowed FROM events")
def q_budget_stop(s, sf):
    return cost.within_budget(ledger(s, sf), ["user_id"], ["ts", "event_id"], "cost", 500.0).select("user_id", "event_id", "allowed")


_BENCH = "b AS (SELECT l_returnflag AS bench, count(*) AS runs, avg(l_extendedprice) AS cm, stddev_samp(l_extendedprice) AS cs, avg(l_quantity) AS sm, max(l_partkey) AS loc, max(l_linenumber)::BIGINT AS files, avg(l_tax) AS tm FROM lineitem GROUP BY 1)"


def benches(s, sf):
    li = t(s, sf, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long")).withColumnRenamed("l_returnflag", "bench")
    return cost.per_benchmark(li, "bench", "l_extendedprice", "l_quantity", "l_partkey", "l_linenumber", "l_tax")


@query(f"WITH {_BENCH} SELECT bench, runs, round(cm, 3) AS cost_mean, round(cs, 3) AS cost_std, round(cm / (loc / 1000), 3) AS cost_per_kloc, round(cm / files, 3) AS cost_per_file FROM b")
def q_cost_rollup(s, sf):
    return benches(s, sf).select("bench", "runs", *(F.round(c, 3).alias(c) for c in ("cost_mean", "cost_std", "cost_per_kloc", "cost_per_file")))


@query(f"WITH {_BENCH} SELECT sum(runs)::BIGINT AS runs, round(sum(cm), 3) AS cost_mean, 0.0::DOUBLE AS cost_std, sum(loc)::BIGINT AS loc, round(sum(cm) / (sum(loc) / 1000), 3) AS cost_per_kloc FROM b")
def q_grand_total(s, sf):
    return cost.grand_total(benches(s, sf)).select("runs", F.round("cost_mean", 3).alias("cost_mean"), "cost_std", "loc", F.round("cost_per_kloc", 3).alias("cost_per_kloc"))


@query("SELECT p_partkey, p_retailprice > 1.2 * (SELECT median(p_retailprice) FROM part) AS outlier FROM part")
def q_outlier_median(s, sf):
    return cost.outliers(t(s, sf, "part"), "p_retailprice", 1.2).select("p_partkey", "outlier")


@query("WITH m AS (SELECT o_orderstatus AS b, o_orderpriority AS stage, avg(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT b, stage, round(v, 3) AS mean_s, round(100 * v / sum(v) OVER (PARTITION BY b), 6) AS pct FROM m")
def q_stage_shares(s, sf):
    return cost.stage_shares(t(s, sf, "orders").select(F.col("o_orderstatus").alias("b"), F.col("o_orderpriority").alias("stage"), "o_totalprice"), "b", "stage", "o_totalprice").select("b", "stage", F.round("mean_s", 3).alias("mean_s"), F.round("pct", 6).alias("pct"))


def queries() -> dict:
    return QUERIES | code_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE | code_queries.oracle_sql()
