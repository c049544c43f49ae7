"""Graph traversal by frontiers (T1-T16): each step is one join of the frontier with the edges and one anti-join with
what has been seen; lineage is cut at every step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import split_lines
from ..plans.lineage import cut


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(flipped(edges)).distinct()


#: A frontier of up to so many nodes is sent to where the edges lie; edges are dealt out to meet a larger one.
SENT = 1 << 18


def stepped(edges: DataFrame, front: DataFrame, n: int) -> DataFrame:
    """Nodes that edges from a frontier of n nodes lead to. Only edges that meet it are gathered."""
    nodes = front.select(F.col("node").alias("src"))
    return edges.select("src", "dst").join(F.broadcast(nodes) if n <= SENT else nodes, "src", "left_semi").select(F.col("dst").alias("node")).distinct()


def bfs(edges: DataFrame, starts: DataFrame, depth: int, paths: bool = False, seen: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Nodes reached along src -> dst from ``starts`` (node, and the columns ``by``), with the least depth.

    The starts themselves are not seen at first: a cycle reaches them like any node. ``seen``: nodes that the walk
    neither returns nor passes through. ``by``: separate searches, one for each value of these columns.
    """
    by = list(by)
    plain = not paths and not by
    step_edges = None if plain else cut(edges.select(F.col("src").alias("_from"), F.col("dst").alias("node")).distinct())
    empty = F.expr("cast(array() as array<string>)")
    front = starts.select(*by, "node", empty.alias("path"))
    n = front.count() if plain else None
    out = None
    for d in range(1, depth + 1):
        reached = None if plain else front.withColumnRenamed("node", "_from").join(step_edges, "_from")
        if plain:
            reached = stepped(edges, front, n).withColumn("path", empty)
        elif paths:
            reached = reached.groupBy(*by, "node").agg(F.min("path").alias("path")).withColumn("path", F.concat("path", F.array("node")))
        else:
            reached = reached.select(*by, "node").distinct().withColumn("path", empty)
        if seen is not None:
            reached = reached.join(seen, [*[b for b in by if b in seen.columns], "node"], "left_anti")
        if out is not None:
            reached = reached.join(out.select(*by, "node"), [*by, "node"], "left_anti")
        front = cut(reached)
        rows = front.withColumn("depth", F.lit(d))
        out = rows if out is None else out.unionByName(rows)
        n = front.count() if plain else None
        if n == 0 or (n is None and front.isEmpty()):
            break
    return out if paths else out.drop("path")


def blast_radius(edges: DataFrame, node: str, max_depth: int = 5) -> DataFrame:
    """Everything that reaches ``node`` against the edges: node, depth, path (start left out), direct_caller. Of several
    shortest paths the least one stands."""
    start = edges.sparkSession.createDataFrame([(node,)], "node string")
    return bfs(flipped(edges), start, max_depth, paths=True).withColumn("direct_caller", F.col("depth") == 1)


def blast_summary(radius: DataFrame, tree: int = 10, listed: int = 15) -> DataFrame:
    """One row: how many callers are direct or indirect, and the nearest ones as text."""
    counts = radius.agg(F.count_if("direct_caller").alias("direct"), F.count_if(~F.col("direct_caller")).alias("indirect"))
    near = radius.select("depth", "node").orderBy("depth", "node").limit(listed).agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("_near"))
    line = F.transform("_near", lambda x: F.concat(F.repeat(F.lit("  "), x["depth"]), x["node"]))
    return counts.crossJoin(near).select("direct", "indirect", F.array_join(F.slice(line, 1, tree), "\n").alias("tree"), F.array_join(line, "\n").alias("prompt"))  # one row each


def neighborhood(edges: DataFrame, target: str, max_depth: int = 3, max_nodes: int = 50, files: DataFrame | None = None) -> DataFrame:
    """Nodes around a target: upstream first, then downstream without passing through nodes found upstream, then the
    files that contain them (``files``: node, file), the nearest max_nodes kept by undirected distance among them
    (none: 999) and id. Returns node, dist."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(target,)], "node string")
    up = bfs(flipped(edges), start, max_depth, seen=start).select("node")
    seen = cut(start.union(up).distinct())
    down = bfs(edges, start, max_depth, seen=seen).select("node")
    some = seen.union(down).distinct()
    if files is not None:
        some = some.union(files.join(some, "node", "left_semi").select(F.col("file").alias("node"))).distinct()
    some = cut(some)
    # Without files every node is at most max_depth away, so what one step less does not reach is that far. Nodes beyond
    # a step at which there are enough are none of the nearest.
    rest, steps = (max_depth, max_depth - 1) if files is None else (999, 2 * max_depth + 2)
    known, front, size, found = start.withColumn("dist", F.lit(0)), start, 1, 1
    for d in range(1, steps + 1):
        if size == 0 or found >= max_nodes:
            break
        met = stepped(edges, front, size).union(stepped(flipped(edges), front, size)).distinct()
        front = cut(met.join(some, "node", "left_semi").join(known, "node", "left_anti"))
        size = front.count()
        found += size
        known = known.unionByName(front.withColumn("dist", F.lit(d)))
    if found < max_nodes:
        known = some.join(known, "node", "left").withColumn("dist", F.coalesce("dist", F.lit(rest)))
    ranked = known.orderBy("dist", "node")
    return ranked.limit(max_nodes) if max(found, some.count()) > max_nodes else ranked


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def find_node(nodes: DataFrame, text: str) -> DataFrame:
    """The node a user means: exact id, else an id that ends so, else a name; the first by position."""
    rank = F.when(F.col("id") == text, 0).when(F.col("id").endswith(text), 1).when((F.col("name") == text) | (F.col("qualified_name") == text), 2)
    return nodes.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "ord").limit(1)


def find_file(nodes: DataFrame, path: str) -> DataFrame:
    rank = F.when(F.col("id") == F.lit("file:" + path), 0).when(F.col("id").endswith(path), 1)
    return nodes.filter("type = 'file'").withColumn("rank", rank).filter("rank is not null").orderBy("rank", "ord").limit(1)


def find_function(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter("type = 'function'").filter((F.col("name") == name) | (F.col("qualified_name") == name)).orderBy("ord").limit(1)


def neighborhood_sizes(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """For every source: nodes within ``depth`` undirected steps, itself included."""
    starts = sources.select(F.col("node").alias("source"), "node")
    got = bfs(both_ways(edges), starts, depth, by=["source"])
    n = got.filter("node != source").groupBy("source").agg(F.count("*").alias("n"))
    return sources.select(F.col("node").alias("source")).join(n, "source", "left").select("source", (F.coalesce("n", F.lit(0)) + 1).alias("size"))


def downstream_depth(edges: DataFrame, sources: DataFrame, most: int = 50) -> DataFrame:
    """For every source: the depth of the deepest node that it reaches."""
    starts = sources.select(F.col("node").alias("source"), "node")
    self = starts.select("source", "node")
    got = bfs(edges, starts, most, by=["source"], seen=self)
    d = got.groupBy("source").agg(F.max("depth").alias("d"))
    return sources.select(F.col("node").alias("source")).join(d, "source", "left").select("source", F.coalesce("d", F.lit(0)).cast("long").alias("depth"))


def cap_study(sizes: DataFrame, cap: int, value: str = "size") -> DataFrame:
    """Median, 90th percentile by index, largest, share over the cap. Sizes are counted by value first, so what is ranked
    is bounded by the largest size."""
    v = sizes.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    v = v.withColumn("_upto", F.sum("_n").over(Window.orderBy("_v")))
    every = v.agg(F.sum("_n").alias("n"), F.max("_v").alias("most"), F.coalesce(F.sum(F.when(F.col("_v") > cap, F.col("_n"))), F.lit(0)).alias("over"))
    ranked = v.crossJoin(every)  # one row of totals
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col("_v")))
    n = F.col("n")
    out = ranked.groupBy("n", "most", "over").agg(at(F.floor((n - 1) / 2)).alias("_a"), at(F.floor(n / 2)).alias("_b"), at(F.floor(F.lit(0.9) * (n - 1))).alias("p90"))
    return out.select(((F.col("_a") + F.col("_b")) / 2).alias("median"), "p90", "most", (100.0 * F.col("over") / n).alias("over_pct"))


def called_elsewhere(edges: DataFrame, nodes: DataFrame, rel: str, most: int = 20) -> DataFrame:
    """One row: what functions of a file call in other files, as "name (in file)". Files count as this one if they end
    with its last part; as another if their last part differs."""
    base = rel.rsplit("/", 1)[-1]
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    mine = nodes.filter(F.col("file").endswith(base)).select(F.col("id").alias("src"))
    theirs = nodes.filter(tail("file") != base).select(F.col("id").alias("dst"), F.concat(F.element_at(F.split("id", "::"), -1), F.lit(" (in "), tail("file"), F.lit(")")).alias("callee"))
    met = edges.filter("type = 'calls'").join(mine, "src", "left_semi").join(theirs, "dst").select("callee").distinct()
    return met.orderBy("callee").limit(most).agg(F.array_sort(F.collect_list("callee")).alias("names"))


def neighbour_bodies(edges: DataFrame, nodes: DataFrame, files: DataFrame, rel: str, depth: int = 2, budget: int = 250) -> DataFrame:
    """Functions of other files around a file, nearest first, with numbered bodies, cut to a running budget of lines:
    node, depth, taken, body. The walk goes through functions of other files only."""
    base = rel.rsplit("/", 1)[-1]
    tail = F.element_at(F.split("file", "/"), -1)
    fn = nodes.filter("type = 'function'")
    starts = fn.filter(tail == base).select(F.col("id").alias("node"))
    other = fn.filter(tail != base).select(F.col("id").alias("node"), "file", "line_start", "line_end")
    walk = both_ways(edges).join(other.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    met = bfs(walk, starts, depth).groupBy("node").agg(F.min("depth").alias("depth")).join(other, "node")
    text = met.join(files.select(F.col("rel").alias("file"), split_lines("source").alias("_l")), "file")
    text = text.withColumn("_body", F.slice("_l", F.col("line_start"), F.greatest(F.least(F.col("line_end"), F.size("_l")) - F.col("line_start") + 1, F.lit(0))))
    # No more of the nearest than the budget can hold: each takes a line at least.
    some = text.filter(F.size("_body") > 0).select("node", "depth", "line_start", "_body").orderBy("depth", "node").limit(budget)
    before = F.coalesce(F.sum(F.size("_body")).over(Window.orderBy("depth", "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumn("taken", F.least(F.size("_body"), F.lit(budget) - before)).filter("taken > 0")
    numbered = F.transform(F.slice("_body", F.lit(1), F.col("taken")), lambda l, i: F.concat((F.col("line_start") + i).cast("string"), F.lit(": "), l))
    return some.select("node", "depth", F.col("taken").cast("int").alias("taken"), F.array_join(numbered, "\n").alias("body"))


def edge_chain(edges: DataFrame, nodes: DataFrame, chain: list[str]) -> DataFrame:
    """The edges along a chain of names, as they are in the graph: step, src, dst, type, line."""
    steps = edges.sparkSession.createDataFrame(list(zip(range(len(chain) - 1), chain, chain[1:], strict=False)), "step int, a string, b string")
    named = nodes.select("id", F.coalesce("name", F.element_at(F.split("id", "/"), -1)).alias("n"))
    one, two = (named.select(F.col("id").alias(i), F.col("n").alias(k)) for i, k in (("src", "a"), ("dst", "b")))
    return edges.join(one, "src").join(two, "dst").join(F.broadcast(steps), ["a", "b"]).select("step", "src", "dst", "type", "line")


def keep_relevant(nodes: DataFrame, relevant: list[str]) -> DataFrame:
    """Nodes whose file contains, or ends with, one of the names (a short list from a reviewer)."""
    hit: Column = F.lit(False)
    for r in relevant:
        hit = hit | F.col("file").contains(r)
    return nodes.filter(hit)


def combined(edges: DataFrame, targets: list[str], extra: DataFrame | None = None, depth: int = 2, cap: int = 30) -> DataFrame:
    """Union of the targets' neighbourhoods and further nodes; all nodes if there is none."""
    out = extra.select("node") if extra is not None else None
    for t in targets:
        n = neighborhood(edges, t, depth, cap).select("node")
        out = n if out is None else out.union(n)
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return every if out is None or out.isEmpty() else out.distinct()
