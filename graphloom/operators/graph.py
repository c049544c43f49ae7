"""Dependency graph: registration, name resolution, edges, and summaries.

Nodes: id, type, name, qualified_name, file, ord. Edges: src, dst, type, module, name, line; one row a (src, dst).
Order-dependent rules (first or last definition wins) use explicit ordinals, never row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winner(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in that order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def register(files: DataFrame, functions: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of files, functions and classes, and who contains whom. Ids that collide keep the last attributes and the
    first position."""
    common = ["id", "type", "name", "qualified_name", "file", "line_start", "line_end", "ord"]
    none = [F.lit(None).cast("int").alias(c) for c in ("line_start", "line_end")]
    f = files.select(F.concat(F.lit("file:"), "rel").alias("id"), F.lit("file").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("qualified_name"), F.col("rel").alias("file"), *none, F.struct("file_ord", F.lit(0).alias("kind"), F.lit(0).alias("at")).alias("ord"))
    fn = functions.select(F.concat(F.lit("func:"), "rel", F.lit("::"), "qualified_name").alias("id"), F.lit("function").alias("type"), "name", "qualified_name", F.col("rel").alias("file"), "line_start", "line_end", F.struct("file_ord", F.lit(1).alias("kind"), F.col("ord").cast("int").alias("at")).alias("ord"))
    cl = classes.select(F.concat(F.lit("class:"), "rel", F.lit("::"), "name").alias("id"), F.lit("class").alias("type"), "name", F.col("name").alias("qualified_name"), F.col("rel").alias("file"), "line_start", "line_end", F.struct("file_ord", F.lit(2).alias("kind"), F.col("ord").cast("int").alias("at")).alias("ord"))
    every = f.select(*common).unionByName(fn.select(*common)).unionByName(cl.select(*common))
    last = [F.max_by(c, "ord").alias(c) for c in common[1:-1]]
    nodes = every.groupBy("id").agg(*last, F.min("ord").alias("ord"))
    contains = every.filter("type != 'file'").select(F.concat(F.lit("file:"), "file").alias("src"), F.col("id").alias("dst")).distinct()
    return nodes, contains.withColumn("type", F.lit("contains"))


def module_index(files: DataFrame) -> DataFrame:
    """Names under which a file can be imported: stem and dotted path (Python), last file wins."""
    bare = F.regexp_replace("rel", r"\.[^./]+$", "")
    stem = F.element_at(F.split(bare, "/"), -1)
    dotted = F.array_join(F.filter(F.split(bare, "/"), lambda p: ~p.isin(".", "..")), ".")
    keys = F.array(F.struct(F.lit(0).alias("k"), F.when(stem != "__init__", stem).alias("module")), F.struct(F.lit(1).alias("k"), F.when(F.col("language") == "python", dotted).alias("module")))
    rows = files.select("rel", "file_ord", F.explode(keys).alias("m")).select("rel", "file_ord", "m.k", "m.module").filter("module is not null")
    return winner(rows, ["module"], [F.desc("file_ord"), F.desc("k")]).select("module", "rel")


def longest_prefix(names: DataFrame, index: DataFrame, name: str = "name", key: str = "module", value: str = "rel", sep: str = ".") -> DataFrame:
    """Each name with the entry of its longest prefix (of whole segments) in the index; no row if there is none."""
    parts = F.split(name, f"[{sep}]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("_p", F.lit(1), n), sep).alias("key")))
    steps = names.select(name).distinct().withColumn("_p", parts).withColumn("_k", F.explode(prefixes)).select(name, "_k.n", F.col("_k.key").alias("_key"))
    found = steps.join(index.select(F.col(key).alias("_key"), F.col(value).alias("_value")), "_key")
    return found.groupBy(name).agg(F.max_by("_value", "n").alias(value), F.max("n").alias("segments"))


def function_index(functions: DataFrame) -> DataFrame:
    """Short and qualified names in one namespace, last definition wins."""
    keys = F.array(F.struct(F.lit(0).alias("k"), F.col("name").alias("key")), F.struct(F.lit(1).alias("k"), F.col("qualified_name").alias("key")))
    rows = functions.withColumn("_k", F.explode(keys)).select("_k.k", "_k.key", "id", "file_ord", "ord")
    return winner(rows, ["key"], [F.desc("file_ord"), F.desc("ord"), F.desc("k")]).select("key", "id")


def resolve_calls(calls: DataFrame, index: DataFrame, name: str = "name", key: str = "key", value: str = "id") -> DataFrame:
    """Calls with their target: the exact name, else the last dotted segment."""
    whole = index.select(F.col(key).alias(name), F.col(value).alias("_whole"))
    tail = index.select(F.col(key).alias("_tail"), F.col(value).alias("_last"))
    last = F.when(F.col(name).contains("."), F.substring_index(name, ".", -1))
    return calls.withColumn("_tail", last).join(whole, name, "left").join(tail, "_tail", "left").withColumn("target", F.coalesce("_whole", "_last")).drop("_tail", "_whole", "_last")


def call_edges(resolved: DataFrame) -> DataFrame:
    """One edge a (caller, callee), the line of the last call; calls to oneself are left out."""
    e = resolved.filter("target is not null and target != caller")
    return e.groupBy(F.col("caller").alias("src"), F.col("target").alias("dst")).agg(F.max_by("line", "ord").alias("line")).withColumn("type", F.lit("calls"))


def import_edges(imports: DataFrame, index: DataFrame) -> DataFrame:
    """File to file: the module itself, then each module.name, else the bare name. The last import names the edge."""
    base = imports.select("rel", "module", F.explode_outer("names").alias("name"), "ord")
    asked = base.select(F.col("module").alias("q")).union(base.select(F.concat_ws(".", "module", "name"))).union(base.select("name")).filter("q is not null and q != ''").distinct()
    known = longest_prefix(asked.withColumnRenamed("q", "name"), index).select(F.col("name").alias("q"), F.col("rel").alias("to"))
    by_module = base.join(known.withColumnRenamed("q", "module"), "module").select("rel", "to", "module", F.lit(None).cast("string").alias("name"), F.struct("ord", F.lit(0).alias("k")).alias("ord"))
    full = known.select(F.col("q").alias("full"), F.col("to").alias("a"))
    short = known.select(F.col("q").alias("name"), F.col("to").alias("b"))
    by_name = base.filter("name is not null").withColumn("full", F.when(F.col("module") == "", F.col("name")).otherwise(F.concat_ws(".", "module", "name"))).join(full, "full", "left").join(short, "name", "left")
    by_name = by_name.withColumn("to", F.coalesce("a", "b")).filter("to is not null").select("rel", "to", "module", "name", F.struct("ord", F.lit(1).alias("k")).alias("ord"))
    every = by_module.unionByName(by_name)
    agg = every.groupBy(F.concat(F.lit("file:"), "rel").alias("src"), F.concat(F.lit("file:"), "to").alias("dst")).agg(F.max_by("module", "ord").alias("module"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("ord"))).alias("name"))
    return agg.withColumn("type", F.lit("imports"))


def build(files: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of parsed files; a later edge type overwrites an earlier one of the same pair. Calls are those of
    functions; what a file calls outside them makes no edge."""
    nodes, contains = register(files, functions, classes)
    fns = functions.withColumn("id", F.concat(F.lit("func:"), "rel", F.lit("::"), "qualified_name"))
    caller = F.concat(F.lit("func:"), "rel", F.lit("::"), "owner")
    called = resolve_calls(calls.filter("owner is not null").withColumn("caller", caller), function_index(fns))
    null = lambda t: F.lit(None).cast(t)
    parts = [
        contains.select("src", "dst", "type", null("string").alias("module"), null("string").alias("name"), null("int").alias("line"), F.lit(0).alias("k")),
        import_edges(imports, module_index(files)).select("src", "dst", "type", "module", "name", null("int").alias("line"), F.lit(1).alias("k")),
        call_edges(called).select("src", "dst", "type", null("string").alias("module"), null("string").alias("name"), F.col("line").cast("int").alias("line"), F.lit(2).alias("k")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    edges = every.groupBy("src", "dst").agg(F.max_by("type", "k").alias("type"), F.max("module").alias("module"), F.max("name").alias("name"), F.max("line").alias("line"))
    return nodes, edges


def of_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of source files (rel, language, source, lines, file_ord)."""
    from ..functions import extract
    from ..plans.lineage import cut

    p = cut(extract.parsed(files))
    return build(p, extract.functions(p), extract.classes(p), extract.imports(p), extract.function_calls(p))


def relative(nodes: DataFrame, edges: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Ids and files of a graph built on absolute paths, as seen from a root."""
    head = root.rstrip("/") + "/"
    cutoff = lambda c: F.replace(F.col(c), F.lit(head), F.lit(""))
    file = F.when(F.col("file").startswith(head), F.substring("file", len(head) + 1, 1 << 30)).otherwise(F.col("file"))
    return nodes.withColumn("id", cutoff("id")).withColumn("file", file), edges.withColumn("src", cutoff("src")).withColumn("dst", cutoff("dst"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes and edges by type and in all."""
    n = nodes.agg(F.count("*").alias("nodes"), *(F.count_if(F.col("type") == t).alias(f"{t}_nodes") for t in ("file", "function", "class")))
    e = edges.agg(F.count("*").alias("edges"), *(F.count_if(F.col("type") == t).alias(f"{t}_edges") for t in ("contains", "imports", "calls")))
    return n.join(e)  # one row each


def hotspots(nodes: DataFrame, edges: DataFrame, top: int = 15, kind: str = "calls") -> DataFrame:
    """The most called nodes: in-degree descending, ties by id."""
    degree = edges.filter(F.col("type") == kind).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return degree.join(nodes, "id").orderBy(F.desc("in_degree"), "id").limit(top).select("id", "name", "in_degree")


def file_tree(files: DataFrame) -> DataFrame:
    parent = F.regexp_extract("rel", r"^(.*)/[^/]*$", 1)
    return files.groupBy(parent.alias("parent")).agg(F.array_sort(F.collect_list(F.element_at(F.split("rel", "/"), -1))).alias("names"))


def edge_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def summary(nodes: DataFrame, edges: DataFrame, functions: int = 20, classes: int = 10) -> DataFrame:
    """Counts, the first names of each kind by position, and edge types."""
    names = lambda t, k: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("ord", "name")))), lambda x: x["name"]), 1, k)
    n = nodes.agg(F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") == "function").alias("functions"), F.count_if(F.col("type") == "class").alias("classes"), names("function", functions).alias("function_names"), names("class", classes).alias("class_names"))
    e = edges.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("edge_types"))
    return n.join(e)


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph for a viewer, one JSON object a row: nodes with label and type, then edges. A label is the name, else the
    qualified name; a file's is its path, any other node's its id."""
    label = F.coalesce(F.nullif("name", F.lit("")), F.nullif("qualified_name", F.lit("")), F.when(F.col("type") == "file", F.col("file")), F.col("id"))
    n = nodes.select(F.lit("node").alias("kind"), "id", F.to_json(F.struct("id", label.alias("label"), "type", "file")).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.concat("src", F.lit(" "), "dst").alias("id"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type")).alias("json"))
    return n.unionByName(e)


def to_html(nodes: DataFrame, edges: DataFrame, target: str | None = None, most: int = 500) -> str:
    """A page that draws a graph of at most so many nodes (nearest the front by id order); its layout runs in the viewer.
    Only the drawn part comes to the driver."""
    some = nodes.orderBy("id").limit(most)
    ids = some.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    rows = json_rows(some, inner).select("kind", "json").limit(most * 20).collect()
    part = lambda kind: "[" + ",".join(r.json.replace("</", "<\\/") for r in rows if r.kind == kind) + "]"
    return (
        "<!doctype html><meta charset=utf-8><title>graph</title><canvas id=c width=1200 height=900></canvas><script>"
        f"const nodes={part('node')},edges={part('edge')},target={__import__('json').dumps(target)};"
        "const at=new Map(nodes.map((n,i)=>[n.id,{x:600+400*Math.cos(i*2.4),y:450+300*Math.sin(i*2.4)}]));"
        "for(let k=0;k<300;k++){for(const e of edges){const a=at.get(e.source),b=at.get(e.target),dx=b.x-a.x,dy=b.y-a.y,d=Math.hypot(dx,dy)||1,f=(d-90)*.01;a.x+=dx/d*f;a.y+=dy/d*f;b.x-=dx/d*f;b.y-=dy/d*f}"
        "const p=[...at.values()];for(let i=0;i<p.length;i++)for(let j=0;j<i;j++){const dx=p[i].x-p[j].x,dy=p[i].y-p[j].y,d=dx*dx+dy*dy+1;if(d<9000){p[i].x+=dx/d*30;p[i].y+=dy/d*30;p[j].x-=dx/d*30;p[j].y-=dy/d*30}}}"
        "const g=document.getElementById('c').getContext('2d');g.strokeStyle='#999';for(const e of edges){const a=at.get(e.source),b=at.get(e.target);g.beginPath();g.moveTo(a.x,a.y);g.lineTo(b.x,b.y);g.stroke()}"
        "for(const n of nodes){const p=at.get(n.id);g.fillStyle=n.id===target?'#c00':'#036';g.beginPath();g.arc(p.x,p.y,5,0,7);g.fill();g.fillText(n.label,p.x+7,p.y+3)}</script>"
    )
