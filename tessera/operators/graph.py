"""Code graphs as two tables and their searches.

nodes(id, type, name, ord) and edges(source, target, relationship). Traversals
join the frontier with the edges level by level. Each level is written to the
shared folder (:func:`tessera.session.stage`), which cuts the lineage and
survives lost executors; frontiers are made distinct before they are joined, so
that a hub is expanded once. Nothing but counts reaches the driver, save the
one answer path of :func:`shortest_path`.

Null endpoints match nothing; an unknown start gives empty results; cycles end
as visited nodes never come back into the frontier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import stage

# Relationships of the second generation.
CALLS, REFERENCES, INSTANTIATES, INHERITS, IMPORTS = "CALLS", "REFERENCES", "INSTANTIATES", "INHERITS", "IMPORTS"
DEFINES, EXPOSES_ROUTE, DECORATED_BY = "DEFINES", "EXPOSES_ROUTE", "DECORATED_BY"


# ---------------------------------------------------------------- building
def _first(df: DataFrame) -> DataFrame:
    """One node an id: the first by ord, then by name."""
    return df.groupBy("id").agg(F.min_by(F.struct("type", "name", "ord"), F.struct("ord", "type", "name")).alias("v")).select("id", "v.type", "v.name", "v.ord")


def _symbol_rows(files: DataFrame, key: str) -> DataFrame:
    """(ord, file, kind, name, owner) of all symbols of the index rows: one
    array of structs by expressions, one explode."""

    def part(column: str, kind: str, name, owner=None, inner: str | None = None) -> Column | None:
        if column not in files.columns:
            return None
        row = lambda x, n: F.struct(F.lit(kind).alias("kind"), n.cast("string").alias("name"), (owner(x) if owner else F.lit(None)).cast("string").alias("owner"))
        kept = F.filter(F.col(column), lambda x: x.isNotNull())
        if inner:  # names in an array of each element
            return F.flatten(F.transform(kept, lambda x: F.transform(F.coalesce(x[inner], F.array().cast("array<string>")), lambda d: row(x, d))))
        return F.transform(kept, lambda x: row(x, name(x)))

    method = lambda x: F.concat_ws(".", x["class_name"], x["name"])
    has = lambda column, field: column in files.columns and field in files.schema[column].dataType.elementType.names
    caller = lambda x: F.when((x["caller"] != "") & (x["caller"] != "<module>"), F.concat(F.lit("function:"), x["caller"]))
    parts = [
        part("classes", "class", lambda x: x["name"]),
        part("functions", "function", lambda x: x["name"]),
        part("methods", "method", method),
        part("routes", "route", lambda x: F.concat_ws(":", x["method"], x["path"])),
        part("imports", "module", lambda x: x["module"]),
        part("calls", "call", lambda x: x["target"], caller),
        part("inherits", "inherit", lambda x: x["parent"], lambda x: x["class_name"]),
        part("instantiations", "instance", lambda x: x["class_name"]),
        part("references", "reference", lambda x: x["symbol"]),
        part("decorators", "decorator", lambda x: x["decorator"]),
        part("functions", "decorator", None, lambda x: F.concat(F.lit("function:"), x["name"]), "decorators") if has("functions", "decorators") else None,
        part("methods", "decorator", None, lambda x: F.concat(F.lit("method:"), method(x)), "decorators") if has("methods", "decorators") else None,
    ]
    none = F.array().cast("array<struct<kind:string,name:string,owner:string>>")
    items = F.concat(F.array(F.struct(F.lit("file").alias("kind"), F.col("file_path").alias("name"), F.lit(None).cast("string").alias("owner"))), *[F.coalesce(p, none) for p in parts if p is not None])
    rows = files.select(F.col(key).alias("ord"), F.concat(F.lit("file:"), F.coalesce("file_path", F.lit(""))).alias("file"), F.explode(items).alias("x")).select("ord", "file", "x.kind", "x.name", "x.owner")
    return rows.filter("name <> ''")


def build_v2(files: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the global-name graph out of symbol-index rows
    (file_path and the arrays of symbols; arrays may be missing). First node of
    an id wins, edges are distinct.

    A call's target is a function, else a method, else a class of that name,
    else an external symbol; a call outside functions comes from its file, all
    others from ``function:<caller>``, as in the index. Parents and
    instantiated classes are classes, whether defined or not. Targets resolve
    against all files at once. Null and empty names make nothing.

    The files are read and exploded once; both tables come of that stage."""
    rows = stage(_symbol_rows(files, key).distinct(), "symbols")
    named = {"file": "FILE", "class": "CLASS", "function": "FUNCTION", "method": "METHOD", "route": "ROUTE", "module": "MODULE", "instance": "CLASS", "reference": "EXTERNAL_SYMBOL", "decorator": "DECORATOR", "inherit": "CLASS"}
    prefix = {"instance": "class", "inherit": "class", "reference": "symbol"}
    pick = lambda table: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in table.items()])
    own = rows.filter(F.col("kind") != "call").withColumn("id", F.concat(pick({k: prefix.get(k, k) for k in named}), F.lit(":"), "name")).withColumn("type", pick(named))
    nodes = own.select("id", "type", "name", "ord").unionByName(own.filter("kind = 'inherit' and owner <> ''").select(F.concat(F.lit("class:"), "owner").alias("id"), F.lit("CLASS").alias("type"), F.col("owner").alias("name"), "ord"))
    relationship = {"class": DEFINES, "function": DEFINES, "method": DEFINES, "route": EXPOSES_ROUTE, "module": IMPORTS, "instance": INSTANTIATES, "reference": REFERENCES, "decorator": DECORATED_BY, "inherit": INHERITS}
    source = F.when(F.col("kind") == "inherit", F.concat(F.lit("class:"), "owner")).when(F.col("kind") == "decorator", F.coalesce("owner", "file")).otherwise(F.col("file"))
    direct = own.filter(F.col("kind") != "file").select(source.alias("source"), F.col("id").alias("target"), pick(relationship).alias("relationship")).filter("source is not null")
    rank = F.when(F.col("type") == "FUNCTION", 1).when(F.col("type") == "METHOD", 2).when(F.col("type") == "CLASS", 3)
    known = nodes.filter(rank.isNotNull()).groupBy("name").agg(F.min_by("id", F.struct(rank.alias("r"), F.col("id").alias("i"))).alias("id"))
    wanted = rows.filter("kind = 'call'").groupBy(F.col("name").alias("to"), F.coalesce("owner", "file").alias("source")).agg(F.min("ord").alias("ord"))
    resolved = wanted.join(known, wanted["to"] == known["name"], "left").select("ord", "to", "source", F.coalesce("id", F.concat(F.lit("symbol:"), F.col("to"))).alias("target"))
    external = resolved.filter(F.col("target").startswith("symbol:")).select(F.col("target").alias("id"), F.lit("EXTERNAL_SYMBOL").alias("type"), F.col("to").alias("name"), "ord")
    edges = direct.distinct().unionByName(resolved.select("source", "target", F.lit(CALLS).alias("relationship")).distinct())
    return _first(nodes.unionByName(external)), edges


def build_v3(calls: DataFrame) -> DataFrame:
    """Edges of the third generation: calls between ``Class.method`` names only,
    with their files; there are no nodes but the edges' ends."""
    return calls.select(F.col("caller_symbol").alias("source"), F.col("callee_symbol").alias("target"), F.lit(CALLS).alias("relationship"), "caller_file", "callee_file", "line_number")


def build_v1(tree: DataFrame, symbols: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File-scoped graph: ``tree(path, node_type, name)``, ``symbols(file_path,
    kind, class_name, name, method, route_path)``, ``imports(source, target)``.
    Nodes last-wins by id; edges are kept as often as they occur."""
    sid = (
        F.when(F.col("kind") == "method", F.concat_ws("::", "file_path", F.lit("method"), F.concat_ws(".", "class_name", "name")))
        .when(F.col("kind") == "route", F.concat_ws("::", "file_path", F.lit("route"), "method", "route_path"))
        .otherwise(F.concat_ws("::", "file_path", "kind", "name"))
    )
    named = symbols.select(sid.alias("id"), F.col("kind").alias("type"), F.when(F.col("kind") == "route", F.col("route_path")).otherwise(F.col("name")).alias("name"), "file_path")
    nodes = tree.select(F.col("path").alias("id"), F.col("node_type").alias("type"), "name").unionByName(named.select("id", "type", "name"))
    nodes = nodes.groupBy("id").agg(F.max(F.struct("type", "name")).alias("v")).select("id", "v.type", "v.name")
    edges = named.select(F.col("file_path").alias("source"), F.col("id").alias("target"), F.when(F.col("type") == "route", "exposes_route").otherwise("defines").alias("relationship"))
    return nodes, edges.unionByName(imports.select("source", "target", F.lit("imports").alias("relationship")))


# ---------------------------------------------------------------- lookups
def first_wins(nodes: DataFrame) -> DataFrame:
    """One node a name: the first, but anything before an external symbol."""
    w = Window.partitionBy("name").orderBy(F.col("type") == "EXTERNAL_SYMBOL", "ord", "id")
    return nodes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def find_node(nodes: DataFrame, name: str) -> DataFrame:
    return first_wins(nodes.filter(F.col("name") == name))


def search_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose name contains the text, whatever its case."""
    return nodes.filter(F.contains(F.lower("name"), F.lit(text.lower())))


def find_v1(nodes: DataFrame, name: str, kind: str) -> DataFrame:
    """Nodes of the first generation: ``file`` and ``symbol`` by their names in
    any case, ``route`` by its exact path, ``id`` by the first of that id."""
    low = F.lower("name") == name.lower()
    if kind == "file":
        return nodes.filter((F.lower("type") == "file") & low)
    if kind == "symbol":
        return nodes.filter(F.lower("type").isin("class", "function", "method") & low)
    if kind == "route":
        return nodes.filter((F.lower("type") == "route") & (F.col("name") == name))
    return nodes.filter(F.col("id") == name).orderBy("id", "name").limit(1)


def typed_id(kind: Column, path: Column, name: Column, owner: Column | None = None) -> Column:
    """Identifiers of typed nodes: the path itself, ``f::class::n``,
    ``f::method::C.m``, ``f::route::VERB::path``, ``dependency::module``."""
    owner = F.lit(None).cast("string") if owner is None else owner
    return (
        F.when(kind == "file", path)
        .when(kind == "dependency", F.concat_ws("::", F.lit("dependency"), name))
        .when(kind == "method", F.concat_ws("::", path, F.lit("method"), F.concat_ws(".", owner, name)))
        .when(kind == "route", F.concat_ws("::", path, F.lit("route"), owner, name))
        .otherwise(F.concat_ws("::", path, kind, name))
    )


def projection(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, id, document) of all nodes and edges as JSON, for export."""
    n = nodes.select(F.lit("node").alias("what"), "id", F.to_json(F.struct("id", "type", "name")).alias("document"))
    return n.unionByName(edges.select(F.lit("edge").alias("what"), F.concat_ws("|", "source", "relationship", "target").alias("id"), F.to_json(F.struct("source", "target", "relationship")).alias("document")))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): nodes and edges by type and relationship."""
    return nodes.groupBy(F.concat(F.lit("node "), F.upper("type")).alias("what")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.concat(F.lit("edge "), F.upper("relationship")).alias("what")).agg(F.count("*").alias("n")))


def neighbours(nodes: DataFrame, edges: DataFrame, relationships: list[str] | None = None, *, incoming: bool = False) -> DataFrame:
    """(from_id, id, type, name, relationship); dangling ends are dropped."""
    a, b = ("target", "source") if incoming else ("source", "target")
    e = edges if relationships is None else edges.filter(F.col("relationship").isin(relationships))
    return e.select(F.col(a).alias("from_id"), F.col(b).alias("id"), "relationship").join(nodes.select("id", "type", "name"), "id").select("from_id", "id", "type", "name", "relationship")


def impact_all(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, section, name) of one-hop callers, callees, dependencies and
    dependents of many starts (start: node id): one join of the edges a side."""
    out = None
    for sections, incoming in ((("callees", "dependencies"), False), (("callers", "dependents"), True)):
        near = neighbours(nodes, edges, incoming=incoming).join(starts.select(F.col("start").alias("from_id")).distinct(), "from_id", "left_semi")
        which = F.when(F.col("relationship") == CALLS, F.array(*[F.lit(x) for x in sections])).otherwise(F.array(F.lit(sections[1])))
        part = near.select(F.col("from_id").alias("start"), F.explode(which).alias("section"), "name")
        out = part if out is None else out.unionByName(part)
    return out


def impact(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(section, name) of one name's one-hop neighbourhood."""
    return impact_all(nodes, edges, find_node(nodes, name).select(F.col("id").alias("start"))).select("section", "name")


def impact_v3(edges: DataFrame, name: str) -> DataFrame:
    """(section, name, ord) over the call edges alone: callers and callees, and
    all that depends on the name, whatever the distance."""
    one = edges.sparkSession.createDataFrame([(name,)], "start string")
    near = lambda a, b, s: edges.filter(F.col(a) == name).select(F.lit(s).alias("section"), F.col(b).alias("name"), F.lit(1).alias("ord")).distinct()
    up = reach(edges, one, None, incoming=True).select(F.lit("dependents").alias("section"), F.col("id").alias("name"), F.col("depth").cast("int").alias("ord"))
    return near("target", "source", "callers").unionByName(near("source", "target", "callees")).unionByName(up)


def definition_index(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """Each defined name with its last definition and its number of references."""
    last = definitions.groupBy("name").agg(F.max_by(F.struct("type", "file", "line"), F.struct(F.lower("file"), "file", "line")).alias("d"))
    refs = references.groupBy("name").agg(F.count("*").alias("n_refs"), F.countDistinct("file").alias("n_files"))
    zero = F.lit(0).cast("bigint")
    return last.join(refs, "name", "left").select("name", "d.type", "d.file", "d.line", F.coalesce("n_refs", zero).alias("n_refs"), F.coalesce("n_files", zero).alias("n_files"))


def longest_prefix(imports: DataFrame, modules: DataFrame, module: str = "module", sep: str = ".") -> DataFrame:
    """Imports with the file of the longest known prefix of their module:
    candidates by length, one equality join, the longest kept. Rows that
    resolve to nothing have a null file. ``imports`` needs a unique ``row_id``;
    distinct modules are resolved once."""
    names = imports.select(module).filter(f"{module} <> ''").distinct()
    parts = F.split(module, "\\" + sep if sep in ".|/" else sep)
    steps = names.select(module, F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), parts.alias("p"))
    tried = steps.select(module, "n", F.array_join(F.slice("p", F.lit(1), F.col("n")), sep).alias("prefix"))
    best = tried.join(modules.select(F.col("name").alias("prefix"), "file"), "prefix").groupBy(module).agg(F.max_by("file", F.struct("n", "file")).alias("file"))
    return imports.join(best, module, "left")


# ---------------------------------------------------------------- traversal
def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = 10, relationships: list[str] | None = None, *, incoming: bool = False, seeded: bool = True) -> DataFrame:
    """(start, id, depth) of all nodes reached from each start, the start
    itself left out (``seeded=False`` lists a start that lies on a cycle).

    ``starts(start)`` may hold many starts at once: they share every level's
    join. ``max_depth=None`` runs until nothing new turns up."""
    a, b = ("target", "source") if incoming else ("source", "target")
    e = edges if relationships is None else edges.filter(F.col("relationship").isin(relationships))
    e = e.select(F.col(a).alias("id"), F.col(b).alias("to")).filter("id is not null and to is not null").distinct()
    frontier = starts.select("start", F.col("start").alias("id")).distinct()
    seen = frontier if seeded else frontier.limit(0)
    found, depth = None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.join(e, "id").select("start", F.col("to").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")
        new = stage(new.withColumn("depth", F.lit(depth)), f"reach-{depth}")
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        frontier = new.select("start", "id")
        seen = seen.unionByName(frontier)
    return found if found is not None else starts.sparkSession.createDataFrame([], "start string, id string, depth int")


def shortest_path(edges: DataFrame, start: str, target: str, max_depth: int = 50) -> list[str]:
    """Nodes of a shortest path, ties by the smallest predecessor; [start] if
    both are one; [] if there is none. One path, so it may go to the driver."""
    if start == target:
        return [start]
    spark = edges.sparkSession
    e = edges.select(F.col("source").alias("id"), F.col("target").alias("to")).filter("id is not null and to is not null").distinct()
    frontier = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    seen = frontier.select("id")
    for depth in range(max_depth):
        step = frontier.join(e, "id").groupBy("to").agg(F.min_by("path", "id").alias("path"))
        new = step.join(seen, step["to"] == seen["id"], "left_anti").select(F.col("to").alias("id"), F.concat("path", F.array("to")).alias("path"))
        new = stage(new, f"path-{depth}")
        hit = new.filter(F.col("id") == target).select("path").take(1)
        if hit:
            return list(hit[0][0])
        if new.isEmpty():
            return []
        frontier, seen = new, seen.unionByName(new.select("id"))
    return []


def path_lengths(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, target, length) of shortest paths from each start to each target
    that it reaches; a start that is a target has length 0."""
    got = reach(edges, starts, max_depth).select("start", F.col("id").alias("target"), F.col("depth").cast("bigint").alias("length"))
    own = starts.select("start", F.col("start").alias("target"), F.lit(0).cast("bigint").alias("length")).distinct()
    return got.unionByName(own).join(targets.select("target").distinct(), "target", "left_semi").select("start", "target", "length")


def depth_first(edges: DataFrame, starts: DataFrame, max_depth: int = 10) -> DataFrame:
    """(start, id, path, depth): what each start reaches within ``max_depth``
    steps, each node with the path that comes first when siblings are taken in
    the order of their names; ordered by ``path`` it is the order of a search
    that goes to the depth first. A path is kept only while no earlier one to
    its node is known, so that a node has one row."""
    e = edges.select(F.col("source").alias("id"), F.col("target").alias("to")).filter("id is not null and to is not null").distinct()
    frontier = starts.select("start", F.col("start").alias("id"), F.array("start").alias("path")).distinct()
    best, depth = None, 0
    while depth < max_depth:
        depth += 1
        step = frontier.join(e, "id").filter(~F.array_contains("path", F.col("to")))
        new = step.groupBy("start", F.col("to").alias("id")).agg(F.min(F.concat("path", F.array("to"))).alias("path"))
        if best is not None:
            old = best.select(F.col("start").alias("s"), F.col("id").alias("i"), F.col("path").alias("p"))
            new = new.join(old, (F.col("start") == F.col("s")) & (F.col("id") == F.col("i")), "left").filter("p is null or path < p").select("start", "id", "path")
        new = stage(new, f"depth-{depth}")
        if new.isEmpty():
            break
        both = new if best is None else best.unionByName(new)
        best = stage(both.groupBy("start", "id").agg(F.min("path").alias("path")), f"first-{depth}")
        frontier = new
    empty = starts.sparkSession.createDataFrame([], "start string, id string, path array<string>")
    return (empty if best is None else best).withColumn("depth", F.size("path") - 1)


def file_closure(edges: DataFrame, starts: DataFrame, *, incoming: bool = False) -> DataFrame:
    """(start, file): all files that a file needs (``incoming``: that a change
    of it affects). A file on a cycle is listed as its own."""
    return reach(edges, starts, None, incoming=incoming, seeded=False).select("start", F.col("id").alias("file"))


def dependency_summary(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, direct_dependencies, direct_dependents, affected_files,
    dependency_depth): how many of each; the files themselves are rows of
    :func:`neighbours` and :func:`file_closure`."""
    e = edges.select("source", "target").filter("source is not null and target is not null").distinct()
    number = lambda df, key, name: df.groupBy(F.col(key).alias("start")).agg(F.count("*").alias(name))
    out = starts.select("start").distinct()
    for df, key, name in ((e, "source", "direct_dependencies"), (e, "target", "direct_dependents"), (file_closure(e, starts, incoming=True), "start", "affected_files")):
        out = out.join(number(df, key, name), "start", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out.join(dependency_depth(e, starts), "start").withColumnRenamed("depth", "dependency_depth")


def has_path(edges: DataFrame, start: str, target: str) -> bool:
    return bool(shortest_path(edges, start, target))


def inheritance(edges: DataFrame, starts: DataFrame, depth: int = 100) -> DataFrame:
    """(start, id, side, depth): ancestors, then descendants not met before."""
    up = reach(edges, starts, depth, [INHERITS]).withColumn("side", F.lit("parent"))
    down = reach(edges, starts, depth, [INHERITS], incoming=True).withColumn("side", F.lit("child"))
    return up.unionByName(down.join(up.select("start", "id"), ["start", "id"], "left_anti"))


def route_trace(nodes: DataFrame, edges: DataFrame, method: str, path: str, depth: int = 10) -> DataFrame:
    """What a route executes: calls, references and instantiations."""
    starts = find_node(nodes, f"{method}:{path}").select(F.col("id").alias("start"))
    return reach(edges, starts, depth, [CALLS, REFERENCES, INSTANTIATES])


def dependency_depth(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, depth): the highest level that a search from the start meets."""
    got = reach(edges, starts, max_depth).groupBy("start").agg(F.max("depth").alias("depth"))
    return starts.select("start").distinct().join(got, "start", "left").select("start", F.coalesce("depth", F.lit(0)).alias("depth"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(source, targets, n): distinct targets in order; a hub's list is as long
    as its degree, so traversals use the edge table instead."""
    return edges.groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.countDistinct("target").alias("n"))


def type_counts(nodes: DataFrame, column: Column | str = "type") -> DataFrame:
    return nodes.groupBy(F.upper(column).alias("type")).agg(F.count("*").alias("n"))
