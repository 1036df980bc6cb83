"""Evidence packages, repository contexts and the answers and prompts made of
them, as long tables (section, ord, value)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators import graph, ranking

# Most items of a prompt's sections, and its last section.
MOST = {"files": 20, "symbols": 30, "dependencies": 50, "call_chains": 20}
INSTRUCTIONS = "INVESTIGATION INSTRUCTIONS\n\nUse the supplied repository intelligence.\n\nReason using:\n- execution paths\n- dependency relationships\n- route traces\n- collected evidence\n\nDo not speculate beyond the provided context."


def package_v1(nodes: DataFrame, references: DataFrame, ranked: DataFrame, issue: str, *, files: int = 20, symbols: int = 25, routes: int = 10, uses: int = 50) -> DataFrame:
    """(section, ord, value): best files, nodes whose name holds the issue, and
    the references of the symbols among them."""
    hits = ranking.node_relevance(graph.search_nodes(nodes, issue), issue)
    kind = F.when(F.lower("type") == "route", "routes").when(F.lower("type").isin("class", "function", "method"), "symbols")
    rows = hits.withColumn("section", kind).filter("section is not null").select("section", "name", "score").distinct()
    top = ranking.top_per_group(rows, "section", [F.desc("score"), F.lower("name"), F.col("name")], symbols).filter((F.col("section") == "symbols") | (F.col("rank") <= routes))
    chosen = top.filter("section = 'symbols'").select("name").distinct()
    refs = references.join(chosen, "name", "left_semi").select("file", "line", "name").distinct().orderBy("file", "line", "name").limit(uses)
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("file", "line", "name"))  # of at most ``uses`` rows
    parts = ranked.limit(files).select(F.lit("files").alias("section"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "file_path")).alias("ord"), F.col("file_path").alias("value"))
    parts = parts.unionByName(top.select("section", F.col("rank").alias("ord"), F.col("name").alias("value")))
    return parts.unionByName(refs.select(F.lit("references").alias("section"), order.alias("ord"), F.concat_ws(":", "file", "line", "name").alias("value")))


def repository_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 10) -> DataFrame:
    """(section, name, value, ord) around seed symbols (name): the node, its
    callers, callees, dependencies, and the symbols of its call chain."""
    at = graph.first_wins(nodes).join(seeds.select("name").distinct(), "name", "left_semi").select(F.col("id").alias("from_id"), F.col("name").alias("seed"), "type")
    out = at.select(F.lit("symbols").alias("section"), F.col("seed").alias("name"), F.col("type").alias("value"), F.lit(0).alias("ord"))
    for section, rel, incoming in (("callers", [graph.CALLS], True), ("callees", [graph.CALLS], False), ("dependencies", None, False)):
        got = graph.neighbours(nodes, edges, rel, incoming=incoming).join(at.select("from_id", "seed"), "from_id")
        out = out.unionByName(got.select(F.lit(section).alias("section"), F.col("seed").alias("name"), F.col("name").alias("value"), F.lit(0).alias("ord")).distinct())
    chain = graph.reach(edges, at.select(F.col("from_id").alias("start")), depth, [graph.CALLS])
    named = chain.join(nodes.select("id", F.col("name").alias("value")), "id").join(at.select(F.col("from_id").alias("start"), "seed"), "start")
    return out.unionByName(named.select(F.lit("call_chains").alias("section"), F.col("seed").alias("name"), "value", F.col("depth").cast("int").alias("ord")).distinct())


def investigation_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, issue: str, routes: list[str] = (), depth: int = 10) -> DataFrame:
    """(section, source, target, relationship, ord) around seed symbols (name):
    dependencies, calls in both directions, call chains, and the routes given or
    named in the issue with what they execute. Chains list (start, node, depth)."""
    at = graph.first_wins(nodes).join(seeds.select("name").distinct(), "name", "left_semi").select(F.col("id").alias("from_id"), F.col("name").alias("seed"))
    row = lambda df, section, source, target, rel, ord_=0: df.select(F.lit(section).alias("section"), source.alias("source"), target.alias("target"), F.lit(rel).alias("relationship"), (F.lit(ord_) if isinstance(ord_, int) else ord_).cast("int").alias("ord"))
    seed, name = F.col("seed"), F.col("name")
    deps = graph.neighbours(nodes, edges).join(at, "from_id")
    callers = graph.neighbours(nodes, edges, [graph.CALLS], incoming=True).join(at, "from_id")
    calls = deps.filter(F.col("relationship") == graph.CALLS)
    out = row(at, "symbols", seed, seed, "").unionByName(row(deps, "dependencies", seed, name, "DEPENDS_ON")).unionByName(row(callers, "dependencies", name, seed, "CALLS")).unionByName(row(calls, "dependencies", seed, name, "CALLS"))
    chain = graph.reach(edges, at.select(F.col("from_id").alias("start")), depth, [graph.CALLS])
    named = chain.join(nodes.select("id", "name"), "id").join(at.withColumnRenamed("from_id", "start"), "start")
    out = out.unionByName(row(named, "call_chains", seed, name, "CALLS", F.col("depth")))
    mentioned = [f"{m.upper()}:{p}" for m, p in re.findall(r"(?i)\b(GET|POST|PUT|PATCH|DELETE)\s+(/[/\w\-]*)", issue)]
    wanted = [r if ":" in r else r.replace(" ", ":", 1) for r in (*routes, *mentioned)]
    if wanted:
        starts = graph.first_wins(nodes.filter(F.col("name").isin(wanted))).select(F.col("id").alias("start"), F.col("name").alias("route"))
        traced = graph.reach(edges, starts.select("start"), 10, [graph.CALLS, graph.REFERENCES, graph.INSTANTIATES]).join(nodes.select("id", "name"), "id").join(starts, "start")
        known = edges.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(wanted)], "route string")
        out = out.unionByName(row(known, "routes", F.col("route"), F.col("route"), "")).unionByName(row(traced, "route_chains", F.col("route"), name, "", F.col("depth")))
    return out.distinct()


def answer(query: str, context: DataFrame, routes: list[str] = ()) -> tuple[str, float]:
    """(text, confidence) out of a context: a symbol for where-questions, else a
    route, else a dependency."""
    low = query.lower()
    if any(w in low for w in ("where", "handled", "implemented", "find")):
        s = context.filter("section = 'symbols'").orderBy("name").take(1)
        if s:
            return f"{s[0]['name']} is present in the repository as a {s[0]['value'].lower()}.", 0.90
    if routes:
        return f"Route {routes[0]} was identified and traced through the repository graph.", 0.85
    d = context.filter("section = 'dependencies'").orderBy("name", "value").take(1)
    if d:
        return f"{d[0]['name']} depends on {d[0]['value']}.", 0.80
    return "No repository intelligence was found for the query.", 0.0


def retrieve(nodes: DataFrame, edges: DataFrame, query: str, routes: list[str] = ()) -> DataFrame:
    """(section, value): nodes named by a word of the query, and what the routes
    (METHOD:path) execute; sorted and distinct, no vectors."""
    words = [w for w in query.split() if w]
    hit = graph.first_wins(nodes.filter(F.col("name").isin(words or ["\x00"]))).select(F.when(F.col("type") == "ROUTE", "routes").otherwise("symbols").alias("section"), F.col("name").alias("value"))
    starts = nodes.filter(F.col("name").isin(list(routes) or ["\x00"])).select(F.col("id").alias("start"))
    traced = graph.reach(edges, starts, 10, [graph.CALLS, graph.REFERENCES, graph.INSTANTIATES]).join(nodes, "id").select(F.lit("symbols").alias("section"), F.col("name").alias("value"))
    named = nodes.filter(F.col("name").isin(list(routes) or ["\x00"])).select(F.lit("routes").alias("section"), F.col("name").alias("value"))
    return hit.unionByName(traced).unionByName(named).distinct().orderBy("section", "value")


def prompt_v2(issue: Column, files: Column, symbols: Column, dependencies: Column, chains: Column, routes: Column, facts: Column, hypotheses: Column) -> Column:
    """The context prompt: array columns with the most items of each section;
    empty sections are left out. dependencies: array<struct<source, target>>,
    chains: array<array<string>>."""
    dashes = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n")
    part = lambda title, xs, body: F.when(F.size(xs) > 0, F.concat(F.lit(f"{title}\n\n"), body))
    deps = F.slice(dependencies, 1, MOST["dependencies"])
    links = F.array_join(F.transform(F.filter(deps, lambda d: (d["source"] != "") & (d["target"] != "")), lambda d: F.concat(d["source"], F.lit("\n  -> "), d["target"])), "\n\n")
    paths = F.array_join(F.transform(F.slice(chains, 1, MOST["call_chains"]), lambda c: F.array_join(c, "\n ↓\n")), "\n\n")
    numbered = F.array_join(F.transform(hypotheses, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    fs, ss = F.slice(files, 1, MOST["files"]), F.slice(symbols, 1, MOST["symbols"])
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("INVESTIGATION ISSUE\n\n"), issue),
        part("RELEVANT FILES", fs, dashes(fs)),
        part("RELEVANT SYMBOLS", ss, dashes(ss)),
        part("DEPENDENCIES", deps, links),
        part("EXECUTION PATHS", chains, paths),
        part("ROUTE CONTEXT", routes, F.array_join(routes, "\n")),
        part("FACTS", facts, dashes(facts)),
        part("HYPOTHESES", hypotheses, numbered),
        F.lit(INSTRUCTIONS),
    )
