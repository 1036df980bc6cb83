"""Queries of the single operators over the domain tables, with DuckDB SQL.

The SQL has its own word lists and rules. Where an operator needs source code,
which the tables don't hold, the input is a small literal project, and so is
the expected result.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as tx
from tessera.operators import analysis, graph, prompts, ranking, routes, symbols
from tessera.plans import ask, context, investigate
from tessera.plans.reference import _CALLS, _FACTS, _GRAPH, _HYPS, _IMPORTS, _SYMBOLS, _TASK, _built, _call_graph, _calls, _imports, _symbols
from tessera.session import shared_dir, stage, table
from tessera.sources import projects, repository, stores
from tessera.streaming import events

KINDS = "debug fix route session token"


def _paths(spark, base) -> DataFrame:
    """The indexed files as a listing: (path, length), projects as top folders."""
    f = table(spark, base, "file_symbols").filter("file_path is not null")
    return f.select(F.concat_ws("/", F.coalesce("project_name", F.lit("none")), "file_path").alias("path"), F.col("n_bytes").alias("length")).distinct()


def _handlers(spark, base, name: str = "start") -> DataFrame:
    return table(spark, base, "file_symbols").select(F.explode("routes").alias("r")).filter("r.function_name is not null").select(F.col("r.function_name").alias(name)).distinct()


def _file_edges(spark, base) -> DataFrame:
    return _imports(spark, base).filter("target is not null").select("source", "target").distinct()


def _some_files(spark, base) -> DataFrame:
    """The query set of file closures: every row whose id is divisible by 50."""
    return table(spark, base, "file_symbols").filter("file_id % 50 = 0 and file_path is not null").select(F.col("file_path").alias("start")).distinct()


def _inherits(spark, base) -> DataFrame:
    e = table(spark, base, "file_symbols").select(F.explode("inherits").alias("i")).filter("i.class_name is not null and i.parent is not null")
    return e.select(F.col("i.class_name").alias("source"), F.col("i.parent").alias("target")).distinct()


# ---------------------------------------------------------------- sources
def tree_nodes(spark: SparkSession, base: str) -> DataFrame:
    """Files and folders of the indexed files, without the folders left out."""
    return repository.tree(_paths(spark, base).select("path")).select("path", F.coalesce("parent", F.lit("")).alias("parent"), "name", "node_type", F.col("depth").cast("bigint").alias("depth"))


def file_scans(spark: SparkSession, base: str) -> DataFrame:
    """What each of the scans takes of the indexed and ranked files."""
    files = table(spark, base, "file_symbols").select(F.col("file_path").alias("path")).unionByName(table(spark, base, "ranked_file").select(F.col("file_path").alias("path"))).filter("path is not null").distinct()
    scans = {
        "python": repository.keep(files, (), (".py",)),
        "languages": repository.keep(files, (), (".py", ".dart", ".js", ".ts")),
        "project": repository.keep(files, repository.PROJECT_FOLDERS, repository.PROJECT_EXTENSIONS),
        "code": repository.keep(files, repository.CODE_FOLDERS, repository.CODE_EXTENSIONS),
    }
    out = None
    for name, df in scans.items():
        part = df.select(F.lit(name).alias("scan"), "path")
        out = part if out is None else out.unionByName(part)
    return out


def expand_patterns(spark: SparkSession, base: str) -> DataFrame:
    """Files that patterns, a folder and a path in the wrong place mean."""
    files = table(spark, base, "file_symbols").filter("file_path is not null").select(F.col("file_path").alias("path")).distinct()
    return repository.expand(files, ["api/*.py", "**/panel*.ts", "web", "nowhere/__init__.py"])


def bounded_text(spark: SparkSession, base: str) -> DataFrame:
    """Evidence as files, over 4 KB headed and cut."""
    e = table(spark, base, "evidence").filter("content is not null").select(F.col("evidence_id").alias("path"), F.encode("content", "UTF-8").alias("content"), F.octet_length("content").alias("length"))
    return repository.bounded_text(e, 4).select(F.col("path").alias("evidence_id"), F.md5("text").alias("digest")).distinct()


def file_evidence(spark: SparkSession, base: str) -> DataFrame:
    """Files of the requests as evidence with size and hashes."""
    f = table(spark, base, "prompt_request").select(F.explode("files").alias("f")).filter("f.path is not null and f.content is not null").select("f.path", F.encode("f.content", "UTF-8").alias("content"), F.octet_length("f.content").alias("length"))
    e = repository.file_evidence(f)
    return e.select("path", F.col("metadata")["filename"].alias("filename"), F.col("metadata")["extension"].alias("extension"), F.col("metadata")["size_bytes"].alias("size_bytes"), F.col("metadata")["sha256"].alias("sha256"), F.col("metadata")["md5"].alias("md5")).distinct()


def file_hashes(spark: SparkSession, base: str) -> DataFrame:
    f = table(spark, base, "prompt_request").select(F.explode("files").alias("f")).filter("f.path is not null").select("f.path", F.encode("f.content", "UTF-8").alias("content"))
    return repository.content_hash(f).distinct()


def request_evidence(spark: SparkSession, base: str) -> DataFrame:
    return repository.request_evidence(table(spark, base, "prompt_request"), "intent").distinct()


def project_summary(spark: SparkSession, base: str) -> DataFrame:
    """The summary row and one row a file of the indexed files."""
    return projects.project_evidence(table(spark, base, "file_symbols").filter("file_path is not null").select(F.col("file_path").alias("path")).distinct())


def plan_sources(spark: SparkSession, base: str) -> DataFrame:
    """The sources that each request's evidence comes from."""
    c = table(spark, base, "prompt_request").select("request_id", "intent").distinct()
    i = analysis.intent(F.col("intent"))
    return projects.sources_of(analysis.evidence_plan(c.select("request_id", i["investigation_type"].alias("investigation_type"), i["domain"].alias("domain"))))


def graph_roundtrip(spark: SparkSession, base: str) -> DataFrame:
    """The built graph written, checked and read again: rows by type."""
    nodes, edges = _built(spark, base)
    path = os.path.join(shared_dir(spark), f"graph-{uuid.uuid4().hex}")
    stores.save_graph(nodes, edges, path, "all")
    return graph.counts(*stores.load_graph(spark, path))


def fact_upsert(spark: SparkSession, base: str) -> DataFrame:
    """Intents that are no fact of the evidence yet, the first of each."""
    old = analysis.facts(table(spark, base, "evidence").select("evidence_id", "content", "collected_at"), "evidence_id", "content", "collected_at")
    new = table(spark, base, "prompt_request").select(F.col("intent").alias("statement"), "request_id").filter("statement is not null")
    return stores.insert_missing(old, new, "statement", "request_id")


def file_arguments(spark: SparkSession, base: str) -> DataFrame:
    """Paths of evidence and rankings, of two kinds, that are indexed files."""
    given = table(spark, base, "evidence").select(F.lower("evidence_type").alias("evidence_type"), "path").unionByName(table(spark, base, "ranked_file").select(F.lit("file").alias("evidence_type"), F.col("file_path").alias("path"))).distinct()
    return repository.file_arguments(given, ["file", "log"], table(spark, base, "file_symbols").select(F.col("file_path").alias("path")))


def prompt_history(spark: SparkSession, base: str) -> DataFrame:
    """The five newest requests of each project."""
    r = table(spark, base, "prompt_request").select("project_name", "request_id", "requested_at").filter("project_name is not null").distinct()
    return projects.prompt_history(r.withColumn("o", F.struct("requested_at", "request_id")), "project_name", "o").select("project_name", "request_id")


def repository_digests(spark: SparkSession, base: str) -> DataFrame:
    """Each project's first paths."""
    f = table(spark, base, "file_symbols").filter("file_path is not null and project_name is not null").select(F.col("project_name").alias("repository"), F.col("file_path").alias("path"), F.encode("head_text", "UTF-8").alias("content")).distinct()
    return projects.repository_digest(f).select("repository", F.coalesce("readme", F.lit("")).alias("readme"), F.md5("file_tree").alias("digest"))


def conversation_texts(spark: SparkSession, base: str) -> DataFrame:
    """The events of each user as turns of a conversation."""
    t = table(spark, base, "events").select(F.col("user_id").cast("string").alias("conv_id"), "event_id", "event_type", F.col("props").alias("text"))
    return prompts.conversation_text(t, "conv_id", "event_id", "event_type", "text", prompts.LEAST_TURN["claude"]).select("conv_id", F.md5("conversation").alias("digest"))


def timeline_signal_dedupe(spark: SparkSession, base: str) -> DataFrame:
    """Events that a prompt shows, the first of each content and user."""
    kind = F.when(F.col("event_type") == "signup", "user_request").when(F.col("event_type") == "purchase", "decision_made").when(F.col("event_type") == "error", "fact_verified").otherwise(F.col("event_type"))
    t = table(spark, base, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("props").alias("content"))
    return stores.signals(t).select("session", "seq", "type")


def timeline_stream(spark: SparkSession, base: str) -> DataFrame:
    """The events table read as a stream and appended to a table, which is read
    again: counts by kind."""
    source = spark.readStream.schema(table(spark, base, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{base}/events*.parquet")
    to = os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
    events.copy_new(source.select("event_type", "event_id"), f"{to}/out", f"{to}/checkpoint").awaitTermination()
    return spark.read.schema("event_type string, event_id bigint").parquet(f"{to}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


# ------------------------------------------------------------------ graph
def nodes_v1_lookup(spark: SparkSession, base: str) -> DataFrame:
    """Files, symbols and routes by name, as the first generation finds them."""
    n = table(spark, base, "graph_node").select(F.col("id"), "type", "name").filter("id is not null").distinct()
    out = None
    for kind, name in (("file", "TOKEN.PY"), ("symbol", "Quote_Panel"), ("route", "/tokens/session")):
        part = graph.find_v1(n, name, kind).select(F.lit(kind).alias("kind"), "id", "name")
        out = part if out is None else out.unionByName(part)
    return out


def node_documents(spark: SparkSession, base: str) -> DataFrame:
    """Built nodes and edges as JSON documents."""
    return graph.projection(*_built(spark, base)).select("what", "id", F.md5("document").alias("digest"))


def typed_ids(spark: SparkSession, base: str) -> DataFrame:
    """Identifiers of the typed nodes of all symbols."""
    f = table(spark, base, "file_symbols").filter("file_path is not null")
    path = F.col("file_path")
    none = F.lit(None).cast("string")
    part = lambda c, kind, name, owner=none: f.select("file_path", F.explode(c).alias("x")).filter("x is not null").select(graph.typed_id(F.lit(kind), path, name, owner).alias("id"), F.lit(kind).alias("kind"))
    x = lambda n: F.col(f"x.{n}")
    out = f.select(graph.typed_id(F.lit("file"), path, none).alias("id"), F.lit("file").alias("kind"))
    for p in (part("classes", "class", x("name")), part("functions", "function", x("name")), part("methods", "method", x("name"), x("class_name")), part("routes", "route", x("path"), x("method")), part("imports", "dependency", x("module"))):
        out = out.unionByName(p)
    return out.distinct()


def one_hop_neighbors(spark: SparkSession, base: str) -> DataFrame:
    """Neighbours of each node of the built graph, by direction and relationship."""
    nodes, edges = _built(spark, base)
    out = None
    for side in (False, True):
        part = graph.neighbours(nodes, edges, incoming=side).groupBy("from_id", "relationship").agg(F.count("*").alias("n"), F.min("name").alias("first_name")).withColumn("side", F.lit("in" if side else "out"))
        out = part if out is None else out.unionByName(part)
    return out


def definition_sites(spark: SparkSession, base: str) -> DataFrame:
    """Files that define each symbol, over the graph's edges."""
    nodes, edges = _built(spark, base)
    return graph.neighbours(nodes, edges, [graph.DEFINES], incoming=True).select(F.col("from_id").alias("symbol_id"), F.col("name").alias("file"))


def route_context(spark: SparkSession, base: str) -> DataFrame:
    """Steps of each route's request: itself, its handler, the handler's uses."""
    f = table(spark, base, "file_symbols")
    r = f.select("file_path", F.col("file_id").alias("ord"), F.explode("routes").alias("r")).filter("r is not null").select("r.method", "r.path", F.col("r.function_name").alias("handler"), "file_path", "ord").distinct()
    refs = f.select(F.col("file_path").alias("file"), F.explode("calls").alias("c")).filter("c.target is not null").select(F.col("c.target").alias("name"), "file", F.col("c.line").alias("line")).distinct()
    return routes.request_trace(r, refs).groupBy("route", "kind").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def route_symbols(spark: SparkSession, base: str) -> DataFrame:
    """Symbols defined in the file of each route's handler."""
    f = table(spark, base, "file_symbols")
    r = f.select("file_path", F.col("file_id").alias("ord"), F.explode("routes").alias("r")).filter("r is not null").select("r.method", "r.path", F.col("r.function_name").alias("handler"), "file_path", "ord").distinct()
    return routes.symbols_of(r, _symbols(spark, base))


def graph_build_v1(spark: SparkSession, base: str) -> DataFrame:
    """Counts of the first generation's nodes and edges by type."""
    f = table(spark, base, "file_symbols").filter("file_path is not null")
    tree = repository.tree(f.select(F.col("file_path").alias("path")).distinct())
    none = F.lit(None).cast("string")
    one = lambda c, kind, name, owner=none, method=none, path=none: f.select("file_path", F.explode(c).alias("x")).filter("x is not null").select("file_path", F.lit(kind).alias("kind"), owner.alias("class_name"), name.alias("name"), method.alias("method"), path.alias("route_path")).distinct()
    x = lambda n: F.col(f"x.{n}")
    syms = one("classes", "class", x("name")).unionByName(one("functions", "function", x("name"))).unionByName(one("methods", "method", x("name"), x("class_name"))).unionByName(one("routes", "route", x("function_name"), none, x("method"), x("path")))
    nodes, edges = graph.build_v1(tree, syms, _imports(spark, base).filter("target is not null").select("source", "target"))
    return graph.counts(nodes, edges)


def reachability(spark: SparkSession, base: str) -> DataFrame:
    """Which handlers reach which within four calls, and in how many."""
    return graph.path_lengths(_calls(spark, base), _handlers(spark, base), _handlers(spark, base, "target"), 4)


def shortest_path_levels(spark: SparkSession, base: str) -> DataFrame:
    """Numbers of handlers' callees by the length of the shortest path."""
    return graph.path_lengths(_calls(spark, base), _handlers(spark, base), _calls(spark, base).select("target"), 4).groupBy("start", "length").agg(F.count("*").alias("n"))


def depth_first(spark: SparkSession, base: str) -> DataFrame:
    """What each class reaches over its parents, in depth-first order."""
    e = _inherits(spark, base)
    return graph.depth_first(e, e.select(F.col("source").alias("start")), 10).select("start", "id", F.array_join("path", ">").alias("path"), F.col("depth").cast("bigint").alias("depth"))


def inheritance_tree(spark: SparkSession, base: str) -> DataFrame:
    """Ancestors and descendants of each class."""
    e = _inherits(spark, base).withColumn("relationship", F.lit(graph.INHERITS))
    return graph.inheritance(e, e.select(F.col("source").alias("start"))).select("start", "id", "side", F.col("depth").cast("bigint").alias("depth"))


def route_execution(spark: SparkSession, base: str) -> DataFrame:
    """What each route executes within three steps, over calls and references."""
    r = table(spark, base, "file_symbols").select(F.explode("routes").alias("r")).filter("r.function_name is not null and r.path is not null").select(F.concat_ws(":", F.upper("r.method"), "r.path").alias("source"), F.col("r.function_name").alias("target")).distinct()
    e = r.withColumn("relationship", F.lit(graph.REFERENCES)).unionByName(_calls(spark, base).withColumn("relationship", F.lit(graph.CALLS)))
    return graph.reach(e, r.select(F.col("source").alias("start")), 3, [graph.CALLS, graph.REFERENCES, graph.INSTANTIATES]).groupBy("start").agg(F.count("*").alias("n"), F.max("depth").cast("bigint").alias("depth"))


def impact_sections(spark: SparkSession, base: str) -> DataFrame:
    """Numbers of one-hop callers, callees, dependencies and dependents of the
    route handlers."""
    nodes, edges = _call_graph(spark, base)
    return graph.impact_all(nodes, edges, _handlers(spark, base)).groupBy("start", "section").agg(F.count("*").alias("n"))


def impact_v3(spark: SparkSession, base: str) -> DataFrame:
    """What depends on the symbol that comes first, whatever the distance."""
    e = _calls(spark, base)
    name = e.agg(F.min("target")).first()[0]
    return graph.impact_v3(e, name if name is not None else "").select("section", "name")


def file_closures(spark: SparkSession, base: str) -> DataFrame:
    """Files that the queried files need, and that a change of them affects."""
    e, starts = _file_edges(spark, base), _some_files(spark, base)
    down = graph.file_closure(e, starts).withColumn("side", F.lit("downstream"))
    return down.unionByName(graph.file_closure(e, starts, incoming=True).withColumn("side", F.lit("affected")))


def dependency_summaries(spark: SparkSession, base: str) -> DataFrame:
    s = graph.dependency_summary(_file_edges(spark, base), _some_files(spark, base))
    return s.select("start", "direct_dependencies", "direct_dependents", "affected_files", F.col("dependency_depth").cast("bigint").alias("dependency_depth"))


def project_counts(spark: SparkSession, base: str) -> DataFrame:
    """Counts of the built graph by type of node and edge."""
    return graph.counts(*_built(spark, base))


def repository_contexts(spark: SparkSession, base: str) -> DataFrame:
    """Sizes of the context around each route handler, by section."""
    nodes, edges = _call_graph(spark, base)
    c = context.repository_context(nodes, edges, _handlers(spark, base, "name"), 2)
    return c.groupBy("section", "name").agg(F.count("*").alias("n"))


def investigation_contexts(spark: SparkSession, base: str) -> DataFrame:
    """Sections of the investigation context around the route handlers."""
    nodes, edges = _call_graph(spark, base)
    c = context.investigation_context(nodes, edges, _handlers(spark, base, "name"), "get /tokens/session fails", ["POST /a"], 2)
    return c.groupBy("section", "source", "relationship").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- ranking
def evidence_expansion(spark: SparkSession, base: str) -> DataFrame:
    """Ranked symbols and files widened by one hop, the 20 best a source."""
    nodes, edges = _call_graph(spark, base)
    h = _handlers(spark, base, "name")
    seeds = h.select(F.lit("symbol").alias("source"), "name", (1.0 / F.length("name")).alias("score"), F.length("name").alias("ord"))
    files = table(spark, base, "ranked_file").filter("score is not null").groupBy(F.col("file_path").alias("name")).agg(F.max("score").alias("score"))
    seeds = seeds.unionByName(files.select(F.lit("file").alias("source"), "name", "score", F.lit(0).alias("ord")))
    return ranking.evidence_expansion(seeds, nodes, edges).groupBy("source").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.min("score"), 6).alias("least"))


def evidence_package(spark: SparkSession, base: str) -> DataFrame:
    """Files, symbols, routes and references for an issue."""
    n = table(spark, base, "graph_node").select("id", "type", "name").filter("id is not null").distinct()
    refs = table(spark, base, "file_symbols").select(F.col("file_path").alias("file"), F.explode("calls").alias("c")).filter("c.target is not null").select("file", F.col("c.line").alias("line"), F.col("c.target").alias("name")).distinct()
    files = table(spark, base, "ranked_file").filter("score is not null").groupBy("file_path").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "file_path").limit(20)
    return context.package_v1(n, refs, files, "token").select("section", F.col("ord").cast("bigint").alias("ord"), "value")


def semantic_lookup(spark: SparkSession, base: str) -> DataFrame:
    """Nodes named by a word of the query, and what a handler executes."""
    nodes, edges = _call_graph(spark, base)
    first = edges.agg(F.min("source")).first()[0] or ""
    return context.retrieve(nodes, edges, f"where is {first} handled", [first])


def discovered_files(spark: SparkSession, base: str) -> DataFrame:
    f = table(spark, base, "file_symbols").filter("file_path is not null").select(F.col("file_path").alias("path")).distinct()
    return ranking.discover(f, KINDS.split()).select("path", "score")


def composite_scores(spark: SparkSession, base: str) -> DataFrame:
    """The best files of the requests by path, content, age, name, suggestion."""
    f = table(spark, base, "prompt_request").select(F.explode("files").alias("f"), "requested_at").filter("f.path is not null and f.content is not null").groupBy(F.col("f.path").alias("path")).agg(F.max("f.content").alias("content"), F.max("requested_at").alias("modified"))
    f = f.select("path", "content", F.octet_length("content").alias("length"), F.col("modified").cast("timestamp_ntz").cast("timestamp").alias("modified"))
    now = F.lit("2026-07-01 00:00:00").cast("timestamp")
    return ranking.composite_file_score(f, KINDS.split(), now, ["src/main.py", "config"], 50).select("path", F.md5("content").alias("digest"), "score")


# ------------------------------------------------------------- text rules
def question_grammar(spark: SparkSession, base: str) -> DataFrame:
    """Questions made of the calls, and intents, by the grammar."""
    c = _calls(spark, base)
    q = c.select(F.concat(F.lit("Who calls "), "target", F.lit("?")).alias("q")).unionByName(c.select(F.concat(F.lit(" what does "), "source", F.lit(" call? ")).alias("q"))).unionByName(c.select(F.concat(F.lit("Can "), "source", F.lit(" reach "), "target", F.lit("?")).alias("q"))).unionByName(c.select(F.concat(F.lit("trace "), "source", F.lit(" ->"), "target").alias("q")))
    q = q.unionByName(table(spark, base, "prompt_request").filter("intent is not null").select(F.col("intent").alias("q"))).distinct()
    return q.select("q", ask.parsed(F.col("q")).alias("p")).select("q", "p.intent_type", "p.first", "p.second")


def question_answers(spark: SparkSession, base: str) -> DataFrame:
    """Who calls and what is called: the grammar's questions answered by joins."""
    c = _calls(spark, base).withColumn("relationship", F.lit(graph.CALLS))
    p = question_grammar(spark, base)
    who = p.filter("intent_type = 'who_calls'").join(c, F.col("first") == F.col("target")).select("q", F.col("source").alias("answer"))
    what = p.filter("intent_type = 'what_does_call'").join(c, F.col("first") == F.col("source")).select("q", F.col("target").alias("answer"))
    return who.unionByName(what).groupBy("q").agg(F.countDistinct("answer").alias("n"), F.min("answer").alias("first_answer"))


def task_routing(spark: SparkSession, base: str) -> DataFrame:
    """Task, recommended target and reason of each request."""
    r = table(spark, base, "prompt_request")
    t = tx.task_routing(F.col("intent"), F.col("conversation"))
    return r.select("request_id", t.alias("t")).filter("t is not null").select("request_id", "t.task_type", "t.recommended", "t.display", "t.reason").distinct()


def next_steps(spark: SparkSession, base: str) -> DataFrame:
    """Last action, next step, suggestion and likely files of conversations."""
    r = table(spark, base, "prompt_request").filter("conversation is not null").select("request_id", tx.next_step(F.col("conversation")).alias("n"))
    d = table(spark, base, "documents").filter("text is not null").select((-F.col("doc_id")).alias("request_id"), tx.next_step(F.col("text")).alias("n"))
    return r.unionByName(d).select("request_id", "n.last_ai_action", "n.next_step", "n.suggested_intent", F.array_join("n.likely_files", ",").alias("likely_files")).distinct()


# ---------------------------------------------------------------- prompts
def _package(df: DataFrame) -> tuple:
    return prompts.package("debugging", {"project": F.coalesce("project_name", F.lit("None")), "current_issue": F.coalesce("intent", F.lit("")), "task": F.lit("Find the cause.")}, {"verified_facts": F.array(F.coalesce("expected", F.lit("")), F.coalesce("actual", F.lit("")))})


def prompt_compose(spark: SparkSession, base: str) -> DataFrame:
    """Packages of the requests as text and as markdown."""
    r = table(spark, base, "prompt_request")
    i, s = _package(r)
    return r.select("request_id", F.md5(prompts.render(i, s)).alias("markdown"), F.md5(prompts.render(i, s, markdown=False)).alias("plain")).distinct()


def prompt_targets(spark: SparkSession, base: str) -> DataFrame:
    """Each request's prompt as a target of its own wants it."""
    r = table(spark, base, "prompt_request")
    i, s = _package(r)
    t = F.element_at(F.array(*[F.lit(x) for x in ("claude", "Gemini", "local", "text", "markdown")]), (F.col("request_id") % 5 + 1).cast("int"))
    return r.select("request_id", F.md5(prompts.for_target(i, s, t)).alias("digest")).distinct()


def prompt_short(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "prompt_request")
    p = prompts.build_short(F.col("intent"), F.col("files"), F.coalesce("target", F.lit("any")), F.col("expected"), F.col("actual"))
    return r.select("request_id", F.md5(p).alias("digest")).distinct()


def prompt_repository(spark: SparkSession, base: str) -> DataFrame:
    """Built prompts with a section about the repository."""
    r = table(spark, base, "prompt_request")
    repo = F.struct(F.lit("o").alias("owner"), F.col("project_name").alias("repo"), F.col("extra_context").alias("readme"), F.col("intent").alias("file_tree"))
    p = prompts.build(r, F.when(F.col("project_name").isNotNull(), repo))
    return p.select("request_id", F.md5("prompt").alias("digest")).distinct()


def prompt_v2(spark: SparkSession, base: str) -> DataFrame:
    """Context prompts of the requests: files, facts and hypotheses."""
    r = table(spark, base, "prompt_request")
    none = F.array().cast("array<string>")
    files = F.transform(F.filter(F.coalesce("files", F.array().cast("array<struct<path:string,content:string>>")), lambda f: f.isNotNull() & f["path"].isNotNull()), lambda f: f["path"])
    facts = F.filter(F.array("expected", "actual"), lambda x: x.isNotNull())
    p = context.prompt_v2(F.coalesce("intent", F.lit("")), files, none, F.array().cast("array<struct<source:string,target:string>>"), F.array().cast("array<array<string>>"), F.transform(tx.route_mentions(F.coalesce("conversation", F.lit(""))), lambda x: x), facts, none)
    return r.select("request_id", F.md5(p).alias("digest")).distinct()


def investigation_results(spark: SparkSession, base: str) -> DataFrame:
    """One investigation over the whole evidence: counts and best cause."""
    got = investigate.investigate("Why does the service return 404 after a timeout", table(spark, base, "evidence"))
    f = got.facts.agg(F.count("*").alias("n_facts")).withColumn("k", F.lit(1))
    h = got.hypotheses.agg(F.count("*").alias("n_hypotheses")).withColumn("k", F.lit(1))
    best = got.root_causes.filter("rank = 1").select("statement", "confidence", F.lit(1).alias("k"))
    return f.join(h, "k").join(best, "k").join(got.intent.select("investigation_type", "domain", F.lit(1).alias("k")), "k").drop("k")


# ------------------------------------------------- source code (a literal)
SOURCES = [
    ("a.py", 'import os.path\nfrom pkg import A as B, C\nclass Base: pass\nclass Service(Base):\n    def helper(self): return 1\n    @app.get("/users")\n    def login(self):\n        self.helper()\n        s = Other()\n        s.run()\n        Other().stop()\n@app.route("/r", methods=["GET", "POST"])\ndef handler(): return Service().login()\nasync def later(): await go()\n'),
    ("b.py", "def ("),
    ("c.py", None),
    ("d.py", "class Other:\n    def run(self): pass\n    def stop(self): pass\n"),
    ("e.js", "app.get('/a', f)\nx\nrouter.POST(\"/b\")"),
    ("f.dart", "router.get('/c', h); app.get('/no')"),
]


def _source(spark) -> DataFrame:
    return spark.createDataFrame(SOURCES, "path string, content string")


def _extracted(spark) -> DataFrame:
    return symbols.extract(_source(spark).filter("path like '%.py'"))


def symbol_rows(spark: SparkSession, base: str) -> DataFrame:
    """All symbols of a small project but names and attributes."""
    s = _extracted(spark).filter("kind not in ('reference', 'attribute', 'called', 'member')")
    return s.select("file_path", "kind", "name", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("detail", F.lit("")).alias("detail"), F.coalesce("line", F.lit(0)).cast("bigint").alias("line"), F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",").alias("items"))


def symbol_rows_v1(spark: SparkSession, base: str) -> DataFrame:
    """Definitions as the first generation has them: no async functions."""
    s = symbols.extract(_source(spark).filter("path like '%.py'"), asynchronous=False).filter("kind in ('class', 'function', 'method')")
    return s.select("file_path", "kind", "name", F.col("end_line").cast("bigint").alias("end_line"))


def name_references(spark: SparkSession, base: str) -> DataFrame:
    """Names and attributes of the small project, by file."""
    d, r = symbols.definitions_and_references(_extracted(spark))
    return r.join(d.select("name").distinct(), "name", "left_semi").groupBy("name", "context").agg(F.count("*").alias("n"), F.min("line").cast("bigint").alias("first_line"))


def route_index(spark: SparkSession, base: str) -> DataFrame:
    r = symbols.route_index(_source(spark).filter("path not like '%.py'"), _extracted(spark))
    return r.select("path", "method", "file_path", F.col("line").cast("bigint").alias("line"), "handler", "framework", F.array_join(tx.path_parameters(F.col("path")), ",").alias("parameters"))


def method_calls(spark: SparkSession, base: str) -> DataFrame:
    return symbols.resolved_calls(_extracted(spark)).withColumn("line_number", F.col("line_number").cast("bigint"))


def graph_v3_reach(spark: SparkSession, base: str) -> DataFrame:
    """The third generation's graph: calls of methods, what a method reaches."""
    e = graph.build_v3(symbols.resolved_calls(_extracted(spark)))
    return graph.reach(e, e.select(F.col("source").alias("start")), 10).select("start", "id", F.col("depth").cast("bigint").alias("depth"))


def callable_lookup(spark: SparkSession, base: str) -> DataFrame:
    """Names as the third generation finds them: ends of calls, then methods."""
    s = _extracted(spark)
    calls = graph.build_v3(symbols.resolved_calls(s))
    methods = s.filter("kind = 'method'").select(F.col("owner").alias("class_name"), "name")
    out = None
    for name in ("Service.login", "run", "Base"):
        part = routes.find_callable(calls, methods, name).select(F.lit(name).alias("query"), "id", "type")
        out = part if out is None else out.unionByName(part)
    return out


def answers(spark: SparkSession, base: str) -> DataFrame:
    """Questions over the small project's graph, answered."""
    nodes, edges = graph.build_v2(symbols.symbol_document(_extracted(spark)).withColumn("file_id", F.xxhash64("file_path")))
    repo = ask.Repository(stage(nodes, "nodes"), stage(edges, "edges"))
    rows = []
    for q in ("Where is Service handled?", "Show handler execution flow", "hello"):
        a = repo.ask(q)
        rows.append((q, a.capability, a.confidence, ",".join(a.evidence)))
    return spark.createDataFrame(rows, "question string, capability string, confidence double, evidence string")


QUERIES = {
    f.__name__: f
    for f in (
        tree_nodes, file_scans, expand_patterns, bounded_text, file_evidence, file_hashes, request_evidence, project_summary, plan_sources, graph_roundtrip, fact_upsert, file_arguments, prompt_history, repository_digests, conversation_texts,
        timeline_signal_dedupe, timeline_stream, nodes_v1_lookup, node_documents, typed_ids, one_hop_neighbors, definition_sites, route_context, route_symbols, graph_build_v1, reachability, shortest_path_levels, depth_first, inheritance_tree,
        route_execution, impact_sections, impact_v3, file_closures, dependency_summaries, project_counts, repository_contexts, investigation_contexts, evidence_expansion, evidence_package, semantic_lookup, discovered_files, composite_scores,
        question_grammar, question_answers, task_routing, next_steps, prompt_compose, prompt_targets, prompt_short, prompt_repository, prompt_v2, investigation_results, symbol_rows, symbol_rows_v1, name_references, route_index, method_calls,
        graph_v3_reach, callable_lookup, answers,
    )
}

_TREE_FOLDERS = "['.git', '.github', '.idea', '.vscode', '__pycache__', '.pytest_cache', '.mypy_cache', '.ruff_cache', '.tox', '.venv', 'venv', 'env', 'node_modules', 'build', 'dist', 'target', '.dart_tool', '.next', '.turbo', '.gradle', 'coverage']"
_PROJECT_FOLDERS = "['.git', '.idea', '.vscode', '__pycache__', '.pytest_cache', '.dart_tool', 'build', 'dist', 'node_modules', '.venv', 'venv']"
_CODE_FOLDERS = "['node_modules', '.git', 'venv', '.venv', 'build', 'dist', '__pycache__', '.dart_tool', '.pub-cache', 'android', 'ios', 'web', 'windows', 'linux', 'macos']"
_PROJECT_ENDS = "('.py', '.dart', '.ts', '.tsx', '.js', '.jsx', '.json', '.yaml', '.yml', '.toml', '.sql', '.md')"
_CODE_ENDS = "('.dart', '.py', '.js', '.ts', '.jsx', '.tsx', '.json', '.yaml', '.yml', '.env', '.md', '.html', '.css', '.sql', '.sh', '.bat')"
_EXT = r"lower(regexp_extract(path, '[^/.][^/]*(\.[^./]+)$', 1))"
_BELOW = "string_split(path, '/')[1:len(string_split(path, '/')) - 1]"
_TREE = f"""k AS (SELECT string_split(path, '/') AS a FROM p WHERE NOT list_has_any({_BELOW}, {_TREE_FOLDERS}) AND regexp_extract(path, '[^/]+$') NOT IN ('.DS_Store', 'Thumbs.db')),
    u AS (SELECT DISTINCT array_to_string(a[1:i], '/') AS path, CASE WHEN i = len(a) THEN 'file' ELSE 'directory' END AS node_type, i AS depth FROM (SELECT a, unnest(range(1, len(a) + 1)) AS i FROM k))"""
_FILES = "(SELECT DISTINCT file_path AS path FROM file_symbols WHERE file_path IS NOT NULL)"
_COUNTS = "SELECT 'node ' || type AS what, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge ' || relationship, count(*) FROM e GROUP BY relationship"
_KIND = "CASE WHEN regexp_matches(l, 'fix|bug|error|broken|not working|issue|sync|failing') THEN 'debugging' WHEN regexp_matches(l, 'why|cause|reason') THEN 'root_cause' WHEN regexp_matches(l, 'slow|latency|performance|memory|cpu') THEN 'performance' WHEN regexp_matches(l, 'security|auth bypass|token|jwt|vulnerability') THEN 'security' WHEN regexp_matches(l, 'test') THEN 'test_failure' WHEN regexp_matches(l, 'architecture|design|review|structure') THEN 'architecture_review' WHEN regexp_matches(l, 'feature|implement|analyze|behaviour|behavior') THEN 'feature_analysis' ELSE 'unknown' END"
_DOMAIN = "CASE WHEN regexp_matches(l, 'backend|server|repository|service|railway') THEN 'backend' WHEN regexp_matches(l, 'frontend|ui|react|page|component') THEN 'frontend' WHEN regexp_matches(l, 'flutter|android|ios|mobile') THEN 'mobile' WHEN regexp_matches(l, 'api|endpoint|route|request|response') THEN 'api' WHEN regexp_matches(l, 'database|postgres|sqlite|schema|query') THEN 'database' WHEN regexp_matches(l, 'auth|login|jwt|token') THEN 'auth' WHEN regexp_matches(l, 'docker|deployment|infra|kubernetes|container') THEN 'infrastructure' ELSE 'unknown' END"
_HANDLERS = "s AS (SELECT DISTINCT r.function_name AS start FROM (SELECT unnest(routes) AS r FROM file_symbols) WHERE r.function_name IS NOT NULL)"
_REACH4 = f"c AS ({_CALLS}), {_HANDLERS}, w AS (SELECT start, start AS id, 0 AS depth FROM s UNION SELECT w.start, c.target, w.depth + 1 FROM w JOIN c ON c.source = w.id WHERE w.depth < 4), m AS (SELECT start, id AS target, min(depth) AS length FROM w GROUP BY start, id)"
_INHERITS = "e AS (SELECT DISTINCT i.class_name AS s, i.parent AS t FROM (SELECT unnest(inherits) AS i FROM file_symbols) WHERE i.class_name IS NOT NULL AND i.parent IS NOT NULL)"
_CLOSURE = f"{_IMPORTS}, e AS (SELECT DISTINCT source, target FROM im WHERE target IS NOT NULL), s AS (SELECT DISTINCT file_path AS start FROM file_symbols WHERE file_id % 50 = 0 AND file_path IS NOT NULL)"
_ROUTES = "r AS (SELECT DISTINCT upper(r.method) || ':' || r.path AS route, r.function_name AS handler, file_path, file_id FROM (SELECT file_id, file_path, unnest(routes) AS r FROM file_symbols) WHERE r IS NOT NULL AND r.function_name <> ''), h AS (SELECT route, handler, file_path FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY file_id DESC, handler DESC, file_path DESC) AS k FROM r) WHERE k = 1)"
_QUESTIONS = f"""c AS ({_CALLS}), q AS (SELECT 'Who calls ' || target || '?' AS q FROM c UNION SELECT ' what does ' || source || ' call? ' FROM c UNION SELECT 'Can ' || source || ' reach ' || target || '?' FROM c UNION SELECT 'trace ' || source || ' ->' || target FROM c UNION SELECT intent FROM prompt_request WHERE intent IS NOT NULL),
    t AS (SELECT q, regexp_replace(q, '^\\s+|\\s+$', '', 'g') AS t FROM q),
    g AS (SELECT q, CASE WHEN regexp_matches(t, '(?i)^who\\s+calls\\s+(.+?)\\??$') THEN 'who_calls' WHEN regexp_matches(t, '(?i)^what\\s+does\\s+(.+?)\\s+call\\??$') THEN 'what_does_call' WHEN regexp_matches(t, '(?i)^can\\s+(.+?)\\s+reach\\s+(.+?)\\??$') THEN 'can_reach' WHEN regexp_matches(t, '(?i)^trace\\s+(.+?)\\s*->\\s*(.+?)$') THEN 'trace' ELSE 'unknown' END AS intent_type, t FROM t),
    p AS (SELECT q, intent_type, trim(CASE intent_type WHEN 'who_calls' THEN regexp_extract(t, '(?i)^who\\s+calls\\s+(.+?)\\??$', 1) WHEN 'what_does_call' THEN regexp_extract(t, '(?i)^what\\s+does\\s+(.+?)\\s+call\\??$', 1) WHEN 'can_reach' THEN regexp_extract(t, '(?i)^can\\s+(.+?)\\s+reach\\s+(.+?)\\??$', 1) WHEN 'trace' THEN regexp_extract(t, '(?i)^trace\\s+(.+?)\\s*->\\s*(.+?)$', 1) ELSE '' END) AS first,
        trim(CASE intent_type WHEN 'can_reach' THEN regexp_extract(t, '(?i)^can\\s+(.+?)\\s+reach\\s+(.+?)\\??$', 2) WHEN 'trace' THEN regexp_extract(t, '(?i)^trace\\s+(.+?)\\s*->\\s*(.+?)$', 2) ELSE '' END) AS second FROM g)"""
_DEBUGGING = "'Act as a senior software engineer conducting a structured investigation. Prioritize verified facts over assumptions. Identify root causes, missing evidence, and next actions.'"
_NL = "chr(10)"
_PACKAGE = f"""b AS (SELECT request_id, {_DEBUGGING} AS i, project_name AS p, coalesce(intent, '') AS c, '- ' || coalesce(expected, '') || {_NL} || '- ' || coalesce(actual, '') AS f FROM prompt_request),
    m AS (SELECT request_id, '# SYSTEM INSTRUCTIONS' || {_NL} || {_NL} || i || coalesce({_NL} || {_NL} || '# PROJECT' || {_NL} || {_NL} || p, '') || {_NL} || {_NL} || '# CURRENT ISSUE' || {_NL} || {_NL} || c || {_NL} || {_NL} || '# VERIFIED FACTS' || {_NL} || {_NL} || f || {_NL} || {_NL} || '# TASK' || {_NL} || {_NL} || 'Find the cause.' AS markdown,
        'SYSTEM INSTRUCTIONS' || {_NL} || '-------------------' || {_NL} || i || coalesce({_NL} || {_NL} || 'PROJECT' || {_NL} || '-------' || {_NL} || p, '') || {_NL} || {_NL} || 'CURRENT ISSUE' || {_NL} || '-------------' || {_NL} || c || {_NL} || {_NL} || 'VERIFIED FACTS' || {_NL} || '--------------' || {_NL} || f || {_NL} || {_NL} || 'TASK' || {_NL} || '----' || {_NL} || 'Find the cause.' AS plain FROM b)"""
_FILE_PART = f"nullif(array_to_string(list_transform(list_filter(coalesce(files, []), lambda x: x IS NOT NULL AND x.content IS NOT NULL), lambda x: '=== FILE: ' || coalesce(x.path, '') || ' ===' || {_NL} || x.content || {_NL}), {_NL}), '')"
_SEP = f"{_NL} || {_NL} || '---' || {_NL} || {_NL}"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    cell = lambda v: f"{v}::{'BIGINT' if isinstance(v, int) else 'DOUBLE'}" if isinstance(v, (int, float)) else _quoted(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


SQL: dict[str, str] = {
    "tree_nodes": f"WITH p AS (SELECT DISTINCT concat_ws('/', coalesce(project_name, 'none'), file_path) AS path FROM file_symbols WHERE file_path IS NOT NULL), {_TREE} SELECT path, CASE WHEN depth = 1 THEN '.' ELSE regexp_replace(path, '/[^/]+$', '') END AS parent, regexp_extract(path, '[^/]+$') AS name, node_type, depth FROM u UNION ALL SELECT '.', '', '.', 'directory', 0",
    "file_scans": f"""WITH f AS (SELECT file_path AS path FROM file_symbols WHERE file_path IS NOT NULL UNION SELECT file_path FROM ranked_file WHERE file_path IS NOT NULL), x AS (SELECT path, {_EXT} AS ext, {_BELOW} AS below FROM f)
        SELECT 'python' AS scan, path FROM x WHERE ext = '.py' UNION ALL SELECT 'languages', path FROM x WHERE ext IN ('.py', '.dart', '.js', '.ts') UNION ALL SELECT 'project', path FROM x WHERE ext IN {_PROJECT_ENDS} AND NOT list_has_any(below, {_PROJECT_FOLDERS}) UNION ALL SELECT 'code', path FROM x WHERE ext IN {_CODE_ENDS} AND NOT list_has_any(below, {_CODE_FOLDERS})""",
    "expand_patterns": rf"""WITH f AS {_FILES}, g(pattern, re, named) AS (VALUES ('api/*.py', '^api/[^./][^/]*\.py(/.*)?$', '*.py'), ('**/panel*.ts', '^([^/.][^/]*/)*panel[^/]*\.ts(/.*)?$', 'panel*.ts'), ('web', '^web(/.*)?$', 'web'), ('nowhere/__init__.py', '^nowhere/__init__\.py(/.*)?$', '__init__.py')),
        h AS (SELECT pattern, path FROM f, g WHERE regexp_matches(path, re)) SELECT pattern, path FROM h UNION ALL SELECT pattern, min(path) FROM f, g WHERE regexp_extract(path, '[^/]+$') = named AND pattern NOT IN (SELECT pattern FROM h) GROUP BY pattern""",
    "bounded_text": "SELECT DISTINCT evidence_id, md5(CASE WHEN strlen(content) > 4096 THEN '[Truncated — showing first 4KB of ' || CAST(strlen(content) // 1024 AS VARCHAR) || 'KB]' || chr(10) || substr(content, 1, 4096) ELSE content END) AS digest FROM evidence WHERE content IS NOT NULL",
    "file_evidence": f"SELECT DISTINCT path, regexp_extract(path, '[^/]+$') AS filename, {_EXT} AS extension, CAST(strlen(content) AS VARCHAR) AS size_bytes, sha256(content) AS sha256, md5(content) AS md5 FROM (SELECT f.path AS path, f.content AS content FROM (SELECT unnest(files) AS f FROM prompt_request)) WHERE path IS NOT NULL AND content IS NOT NULL",
    "file_hashes": "SELECT DISTINCT f.path AS path, coalesce(md5(f.content), '') AS hash FROM (SELECT unnest(files) AS f FROM prompt_request) WHERE f.path IS NOT NULL",
    "request_evidence": r"SELECT DISTINCT 'USER_REPORTED_PROBLEM' AS evidence_type, regexp_replace(intent, '^\s+|\s+$', '', 'g') AS content FROM prompt_request WHERE regexp_replace(intent, '^\s+|\s+$', '', 'g') <> ''",
    "project_summary": f"""WITH f AS {_FILES}, k AS (SELECT path, {_EXT} AS ext FROM f WHERE {_EXT} IN {_PROJECT_ENDS} AND NOT list_has_any({_BELOW}, {_PROJECT_FOLDERS})), h AS (SELECT ext, count(*) AS n, CASE ext WHEN '.py' THEN 'Python' WHEN '.dart' THEN 'Dart' WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript' WHEN '.js' THEN 'JavaScript' WHEN '.jsx' THEN 'JavaScript' WHEN '.sql' THEN 'SQL' END AS l FROM k GROUP BY ext)
        SELECT 'PROJECT_FILE' AS evidence_type, path, path AS content FROM k UNION ALL SELECT 'PROJECT_SUMMARY', '.', 'files: ' || CAST(sum(n) AS BIGINT) || chr(10) || 'extensions: ' || string_agg(ext || '=' || n, ', ' ORDER BY ext) || chr(10) || 'languages: ' || (SELECT string_agg(l, ', ' ORDER BY l) FROM (SELECT DISTINCT l FROM h WHERE l IS NOT NULL)) FROM h""",
    "plan_sources": f"""WITH c AS (SELECT DISTINCT request_id, lower(coalesce(intent, '')) AS l FROM prompt_request), t AS (SELECT request_id, {_KIND} AS k, {_DOMAIN} AS d FROM c)
        SELECT request_id, unnest(CASE WHEN k = 'debugging' AND d = 'backend' THEN ['log', 'file'] WHEN k = 'debugging' AND d = 'mobile' THEN ['log', 'terminal', 'project'] WHEN k = 'debugging' AND d = 'api' THEN ['file', 'log', 'project'] WHEN k = 'test_failure' AND d = 'unknown' THEN ['terminal', 'log'] WHEN k = 'security' AND d = 'auth' THEN ['file'] ELSE ['file', 'project'] END) AS source FROM t""",
    "graph_roundtrip": f"WITH {_GRAPH} {_COUNTS}",
    "project_counts": f"WITH {_GRAPH} {_COUNTS}",
    "fact_upsert": f"WITH {_FACTS} SELECT intent AS statement, min(request_id) AS request_id FROM prompt_request WHERE intent IS NOT NULL AND intent NOT IN (SELECT statement FROM f) GROUP BY intent",
    "file_arguments": "WITH g AS (SELECT lower(evidence_type) AS evidence_type, path FROM evidence UNION SELECT 'file', file_path FROM ranked_file) SELECT evidence_type, path FROM g WHERE evidence_type IN ('file', 'log') AND path IN (SELECT file_path FROM file_symbols WHERE file_path IS NOT NULL)",
    "prompt_history": "SELECT project_name, request_id FROM (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY requested_at DESC NULLS LAST, request_id DESC) AS r FROM (SELECT DISTINCT project_name, request_id, requested_at FROM prompt_request WHERE project_name IS NOT NULL)) WHERE r <= 5",
    "repository_digests": """WITH f AS (SELECT DISTINCT project_name AS repository, file_path AS path, head_text FROM file_symbols WHERE file_path IS NOT NULL AND project_name IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY path) AS r FROM f WHERE NOT contains(path, 'node_modules'))
        SELECT repository, coalesce((SELECT substr(arg_min(head_text, path), 1, 2000) FROM f WHERE f.repository = t.repository AND lower(path) = 'readme.md'), '') AS readme, md5(string_agg(path, chr(10) ORDER BY path)) AS digest FROM t WHERE r <= 60 GROUP BY repository""",
    "conversation_texts": f"SELECT CAST(user_id AS VARCHAR) AS conv_id, md5(string_agg('[' || upper(event_type) || ']: ' || props, {_SEP} ORDER BY event_id)) AS digest FROM events WHERE length(props) > 5 GROUP BY user_id",
    "timeline_signal_dedupe": "WITH t AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'signup' THEN 'user_request' WHEN 'purchase' THEN 'decision_made' WHEN 'error' THEN 'fact_verified' END AS type, substr(props, 1, 80) AS h FROM events) SELECT session, min(seq) AS seq, arg_min(type, seq) AS type FROM t WHERE type IS NOT NULL GROUP BY session, h",
    "timeline_stream": "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type",
    "nodes_v1_lookup": "WITH n AS (SELECT DISTINCT id, type, name FROM graph_node WHERE id IS NOT NULL) SELECT 'file' AS kind, id, name FROM n WHERE lower(type) = 'file' AND lower(name) = 'token.py' UNION ALL SELECT 'symbol', id, name FROM n WHERE lower(type) IN ('class', 'function', 'method') AND lower(name) = 'quote_panel' UNION ALL SELECT 'route', id, name FROM n WHERE lower(type) = 'route' AND name = '/tokens/session'",
    "node_documents": f"WITH {_GRAPH} SELECT 'node' AS what, id, md5(CAST(to_json({{'id': id, 'type': type, 'name': name}}) AS VARCHAR)) AS digest FROM n UNION ALL SELECT 'edge', source || '|' || relationship || '|' || target, md5(CAST(to_json({{'source': source, 'target': target, 'relationship': relationship}}) AS VARCHAR)) FROM e",
    "typed_ids": """WITH f AS (SELECT * FROM file_symbols WHERE file_path IS NOT NULL) SELECT file_path AS id, 'file' AS kind FROM f UNION SELECT concat_ws('::', file_path, 'class', x.name), 'class' FROM (SELECT file_path, unnest(classes) AS x FROM f) WHERE x IS NOT NULL UNION SELECT concat_ws('::', file_path, 'function', x.name), 'function' FROM (SELECT file_path, unnest(functions) AS x FROM f) WHERE x IS NOT NULL
        UNION SELECT concat_ws('::', file_path, 'method', concat_ws('.', x.class_name, x.name)), 'method' FROM (SELECT file_path, unnest(methods) AS x FROM f) WHERE x IS NOT NULL UNION SELECT concat_ws('::', file_path, 'route', x.method, x.path), 'route' FROM (SELECT file_path, unnest(routes) AS x FROM f) WHERE x IS NOT NULL UNION SELECT concat_ws('::', 'dependency', x.module), 'dependency' FROM (SELECT file_path, unnest(imports) AS x FROM f) WHERE x IS NOT NULL""",
    "one_hop_neighbors": f"WITH {_GRAPH} SELECT source AS from_id, relationship, count(*) AS n, min(name) AS first_name, 'out' AS side FROM e JOIN n ON n.id = e.target GROUP BY source, relationship UNION ALL SELECT target, relationship, count(*), min(name), 'in' FROM e JOIN n ON n.id = e.source GROUP BY target, relationship",
    "definition_sites": f"WITH {_GRAPH} SELECT target AS symbol_id, name AS file FROM e JOIN n ON n.id = e.source WHERE relationship = 'DEFINES'",
    "route_context": f"""WITH {_ROUTES}, u AS (SELECT DISTINCT route, file, line FROM h JOIN (SELECT file_path AS file, c.target AS name, c.line AS line FROM (SELECT file_path, unnest(calls) AS c FROM file_symbols) WHERE c.target IS NOT NULL) r ON r.name = h.handler)
        SELECT route, 'route' AS kind, 1 AS n, route AS first_name FROM h UNION ALL SELECT route, 'handler', 1, handler FROM h UNION ALL SELECT route, 'reference', count(*), min(concat_ws(':', file, line)) FROM u GROUP BY route""",
    "route_symbols": f"WITH {_ROUTES}, {_SYMBOLS} SELECT DISTINCT h.route, s.name, s.type FROM h JOIN s ON s.file = h.file_path",
    "graph_build_v1": f"""WITH p AS {_FILES}, {_TREE}, {_IMPORTS}, f AS (SELECT * FROM file_symbols WHERE file_path IS NOT NULL),
        y AS (SELECT file_path AS f, 'class' AS k, x.name AS a, NULL AS b FROM (SELECT file_path, unnest(classes) AS x FROM f) WHERE x IS NOT NULL UNION SELECT file_path, 'function', x.name, NULL FROM (SELECT file_path, unnest(functions) AS x FROM f) WHERE x IS NOT NULL UNION SELECT file_path, 'method', x.name, x.class_name FROM (SELECT file_path, unnest(methods) AS x FROM f) WHERE x IS NOT NULL),
        z AS (SELECT DISTINCT file_path AS f, x.function_name AS h, x.method AS m, x.path AS path FROM (SELECT file_path, unnest(routes) AS x FROM f) WHERE x IS NOT NULL)
        SELECT 'node ' || upper(node_type) AS what, count(*) AS n FROM (SELECT path, node_type FROM u UNION ALL SELECT '.', 'directory') GROUP BY node_type UNION ALL SELECT 'node ' || upper(k), count(DISTINCT CASE k WHEN 'method' THEN concat_ws('::', f, k, concat_ws('.', b, a)) ELSE concat_ws('::', f, k, a) END) FROM y GROUP BY k UNION ALL SELECT 'node ROUTE', count(DISTINCT concat_ws('::', f, 'route', m, path)) FROM z
        UNION ALL SELECT 'edge DEFINES', count(*) FROM y UNION ALL SELECT 'edge EXPOSES_ROUTE', count(*) FROM z UNION ALL SELECT 'edge IMPORTS', count(*) FROM im WHERE target IS NOT NULL""",
    "reachability": f"WITH RECURSIVE {_REACH4} SELECT start, target, CAST(length AS BIGINT) AS length FROM m WHERE target IN (SELECT start FROM s)",
    "shortest_path_levels": f"WITH RECURSIVE {_REACH4} SELECT start, CAST(length AS BIGINT) AS length, count(*) AS n FROM m WHERE target IN (SELECT target FROM c) GROUP BY start, length",
    "depth_first": f"WITH RECURSIVE {_INHERITS}, w AS (SELECT DISTINCT s AS start, s AS id, [s] AS path FROM e UNION ALL SELECT w.start, e.t, list_append(w.path, e.t) FROM w JOIN e ON e.s = w.id WHERE len(w.path) <= 10 AND NOT list_contains(w.path, e.t)) SELECT start, id, array_to_string(min(path), '>') AS path, CAST(len(min(path)) - 1 AS BIGINT) AS depth FROM w WHERE id <> start GROUP BY start, id",
    "inheritance_tree": f"""WITH RECURSIVE {_INHERITS}, a AS (SELECT DISTINCT s AS start FROM e), up AS (SELECT start, start AS id, 0 AS depth FROM a UNION SELECT up.start, e.t, up.depth + 1 FROM up JOIN e ON e.s = up.id WHERE up.depth < 60), dn AS (SELECT start, start AS id, 0 AS depth FROM a UNION SELECT dn.start, e.s, dn.depth + 1 FROM dn JOIN e ON e.t = dn.id WHERE dn.depth < 60)
        SELECT start, id, 'parent' AS side, CAST(min(depth) AS BIGINT) AS depth FROM up WHERE id <> start GROUP BY start, id UNION ALL SELECT start, id, 'child', CAST(min(depth) AS BIGINT) FROM dn WHERE id <> start AND (start, id) NOT IN (SELECT start, id FROM up) GROUP BY start, id""",
    "route_execution": f"""WITH RECURSIVE c AS ({_CALLS}), r AS (SELECT DISTINCT concat_ws(':', upper(r.method), r.path) AS source, r.function_name AS target FROM (SELECT unnest(routes) AS r FROM file_symbols) WHERE r.function_name IS NOT NULL AND r.path IS NOT NULL), e AS (SELECT source, target FROM r UNION SELECT source, target FROM c),
        w AS (SELECT DISTINCT source AS start, source AS id, 0 AS depth FROM r UNION SELECT w.start, e.target, w.depth + 1 FROM w JOIN e ON e.source = w.id WHERE w.depth < 3), m AS (SELECT start, id, min(depth) AS depth FROM w WHERE id <> start GROUP BY start, id) SELECT start, count(*) AS n, CAST(max(depth) AS BIGINT) AS depth FROM m GROUP BY start""",
    "impact_sections": f"WITH c AS ({_CALLS}), {_HANDLERS}, o AS (SELECT start, count(*) AS n FROM s JOIN c ON c.source = s.start GROUP BY start), i AS (SELECT start, count(*) AS n FROM s JOIN c ON c.target = s.start GROUP BY start) SELECT start, unnest(['callees', 'dependencies']) AS section, n FROM o UNION ALL SELECT start, unnest(['callers', 'dependents']), n FROM i",
    "impact_v3": f"WITH RECURSIVE c AS ({_CALLS}), x AS (SELECT min(target) AS name FROM c), u AS (SELECT name AS id FROM x UNION SELECT c.source FROM u JOIN c ON c.target = u.id) SELECT DISTINCT 'callers' AS section, source AS name FROM c, x WHERE c.target = x.name UNION ALL SELECT DISTINCT 'callees', target FROM c, x WHERE c.source = x.name UNION ALL SELECT 'dependents', id FROM u, x WHERE id <> x.name",
    "file_closures": f"WITH RECURSIVE {_CLOSURE}, d AS (SELECT s.start, e.target AS file FROM s JOIN e ON e.source = s.start UNION SELECT d.start, e.target FROM d JOIN e ON e.source = d.file), a AS (SELECT s.start, e.source AS file FROM s JOIN e ON e.target = s.start UNION SELECT a.start, e.source FROM a JOIN e ON e.target = a.file) SELECT start, file, 'downstream' AS side FROM d UNION ALL SELECT start, file, 'affected' FROM a",
    "dependency_summaries": f"""WITH RECURSIVE {_CLOSURE}, a AS (SELECT s.start, e.source AS file FROM s JOIN e ON e.target = s.start UNION SELECT a.start, e.source FROM a JOIN e ON e.target = a.file), w AS (SELECT start, start AS id, 0 AS depth FROM s UNION SELECT w.start, e.target, w.depth + 1 FROM w JOIN e ON e.source = w.id WHERE w.depth < 60), m AS (SELECT start, id, min(depth) AS depth FROM w GROUP BY start, id)
        SELECT start, (SELECT count(*) FROM e WHERE e.source = s.start) AS direct_dependencies, (SELECT count(*) FROM e WHERE e.target = s.start) AS direct_dependents, (SELECT count(*) FROM a WHERE a.start = s.start) AS affected_files, CAST((SELECT max(depth) FROM m WHERE m.start = s.start) AS BIGINT) AS dependency_depth FROM s""",
    "repository_contexts": f"""WITH RECURSIVE c AS ({_CALLS}), {_HANDLERS}, a AS (SELECT start AS name FROM s WHERE start IN (SELECT source FROM c UNION SELECT target FROM c)), w AS (SELECT name AS start, name AS id, 0 AS depth FROM a UNION SELECT w.start, c.target, w.depth + 1 FROM w JOIN c ON c.source = w.id WHERE w.depth < 2), m AS (SELECT start, id, min(depth) AS depth FROM w GROUP BY start, id)
        SELECT 'symbols' AS section, name, 1 AS n FROM a UNION ALL SELECT unnest(['callees', 'dependencies']), name, count(*) FROM a JOIN c ON c.source = name GROUP BY name UNION ALL SELECT 'callers', name, count(*) FROM a JOIN c ON c.target = name GROUP BY name UNION ALL SELECT 'call_chains', start, count(*) FROM m WHERE id <> start GROUP BY start""",
    "investigation_contexts": f"""WITH RECURSIVE c AS ({_CALLS}), {_HANDLERS}, a AS (SELECT start AS name FROM s WHERE start IN (SELECT source FROM c UNION SELECT target FROM c)), w AS (SELECT name AS start, name AS id, 0 AS depth FROM a UNION SELECT w.start, c.target, w.depth + 1 FROM w JOIN c ON c.source = w.id WHERE w.depth < 2), m AS (SELECT start, id, min(depth) AS depth FROM w GROUP BY start, id)
        SELECT 'symbols' AS section, name AS source, '' AS relationship, 1 AS n FROM a UNION ALL SELECT 'dependencies', name, 'DEPENDS_ON', count(*) FROM a JOIN c ON c.source = name GROUP BY name UNION ALL SELECT 'dependencies', source, 'CALLS', count(*) FROM c WHERE source IN (SELECT name FROM a) OR target IN (SELECT name FROM a) GROUP BY source
        UNION ALL SELECT 'call_chains', start, 'CALLS', count(*) FROM m WHERE id <> start GROUP BY start UNION ALL SELECT 'routes', r, '', 1 FROM (VALUES ('POST:/a'), ('GET:/tokens/session')) v(r)""",
    "evidence_expansion": f"""WITH c AS ({_CALLS}), {_HANDLERS}, b AS (SELECT start AS name, 1.0::DOUBLE / length(start) AS score, length(start) AS ord FROM s), a AS (SELECT * FROM b WHERE name IN (SELECT source FROM c UNION SELECT target FROM c)),
        r AS (SELECT 'symbol' AS source, name, score, ord, 0 AS step FROM b UNION ALL SELECT 'file', file_path, max(score), 0, 0 FROM ranked_file WHERE score IS NOT NULL GROUP BY file_path UNION ALL SELECT 'symbol', c.target, a.score * 0.75::DOUBLE, a.ord, 1 FROM a JOIN c ON c.source = a.name UNION ALL SELECT 'symbol', c.source, a.score * 0.85::DOUBLE, a.ord, 2 FROM a JOIN c ON c.target = a.name UNION ALL SELECT 'symbol', c.target, a.score * 0.80::DOUBLE, a.ord, 3 FROM a JOIN c ON c.source = a.name),
        k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, ord, step) AS x FROM r) WHERE x = 1) SELECT source, count(*) AS n, round(max(score), 6) AS best, round(min(score), 6) AS least FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, ord, step, name) AS y FROM k) WHERE y <= 20 GROUP BY source""",
    "evidence_package": """WITH n AS (SELECT DISTINCT id, type, name, replace(replace(lower(name), '_', ' '), '-', ' ') AS m, lower(type) AS k FROM graph_node WHERE id IS NOT NULL), h AS (SELECT DISTINCT CASE WHEN k = 'route' THEN 'routes' WHEN k IN ('class', 'function', 'method') THEN 'symbols' END AS section, name, CASE WHEN m = 'token' THEN 40 WHEN contains(m, 'token') THEN 20 ELSE 0 END + CASE WHEN contains(m, 'token') THEN CASE WHEN k = 'file' THEN 10 WHEN k IN ('class', 'function', 'method', 'symbol') THEN 20 WHEN k = 'route' THEN 50 ELSE 5 END ELSE 0 END AS score FROM n WHERE contains(lower(name), 'token')),
        t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, lower(name), name) AS ord FROM h WHERE section IS NOT NULL AND score > 0) WHERE ord <= CASE section WHEN 'symbols' THEN 25 ELSE 10 END),
        u AS (SELECT DISTINCT file_path AS file, c.line AS line, c.target AS name FROM (SELECT file_path, unnest(calls) AS c FROM file_symbols) WHERE c.target IN (SELECT name FROM t WHERE section = 'symbols')), v AS (SELECT *, row_number() OVER (ORDER BY file NULLS FIRST, line NULLS FIRST, name) AS ord FROM u),
        g AS (SELECT file_path, max(score) AS score FROM ranked_file WHERE score IS NOT NULL GROUP BY file_path) SELECT section, ord, name AS value FROM t UNION ALL SELECT 'references', ord, concat_ws(':', file, line, name) FROM v WHERE ord <= 50 UNION ALL SELECT 'files', ord, file_path FROM (SELECT *, row_number() OVER (ORDER BY score DESC, file_path) AS ord FROM g) WHERE ord <= 20""",
    "semantic_lookup": f"WITH RECURSIVE c AS ({_CALLS}), n AS (SELECT source AS name FROM c UNION SELECT target FROM c), x AS (SELECT min(source) AS name FROM c), u AS (SELECT name AS id, 0 AS depth FROM x UNION SELECT c.target, u.depth + 1 FROM u JOIN c ON c.source = u.id WHERE u.depth < 10) SELECT 'symbols' AS section, name AS value FROM n WHERE name IN ('where', 'is', 'handled') OR name IN (SELECT name FROM x) UNION SELECT 'symbols', id FROM u UNION SELECT 'routes', name FROM x",
    "discovered_files": "WITH f AS " + _FILES + ", s AS (SELECT path, CAST(" + " + ".join(f"CASE WHEN contains(lower(path), '{k}') THEN 10.0 ELSE 0.0 END" for k in ("debug", "fix", "route", "session", "token")) + " AS DOUBLE) AS score FROM f) SELECT path, score FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 25",
    "composite_scores": "WITH f AS (SELECT f.path AS path, max(f.content) AS content, max(requested_at) AS modified FROM (SELECT unnest(files) AS f, requested_at FROM prompt_request) WHERE f.path IS NOT NULL AND f.content IS NOT NULL GROUP BY f.path), s AS (SELECT path, md5(content) AS digest, CAST("
    + " + ".join(f"CASE WHEN contains(lower(path), '{k}') THEN 1.0 ELSE 0.0 END + CASE WHEN strlen(content) <= 20480 AND contains(lower(content), '{k}') THEN 0.5 ELSE 0.0 END" for k in ("debug", "fix", "route", "session", "token"))
    + " + CASE WHEN epoch(TIMESTAMP '2026-07-01') - floor(epoch(modified)) < 3600 THEN 3.0 WHEN epoch(TIMESTAMP '2026-07-01') - floor(epoch(modified)) < 86400 THEN 2.0 WHEN epoch(TIMESTAMP '2026-07-01') - floor(epoch(modified)) < 604800 THEN 1.0 ELSE 0.0 END + CASE WHEN regexp_extract(lower(path), '[^/]+$') IN ('main.py', 'app.py', 'server.py', 'index.py', 'main.js', 'index.js', 'app.js', 'server.js', 'main.ts', 'index.ts', 'app.ts', 'main.dart', 'app.dart', 'main.go', 'main.rb', 'main.rs') THEN 2.0 ELSE 0.0 END + CASE WHEN contains(lower(path), 'src/main.py') OR contains('src/main.py', lower(path)) THEN 5.0 ELSE 0.0 END + CASE WHEN contains(lower(path), 'config') OR contains('config', lower(path)) THEN 5.0 ELSE 0.0 END AS DOUBLE) AS score FROM f) SELECT path, digest, score FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 50",
    "question_grammar": f"WITH {_QUESTIONS} SELECT q, intent_type, first, second FROM p",
    "question_answers": f"WITH {_QUESTIONS}, a AS (SELECT q, source AS answer FROM p JOIN c ON c.target = first WHERE intent_type = 'who_calls' UNION ALL SELECT q, target FROM p JOIN c ON c.source = first WHERE intent_type = 'what_does_call') SELECT q, count(DISTINCT answer) AS n, min(answer) AS first_answer FROM a GROUP BY q",
    "task_routing": rf"""WITH d AS (SELECT DISTINCT request_id, coalesce(intent, '') || ' ' || coalesce(substr(conversation, 1, 2000), '') AS x FROM prompt_request), b AS (SELECT request_id, lower(x) AS t FROM d WHERE regexp_replace(x, '\s', '', 'g') <> ''), s AS (SELECT request_id, {_TASK} FROM b), g AS (SELECT *, greatest(debug, research, code, explain, design) AS b FROM s), k AS (SELECT DISTINCT request_id, CASE WHEN b = 0 THEN 'general' WHEN debug = b THEN 'debug' WHEN research = b THEN 'research' WHEN code = b THEN 'code' WHEN explain = b THEN 'explain' ELSE 'design' END AS task_type FROM g)
        SELECT request_id, task_type, CASE task_type WHEN 'research' THEN 'gemini' ELSE 'claude' END AS recommended, CASE task_type WHEN 'research' THEN 'Gemini' ELSE 'Claude' END AS display, CASE task_type WHEN 'debug' THEN 'Claude handles long-context debugging and tracing best' WHEN 'code' THEN 'Claude is strongest at code generation and review' WHEN 'explain' THEN 'Claude gives thorough, structured explanations' WHEN 'research' THEN 'Gemini has live web access for current information' WHEN 'design' THEN 'Claude excels at architecture and system design' ELSE 'Claude handles complex open-ended tasks best' END AS reason FROM k""",
    "next_steps": r"""WITH t AS (SELECT request_id, conversation AS x FROM prompt_request WHERE conversation IS NOT NULL UNION SELECT -doc_id, text FROM documents WHERE text IS NOT NULL),
        m AS (SELECT request_id, lower(x) AS l, regexp_extract_all(x, '\b(GET|POST|PATCH|PUT|DELETE)\s+(/[a-zA-Z0-9_/.<>?=&\-]+)', 1)[-1] || ' ' || regexp_extract_all(x, '\b(GET|POST|PATCH|PUT|DELETE)\s+(/[a-zA-Z0-9_/.<>?=&\-]+)', 2)[-1] AS r, regexp_extract_all(x, '`([^`]+\.[a-zA-Z0-9_]{2,5})`', 1) AS a, regexp_extract_all(x, '`([^`\n]+\.[a-zA-Z0-9_]{2,5})`', 1) AS f FROM t),
        k AS (SELECT *, CASE WHEN contains(l, 'paste these files') OR contains(l, 'paste the files') THEN 1 WHEN contains(l, 'what i need next') OR contains(l, 'next step') THEN 2 WHEN contains(l, '404') AND (contains(l, 'missing') OR contains(l, 'not found')) THEN 3 WHEN contains(l, 'serialization') OR contains(l, 'contract') OR contains(l, 'tojson') OR contains(l, 'fromjson') THEN 4 ELSE 0 END AS k FROM m)
        SELECT DISTINCT request_id, ['Analyzed conversation', 'AI requested specific files to be pasted', 'AI outlined next steps', 'Identified missing route causing 404', 'Investigating JSON serialization contract mismatch'][k + 1] AS last_ai_action,
          CASE k WHEN 1 THEN 'Paste the requested files into the conversation' WHEN 2 THEN 'Follow the AI''s outlined next steps' WHEN 3 THEN coalesce('Implement missing ' || r || ' endpoint', 'Review conversation and continue debugging') WHEN 4 THEN 'Compare toJson/fromJson between server and client models' ELSE 'Review conversation and continue debugging' END AS next_step,
          CASE k WHEN 1 THEN CASE WHEN len(a) > 0 THEN 'Here are the requested files: ' || array_to_string(a[greatest(1, len(a) - 3):], ', ') ELSE '' END WHEN 3 THEN coalesce('Implement ' || r || ' endpoint as discussed', '') WHEN 4 THEN 'Verify JSON contract between server and Flutter models' ELSE '' END AS suggested_intent,
          coalesce(array_to_string(list_filter(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN list_position(f, f[i]) = i THEN f[i] END), lambda x: x IS NOT NULL)[1:6], ','), '') AS likely_files FROM k""",
    "prompt_compose": rf"WITH {_PACKAGE} SELECT DISTINCT request_id, md5(regexp_replace(markdown, '^\s+|\s+$', '', 'g')) AS markdown, md5(regexp_replace(plain, '^\s+|\s+$', '', 'g')) AS plain FROM m",
    "prompt_targets": f"WITH {_PACKAGE} SELECT DISTINCT request_id, md5(CASE request_id % 5 WHEN 0 THEN {_quoted(prompts.TARGETS['claude'])} || markdown WHEN 1 THEN {_quoted(prompts.TARGETS['gemini'])} || markdown WHEN 2 THEN {_quoted(prompts.TARGETS['local'])} || plain WHEN 3 THEN plain ELSE markdown END) AS digest FROM m",
    "prompt_short": f"SELECT DISTINCT request_id, md5(concat_ws({_SEP}, 'I am working on the following problem:' || {_NL} || coalesce(intent, ''), 'Here are the relevant files:' || {_NL} || {_NL} || {_FILE_PART}, CASE WHEN length(expected) > 0 THEN 'Expected behavior:' || {_NL} || expected END, CASE WHEN length(actual) > 0 THEN 'Current behavior / what is going wrong:' || {_NL} || actual END, 'Please help me fix this. I am sending this to ' || coalesce(target, 'any') || '.')) AS digest FROM prompt_request",
    "prompt_repository": f"""SELECT DISTINCT request_id, md5(concat_ws({_SEP}, CASE WHEN task_type = 'debug' THEN 'I have a bug I need help debugging.' END, CASE WHEN length(conversation_summary) > 0 THEN 'Context from our previous conversation:' || {_NL} || conversation_summary WHEN length(conversation) > 0 THEN 'Here is the conversation so far:' || {_NL} || {_NL} || substr(conversation, 1, 4000) END,
        'GitHub Repository: o/' || project_name || {_NL} || CASE WHEN length(extra_context) > 0 THEN {_NL} || 'README:' || {_NL} || substr(extra_context, 1, 1500) ELSE '' END || CASE WHEN length(intent) > 0 THEN {_NL} || 'File structure:' || {_NL} || intent ELSE '' END, CASE WHEN length(intent) > 0 THEN CASE WHEN task_type = 'debug' THEN 'Bug description:' || {_NL} || intent ELSE intent END END, CASE WHEN length(extra_context) > 0 THEN 'Additional context:' || {_NL} || extra_context END,
        'Relevant files:' || {_NL} || {_NL} || {_FILE_PART}, CASE WHEN length(expected) > 0 THEN 'Expected behavior:' || {_NL} || expected END, CASE WHEN length(actual) > 0 THEN 'Current behavior / what is going wrong:' || {_NL} || actual END, CASE WHEN task_type = 'debug' THEN 'Please identify the root cause and provide a specific fix.' END)) AS digest FROM prompt_request""",
    "prompt_v2": rf"""WITH r AS (SELECT request_id, coalesce(intent, '') AS i, list_transform(list_filter(coalesce(files, []), lambda x: x IS NOT NULL AND x.path IS NOT NULL), lambda x: x.path)[1:20] AS f, list_filter([expected, actual], lambda x: x IS NOT NULL) AS a, coalesce(conversation, '') AS t FROM prompt_request),
        m AS (SELECT *, regexp_extract_all(t, '(?i)\b(GET|POST|PUT|PATCH|DELETE)\s+(/[/a-zA-Z0-9_\-]*)', 1) AS v, regexp_extract_all(t, '(?i)\b(GET|POST|PUT|PATCH|DELETE)\s+(/[/a-zA-Z0-9_\-]*)', 2) AS p FROM r)
        SELECT DISTINCT request_id, md5(concat_ws({_NL} || {_NL}, 'INVESTIGATION ISSUE' || {_NL} || {_NL} || i, CASE WHEN len(f) > 0 THEN 'RELEVANT FILES' || {_NL} || {_NL} || array_to_string(list_transform(f, lambda x: '- ' || x), {_NL}) END, CASE WHEN len(v) > 0 THEN 'ROUTE CONTEXT' || {_NL} || {_NL} || array_to_string(list_transform(range(1, len(v) + 1), lambda k: upper(v[k]) || ':' || p[k]), {_NL}) END, CASE WHEN len(a) > 0 THEN 'FACTS' || {_NL} || {_NL} || array_to_string(list_transform(a, lambda x: '- ' || x), {_NL}) END, {_quoted(context.INSTRUCTIONS)})) AS digest FROM m""",
    "investigation_results": "WITH ev AS (SELECT evidence_id, content, collected_at FROM evidence UNION ALL SELECT 'request', 'Why does the service return 404 after a timeout', NULL), " + _FACTS.replace("FROM evidence)", "FROM ev)") + f", {_HYPS}, r AS (SELECT statement, CAST(round(0.5 + 0.1 * n_support, 2) AS DOUBLE) AS c, rule FROM h) SELECT (SELECT count(*) FROM f) AS n_facts, (SELECT count(*) FROM h) AS n_hypotheses, statement, least(1.0::DOUBLE, c) AS confidence, 'root_cause' AS investigation_type, 'backend' AS domain FROM r ORDER BY least(1.0, c) DESC, rule LIMIT 1",
    "symbol_rows": _values("file_path, kind, name, owner, detail, line, items", [
        ("a.py", "import", "os.path", "", "", 1, ""), ("a.py", "import", "pkg", "", "A", 2, ""), ("a.py", "import", "pkg", "", "C", 2, ""), ("a.py", "class", "Base", "", "", 3, ""), ("a.py", "class", "Service", "", "", 4, "Base"), ("a.py", "inherit", "Base", "Service", "", 4, ""),
        ("a.py", "method", "helper", "Service", "", 5, ""), ("a.py", "decorator", "app.get", "login", "", 6, ""), ("a.py", "call", "app.get", "login", "", 6, ""), ("a.py", "method", "login", "Service", "", 7, "app.get"), ("a.py", "route", "/users", "login", "GET", 7, "fastapi"),
        ("a.py", "call", "self.helper", "login", "", 8, ""), ("a.py", "method_call", "Service.helper", "Service.login", "", 8, ""), ("a.py", "call", "Other", "login", "", 9, ""), ("a.py", "instantiation", "Other", "login", "", 9, ""), ("a.py", "call", "s.run", "login", "", 10, ""), ("a.py", "method_call", "Other.run", "Service.login", "", 10, ""),
        ("a.py", "call", "Other", "login", "", 11, ""), ("a.py", "instantiation", "Other", "login", "", 11, ""), ("a.py", "method_call", "Other.stop", "Service.login", "", 11, ""), ("a.py", "decorator", "app.route", "handler", "", 12, ""), ("a.py", "call", "app.route", "handler", "", 12, ""),
        ("a.py", "function", "handler", "", "", 13, "app.route"), ("a.py", "route", "/r", "handler", "GET", 13, "flask"), ("a.py", "route", "/r", "handler", "POST", 13, "flask"), ("a.py", "call", "Service", "handler", "", 13, ""), ("a.py", "instantiation", "Service", "handler", "", 13, ""),
        ("a.py", "function", "later", "", "", 14, ""), ("a.py", "call", "go", "later", "", 14, ""), ("b.py", "error", "SyntaxError", "", "", 1, ""), ("d.py", "class", "Other", "", "", 1, ""), ("d.py", "method", "run", "Other", "", 2, ""), ("d.py", "method", "stop", "Other", "", 3, ""),
    ]),
    "symbol_rows_v1": _values("file_path, kind, name, end_line", [("a.py", "class", "Base", 3), ("a.py", "class", "Service", 11), ("a.py", "function", "handler", 13), ("a.py", "method", "helper", 5), ("a.py", "method", "login", 11), ("d.py", "class", "Other", 3), ("d.py", "method", "run", 2), ("d.py", "method", "stop", 3)]),
    "name_references": _values("name, context, n, first_line", [("Base", "name", 1, 4), ("Other", "name", 2, 9), ("Service", "name", 1, 13), ("Other", "call", 2, 9), ("Service", "call", 1, 13), ("helper", "call", 1, 8), ("run", "call", 1, 10), ("stop", "call", 1, 11), ("login", "call", 1, 13), ("helper", "attribute", 1, 8), ("run", "attribute", 1, 10), ("stop", "attribute", 1, 11), ("login", "attribute", 1, 13)]),
    "route_index": _values("path, method, file_path, line, handler, framework, parameters", [("/a", "GET", "e.js", 1, "unknown", "express", ""), ("/b", "POST", "e.js", 3, "unknown", "express", ""), ("/c", "GET", "f.dart", 1, "unknown", "shelf", ""), ("/r", "GET", "a.py", 13, "handler", "flask", ""), ("/r", "POST", "a.py", 13, "handler", "flask", ""), ("/users", "GET", "a.py", 7, "login", "fastapi", "")]),
    "method_calls": _values("caller_symbol, callee_symbol, caller_file, callee_file, line_number", [("Service.login", "Other.run", "a.py", "d.py", 10), ("Service.login", "Other.stop", "a.py", "d.py", 11), ("Service.login", "Service.helper", "a.py", "a.py", 8)]),
    "graph_v3_reach": _values("start, id, depth", [("Service.login", "Other.run", 1), ("Service.login", "Other.stop", 1), ("Service.login", "Service.helper", 1)]),
    "callable_lookup": _values("query, id, type", [("Service.login", "Service.login", "method"), ("run", "Other.run", "method")]),
    "answers": "SELECT question, capability, CAST(confidence AS DOUBLE) AS confidence, evidence FROM (" + _values("question, capability, confidence, evidence", [("Show handler execution flow", "call_chain", 0.95, "Service,app.route,handler"), ("Where is Service handled?", "where_is_symbol", 0.95, "Service,handler"), ("hello", "unknown", 0.0, "")]) + ")",
}
