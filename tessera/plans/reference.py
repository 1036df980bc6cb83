"""Queries of the repository and investigation operators, with DuckDB SQL.

Every query runs over its whole tables. Repeated rows of a table count once:
tables are made distinct on the columns that a query reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as tx
from tessera.operators import analysis, graph, logs, prompts, ranking, routes
from tessera.plans import ask
from tessera.session import stage, table
from tessera.sources import projects, repository, stores
from tessera.streaming import events

ISSUE = "Debug the session token that the upload route /tokens/session rejects"


def _files(spark, base, *cols) -> DataFrame:
    """Index rows, one of each."""
    return table(spark, base, "file_symbols").select("file_id", *cols).distinct()


def _lines(spark, base) -> DataFrame:
    """(src, l): the lines of both streams of the runs, within the row. Repeated
    runs are made one after an operator has made them small."""
    runs = table(spark, base, "terminal_run").select("run_id", F.explode(F.array(*[F.struct(F.lit(c).alias("o"), F.col(c).alias("t")) for c in ("stdout", "stderr")])).alias("s"))
    return logs.in_rows(runs.select(F.concat_ws(":", "s.o", "run_id").alias("k"), F.col("s.t").alias("t")), "k", "t")


def _calls(spark, base) -> DataFrame:
    """Distinct calls between named functions."""
    c = table(spark, base, "file_symbols").select(F.explode("calls").alias("c")).filter("c.caller is not null and c.target is not null")
    return c.select(F.col("c.caller").alias("source"), F.col("c.target").alias("target")).distinct()


def _call_graph(spark, base) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the calls: their ends by name."""
    e = stage(_calls(spark, base).withColumn("relationship", F.lit(graph.CALLS)), "calls")
    n = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct()
    return n.select("id", F.lit("FUNCTION").alias("type"), F.col("id").alias("name"), F.lit(0).alias("ord")), e


def _built(spark, base) -> tuple[DataFrame, DataFrame]:
    return graph.build_v2(table(spark, base, "file_symbols"))


def _symbols(spark, base) -> DataFrame:
    """(file, type, name, line) of classes, functions and methods, distinct."""
    f = table(spark, base, "file_symbols")
    one = lambda c, t: f.select(F.col("file_path").alias("file"), F.lit(t).alias("type"), F.explode(c).alias("x")).select("file", "type", F.col("x.name").alias("name"), F.coalesce("x.line", F.lit(0)).alias("line"))
    return one("classes", "class").unionByName(one("functions", "function")).unionByName(one("methods", "method")).filter("name is not null").distinct()


def _imports(spark, base) -> DataFrame:
    """(source, module, imported, line, target): import rows with their files."""
    f = table(spark, base, "file_symbols")
    i = f.select("file_id", F.col("file_path").alias("source"), F.explode("imports").alias("x")).filter("x.module is not null").select("file_id", "source", "x.module", "x.imported", "x.line").distinct()
    return graph.longest_prefix(i, _modules(spark, base)).select("source", "module", "imported", "line", F.col("file").alias("target"))


def _modules(spark, base) -> DataFrame:
    """(name, file): folders as packages, the first file of each."""
    m = table(spark, base, "file_symbols").select(F.regexp_replace(F.regexp_replace("file_path", r"/[^/]*$|^src/", ""), "/", ".").alias("name"), F.col("file_path").alias("file"))
    return m.groupBy("name").agg(F.min("file").alias("file"))


# ------------------------------------------------------------------ graph
def graph_nodes_v2(spark: SparkSession, base: str) -> DataFrame:
    """The nodes of the built graph."""
    return _built(spark, base)[0].select("id", "type", "name")


def graph_edges_v2(spark: SparkSession, base: str) -> DataFrame:
    """The distinct edges of the built graph."""
    return _built(spark, base)[1].select("source", "target", "relationship")


def find_node_first_wins(spark: SparkSession, base: str) -> DataFrame:
    """One node a name and project: the first that is no external symbol."""
    n = table(spark, base, "graph_node").select(F.concat_ws("/", "project_name", "name").alias("name"), "id", F.upper("type").alias("type"), F.col("node_key").alias("ord")).filter("id is not null").distinct()
    return graph.first_wins(n).select("name", "id", "type", "ord")


def search_nodes_substring(spark: SparkSession, base: str) -> DataFrame:
    n = table(spark, base, "graph_node").select("node_key", "name").distinct()
    return graph.search_nodes(n, "Token")


def node_type_counts(spark: SparkSession, base: str) -> DataFrame:
    return graph.type_counts(table(spark, base, "graph_node").select("node_key", F.upper("type").alias("type")).distinct())


def callers_callees(spark: SparkSession, base: str) -> DataFrame:
    """Numbers of distinct callers and callees of each symbol."""
    nodes, edges = _call_graph(spark, base)
    rows = None
    for incoming, callers in ((True, 1), (False, 0)):
        near = graph.neighbours(nodes, edges, [graph.CALLS], incoming=incoming).select(F.col("from_id").alias("name"), F.lit(callers).alias("i"), F.lit(1 - callers).alias("o"))
        rows = near if rows is None else rows.unionByName(near)
    return rows.groupBy("name").agg(F.sum("i").alias("n_callers"), F.sum("o").alias("n_callees"))


def definition_reference_join(spark: SparkSession, base: str) -> DataFrame:
    """Each defined name with its last definition and its references."""
    r = table(spark, base, "file_symbols").select("file_id", F.col("file_path").alias("file"), F.explode("calls").alias("c")).filter("c.target is not null").select("file_id", "file", F.col("c.target").alias("name"), F.col("c.line").alias("line")).distinct()
    return graph.definition_index(_symbols(spark, base), r)


def longest_prefix_resolution(spark: SparkSession, base: str) -> DataFrame:
    """Imported modules with the file of the longest known prefix."""
    i = table(spark, base, "file_symbols").select(F.explode("imports").alias("x")).filter("x.module is not null").select(F.col("x.module").alias("module")).distinct()
    return graph.longest_prefix(i, _modules(spark, base)).select("module", "file")


def bounded_bfs(spark: SparkSession, base: str) -> DataFrame:
    """What each route handler reaches within three calls."""
    starts = table(spark, base, "file_symbols").select(F.explode("routes").alias("r")).filter("r.function_name is not null").select(F.col("r.function_name").alias("start")).distinct()
    return graph.reach(_calls(spark, base), starts, 3).groupBy("start").agg(F.count("*").alias("n_reached"), F.max("depth").cast("bigint").alias("depth"))


def upstream_closure(spark: SparkSession, base: str) -> DataFrame:
    """All descendants of each base class, whatever the depth."""
    e = table(spark, base, "file_symbols").select(F.explode("inherits").alias("i")).filter("i.class_name is not null and i.parent is not null").select(F.col("i.class_name").alias("source"), F.col("i.parent").alias("target")).distinct()
    return graph.reach(e, e.select(F.col("target").alias("start")), None, incoming=True).select("start", "id", F.col("depth").cast("bigint").alias("depth"))


def impact_counts(spark: SparkSession, base: str) -> DataFrame:
    """Transitive callers within four calls of the functions that routes call."""
    starts = table(spark, base, "file_symbols").select(F.explode("routes").alias("r")).filter("r.function_name is not null").select(F.col("r.function_name").alias("start")).distinct()
    return graph.reach(_calls(spark, base), starts, 4, incoming=True).groupBy("start", "depth").agg(F.count("*").alias("n")).withColumn("depth", F.col("depth").cast("bigint"))


def adjacency_lists(spark: SparkSession, base: str) -> DataFrame:
    a = graph.adjacency(_calls(spark, base))
    return a.select("source", "n", F.array_join("targets", ",").alias("targets"))


def file_dependencies(spark: SparkSession, base: str) -> DataFrame:
    """Files that a file's imports mean, with the number of import rows."""
    return _imports(spark, base).filter("target is not null").groupBy("source", "target").agg(F.count("*").alias("n_imports"))


def symbol_dependencies(spark: SparkSession, base: str) -> DataFrame:
    """Modules and names that each file imports, resolved or not."""
    return _imports(spark, base).groupBy("source", "module").agg(F.count("*").alias("n_rows"), F.count("imported").alias("n_names"), F.max(F.col("target").isNotNull()).alias("resolved"))


def route_catalogue(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "file_symbols").select(F.explode("routes").alias("r")).filter("r is not null")
    return routes.catalogue(r.select("r.path", "r.method", F.col("r.function_name").alias("handler")))


# ---------------------------------------------------------------- ranking
def node_relevance(spark: SparkSession, base: str) -> DataFrame:
    n = table(spark, base, "graph_node").select("node_key", "type", "name", "metadata")
    return ranking.node_relevance(n, ISSUE, "metadata").groupBy("node_key").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "node_key").limit(50)


def evidence_text_score(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "evidence").select("evidence_id", "content")
    return ranking.text_score(e, "content", "timeout session route").select("evidence_id", "score").distinct()


def file_rank_topk(spark: SparkSession, base: str) -> DataFrame:
    f = table(spark, base, "file_symbols")
    names = _symbols(spark, base).select(F.col("file").alias("file_path"), "type", "name").distinct()
    routes_ = f.select("file_path", F.explode("routes").alias("r")).select("file_path", "r.path").filter("path is not null").distinct()
    imports = _imports(spark, base).filter("target is not null").select("source", "target")
    got = ranking.file_ranking(f.select("file_path").distinct(), names, routes_, imports, ISSUE, 20)
    return got.select("file_path", "score", F.array_join("reasons", "; ").alias("reasons"))


def ranked_files_topk(spark: SparkSession, base: str) -> DataFrame:
    """The five best files of each project."""
    r = table(spark, base, "ranked_file").select("rank_id", "project_name", "file_path", "score").filter("score is not null and project_name is not null").distinct()
    return ranking.top_per_group(r, "project_name", [F.desc("score"), F.col("rank_id")], 5).select("project_name", F.col("rank").cast("bigint").alias("rank"), "rank_id", "file_path", "score")


def token_frequency(spark: SparkSession, base: str) -> DataFrame:
    """In how many documents each identifier stands."""
    d = table(spark, base, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("n_docs"))


# ------------------------------------------------------------------- text
def extract_keywords(spark: SparkSession, base: str) -> DataFrame:
    """Keywords of each request's intent and conversation."""
    c = table(spark, base, "prompt_request").select("request_id", F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("t")) for x in ("intent", "conversation")])).alias("s"))
    return c.select("request_id", "s.field", F.array_join(tx.keywords(F.col("s.t")), ",").alias("keywords")).distinct()


def path_params(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "file_symbols").select(F.explode("routes").alias("r")).select(F.col("r.path").alias("path")).filter("path is not null").distinct()
    return r.select("path", F.array_join(tx.path_parameters(F.col("path")), ",").alias("params"))


def camel_to_snake(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "file_symbols").select(F.explode("classes").alias("c")).select(F.col("c.name").alias("name")).filter("name is not null").distinct()
    return c.select("name", tx.camel_to_snake(F.col("name")).alias("snake"))


def route_mentions(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents").filter("text is not null")
    return d.select("doc_id", F.array_join(tx.route_mentions(F.col("text")), ",").alias("routes"))


def classify_task(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents").filter("text is not null")
    return d.select("doc_id", tx.task_type(F.col("text")).alias("task"))


def rule_summary(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "prompt_request").select("request_id", "conversation").filter("conversation is not null")
    return c.select("request_id", tx.rule_summary(F.col("conversation")).alias("summary")).distinct()


def route_query_rules(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "prompt_request").select("request_id", "intent").distinct()
    return c.select("request_id", ask.routed(F.col("intent"))["capability"].alias("capability"))


def intent_rules(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "prompt_request").select("request_id", "intent").distinct()
    i = analysis.intent(F.col("intent"))
    return c.select("request_id", i["investigation_type"].alias("investigation_type"), i["domain"].alias("domain"), i["confidence"].alias("confidence"), analysis.repository_intent(F.col("intent")).alias("question"))


def chunk_evidence(spark: SparkSession, base: str) -> DataFrame:
    """Pieces of 20 lines, the last line end of a text opening no line."""
    e = table(spark, base, "evidence").select("evidence_id", "content")
    c = logs.chunks(e, "evidence_id", "content", 20)
    return c.select(F.col("parent").alias("evidence_id"), *[F.col(x).cast("bigint").alias(x) for x in ("chunk_index", "total_chunks", "start_line", "end_line")], F.md5("content").alias("digest")).distinct()


def chunk_gaps(spark: SparkSession, base: str) -> DataFrame:
    """Parents of which not all pieces are there."""
    c = table(spark, base, "evidence_chunk").filter("parent_evidence_id is not null").groupBy("parent_evidence_id").agg(F.countDistinct("chunk_index").alias("n_there"), F.max("total_chunks").cast("bigint").alias("n_wanted"))
    return c.filter("n_there < n_wanted")


# ------------------------------------------------------------------- logs
def _spans(lines: DataFrame, kept, name: str) -> DataFrame:
    """(src, number, first and last position) of the lines that an operator
    keeps, where it keeps any; the array is made once."""
    one = lambda v: F.struct(F.size(v).cast("bigint").alias("n"), F.get(v, F.lit(0))["pos"].cast("bigint").alias("first_pos"), F.get(v, F.size(v) - 1)["pos"].cast("bigint").alias("last_pos"))
    made = F.filter(F.transform(F.array(kept), one), lambda x: x["n"] > 0)
    return lines.select("src", F.explode(made).alias("x")).select("src", F.col("x.n").alias(name), "x.first_pos", "x.last_pos").distinct()


def log_error_filter(spark: SparkSession, base: str) -> DataFrame:
    return _spans(_lines(spark, base), logs.error_lines_of(F.col("l")), "n_errors").drop("last_pos")


def log_dedupe_consecutive(spark: SparkSession, base: str) -> DataFrame:
    return _lines(spark, base).select("src", F.size(logs.without_repeats_of(F.col("l"))).cast("bigint").alias("n_lines")).distinct()


def log_error_context(spark: SparkSession, base: str) -> DataFrame:
    return _lines(spark, base).select("src", F.explode(logs.error_context_of(F.col("l"))).alias("x")).select("src", F.col("x.pos").cast("bigint").alias("pos"), "x.line").distinct()


def log_trace_sessions(spark: SparkSession, base: str) -> DataFrame:
    return _lines(spark, base).select("src", F.explode(logs.stack_traces_of(F.col("l"))).alias("t")).select("src", F.col("t.first_pos").cast("bigint").alias("first_pos"), F.col("t.last_pos").cast("bigint").alias("last_pos"), "t.trace").distinct()


def log_head_tail(spark: SparkSession, base: str) -> DataFrame:
    n = F.size("l").cast("bigint")
    return _lines(spark, base).select("src", F.size(logs.head_and_tail_of(F.col("l"), most=20, head=5, tail=10)).cast("bigint").alias("n_kept"), n.alias("n_lines"), (n > 20).alias("was_trimmed")).distinct()


def log_investigation_view(spark: SparkSession, base: str) -> DataFrame:
    return _spans(_lines(spark, base), logs.investigation_view_of(F.col("l")), "n_lines")


# --------------------------------------------------------------- analysis
def _facts(spark, base) -> DataFrame:
    e = table(spark, base, "evidence").select("evidence_id", "content", "collected_at")
    return analysis.facts(e, "evidence_id", "content", "collected_at")


def fact_extract(spark: SparkSession, base: str) -> DataFrame:
    return _facts(spark, base)


def hypothesis_generate(spark: SparkSession, base: str) -> DataFrame:
    return analysis.hypotheses(_facts(spark, base)).select("id", "statement", "n_support", "score", "status")


def root_cause_rank(spark: SparkSession, base: str) -> DataFrame:
    return analysis.root_causes(analysis.hypotheses(_facts(spark, base))).select(F.col("rank").cast("bigint").alias("rank"), "statement", "confidence")


def missing_evidence(spark: SparkSession, base: str) -> DataFrame:
    """What each request's plan lacks; all requests have repository code."""
    c = table(spark, base, "prompt_request").select("request_id", "intent").distinct()
    i = analysis.intent(F.col("intent"))
    r = c.select("request_id", i["investigation_type"].alias("investigation_type"), i["domain"].alias("domain"))
    plan = analysis.evidence_plan(r, r.select("request_id", F.lit("repository_code").alias("evidence_type")))
    return plan.filter("missing").select("request_id", "evidence_type", F.col("priority").cast("bigint").alias("priority"))


# --------------------------------------------------------------- sessions
def timeline_recent(spark: SparkSession, base: str) -> DataFrame:
    """The last three events of each user."""
    e = table(spark, base, "events").select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("seq"), "event_id", "event_type")
    return stores.recent(e, 3).select("session", "event_id", "event_type")


def session_stats(spark: SparkSession, base: str) -> DataFrame:
    """Counts of evidence, pieces, runs and requests by project."""
    one = lambda t, k: table(spark, base, t).select(k, F.col("project_name").alias("session")).distinct()
    return stores.session_stats(one("ranked_file", "rank_id"), one("prompt_request", "request_id"), one("evidence", "evidence_id"), one("terminal_run", "run_id"))


def event_windows(spark: SparkSession, base: str) -> DataFrame:
    """Events by hour and kind: the plan of the stream over all that is there."""
    e = events.event_counts(table(spark, base, "events"), "ts", "event_type")
    return e.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def extension_histogram(spark: SparkSession, base: str) -> DataFrame:
    return repository.extension_histogram(_files(spark, base, "file_path"), "file_path")


def repo_fingerprint(spark: SparkSession, base: str) -> DataFrame:
    f = _files(spark, base, "project_name", F.col("file_path").alias("path"), F.col("n_bytes").alias("length"))
    return repository.fingerprint(f, "project_name").select("project_name", "n_files", "n_bytes", F.col("fingerprint").cast("string").alias("fingerprint"))


def terminal_blocks(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "terminal_run").select("run_id", "command", "exit_code", "stdout", "stderr")
    e = repository.terminal_evidence(r)
    return e.select("run_id", F.md5("content").alias("digest"), F.col("stdout_length").cast("bigint").alias("stdout_length"), F.col("stderr_length").cast("bigint").alias("stderr_length"), "has_errors").distinct()


def prompt_build(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "prompt_request").select("request_id", "task_type", "intent", "expected", "actual", "conversation", "conversation_summary", "extra_context", "files")
    p = prompts.build(r)
    return p.select("request_id", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("digest")).distinct()


def log_evidence_trim(spark: SparkSession, base: str) -> DataFrame:
    """Output of over 20 lines cut to its beginning and end, both streams."""
    out = None
    for c in ("stdout", "stderr"):
        r = table(spark, base, "terminal_run").filter(f"{c} is not null").select(F.concat_ws(":", F.lit(c), "run_id").alias("src"), F.col(c).alias("t"))
        part = projects.log_evidence(r, "src", "t", 20, 5, 10)
        out = part if out is None else out.unionByName(part)
    return out.select("src", F.md5("content").alias("digest"), F.col("original_line_count").cast("bigint").alias("original"), F.col("retained_line_count").cast("bigint").alias("retained"), "was_trimmed").distinct()


def route_handlers(spark: SparkSession, base: str) -> DataFrame:
    """Each route's last handler and how often its name is called."""
    r = table(spark, base, "file_symbols").select("file_id", "file_path", F.explode("routes").alias("r")).filter("r is not null").select("r.method", "r.path", F.col("r.function_name").alias("handler"), "file_path", F.col("file_id").alias("ord")).distinct()
    c = table(spark, base, "file_symbols").select("file_id", F.explode("calls").alias("c")).filter("c.target is not null").select("file_id", F.col("c.target").alias("handler"), "c.line").distinct().groupBy("handler").agg(F.count("*").alias("n_calls"))
    return routes.handlers(r).join(c, "handler", "left").select("route", "handler", "file_path", F.coalesce("n_calls", F.lit(0).cast("bigint")).alias("n_calls"))


def evidence_questions(spark: SparkSession, base: str) -> DataFrame:
    """What each request is asked for; all have repository code."""
    c = table(spark, base, "prompt_request").select("request_id", "intent").distinct()
    i = analysis.intent(F.col("intent"))
    r = c.select("request_id", i["investigation_type"].alias("investigation_type"), i["domain"].alias("domain"))
    q = projects.questions(analysis.evidence_plan(r, r.select("request_id", F.lit("repository_code").alias("evidence_type"))))
    return q.select("request_id", F.size("questions").cast("bigint").alias("n_questions"), "combined")


def dependency_depths(spark: SparkSession, base: str) -> DataFrame:
    """How many levels of parents each class has."""
    e = table(spark, base, "file_symbols").select(F.explode("inherits").alias("i")).filter("i.class_name is not null and i.parent is not null").select(F.col("i.class_name").alias("source"), F.col("i.parent").alias("target")).distinct()
    d = graph.dependency_depth(e, e.select(F.col("source").alias("start")))
    return d.select("start", F.col("depth").cast("bigint").alias("depth"))


_CALLS = "SELECT DISTINCT c.caller AS source, c.target AS target FROM (SELECT unnest(calls) AS c FROM file_symbols) WHERE c.caller IS NOT NULL AND c.target IS NOT NULL"
_STARTS = "SELECT DISTINCT r.function_name AS start FROM (SELECT unnest(routes) AS r FROM file_symbols) WHERE r.function_name IS NOT NULL"
_LINES = r"""l AS (SELECT src, unnest(a) AS line, unnest(range(len(a))) AS pos FROM (SELECT src, regexp_split_to_array(regexp_replace(t, '\r?\n$', ''), '\r?\n') AS a
       FROM (SELECT 'stdout:' || run_id AS src, stdout AS t FROM terminal_run WHERE stdout IS NOT NULL UNION SELECT 'stderr:' || run_id, stderr FROM terminal_run WHERE stderr IS NOT NULL)))"""
_ERR = r"regexp_matches(line, '(?i)\b(?:error|exception|traceback|fatal|failed|failure|panic|crash|404|500)\b')"
_BLANK = r"(regexp_replace(line, '\s+', '', 'g') = '')"
_FACTS = r"""f0 AS (SELECT DISTINCT evidence_id, content, collected_at, regexp_replace(content, '^\s+|\s+$', '', 'g') AS s, trim(regexp_replace(content, '\s+', ' ', 'g')) AS c FROM evidence),
    f AS (SELECT 'fact-' || substr(sha256(statement), 1, 12) AS id, statement, first(evidence_id ORDER BY collected_at, evidence_id) AS evidence_id, 1.0::DOUBLE AS confidence
      FROM (SELECT *, CASE WHEN length(c) > 350 THEN rtrim(substr(c, 1, 350)) || '...' ELSE c END AS statement FROM f0
            WHERE length(s) BETWEEN 1 AND 600 AND NOT starts_with(s, '[USER]:') AND NOT contains(s, chr(10) || '---' || chr(10))) GROUP BY statement)"""
_RULES = "SELECT 0 AS rule, '404' AS k, 'Requested route is not registered' AS h UNION ALL SELECT 1, '404', 'Request path is incorrect' UNION ALL SELECT 2, 'connection refused', 'Target service is not running' UNION ALL SELECT 3, 'connection refused', 'Network configuration issue exists' UNION ALL SELECT 4, 'timeout', 'Dependency is responding too slowly'"
_HYPS = f"""h AS (SELECT 'hyp-' || substr(sha256(h), 1, 12) AS id, h AS statement, min(rule) AS rule, count(DISTINCT f.id) AS n_support FROM f JOIN ({_RULES}) r ON contains(lower(f.statement), r.k) GROUP BY h)"""


_LOW = "lower(coalesce(intent, ''))"
_KIND = f"CASE WHEN regexp_matches({_LOW}, 'fix|bug|error|broken|not working|issue|sync|failing') THEN 'debugging' WHEN regexp_matches({_LOW}, 'why|cause|reason') THEN 'root_cause' WHEN regexp_matches({_LOW}, 'slow|latency|performance|memory|cpu') THEN 'performance' WHEN regexp_matches({_LOW}, 'security|auth bypass|token|jwt|vulnerability') THEN 'security' WHEN regexp_matches({_LOW}, 'test') THEN 'test_failure' WHEN regexp_matches({_LOW}, 'architecture|design|review|structure') THEN 'architecture_review' WHEN regexp_matches({_LOW}, 'feature|implement|analyze|behaviour|behavior') THEN 'feature_analysis' ELSE 'unknown' END"
_DOMAIN = f"CASE WHEN regexp_matches({_LOW}, 'backend|server|repository|service|railway') THEN 'backend' WHEN regexp_matches({_LOW}, 'frontend|ui|react|page|component') THEN 'frontend' WHEN regexp_matches({_LOW}, 'flutter|android|ios|mobile') THEN 'mobile' WHEN regexp_matches({_LOW}, 'api|endpoint|route|request|response') THEN 'api' WHEN regexp_matches({_LOW}, 'database|postgres|sqlite|schema|query') THEN 'database' WHEN regexp_matches({_LOW}, 'auth|login|jwt|token') THEN 'auth' WHEN regexp_matches({_LOW}, 'docker|deployment|infra|kubernetes|container') THEN 'infrastructure' ELSE 'unknown' END"
_CONF = "CASE investigation_type WHEN 'debugging' THEN CASE WHEN domain = 'unknown' THEN 0.68 ELSE 0.95 END WHEN 'architecture_review' THEN CASE WHEN domain = 'unknown' THEN 0.62 ELSE 0.9 END WHEN 'feature_analysis' THEN CASE WHEN domain = 'unknown' THEN 0.6 ELSE 0.88 END WHEN 'unknown' THEN CASE WHEN domain = 'unknown' THEN 0.4 ELSE 0.68 END ELSE CASE WHEN domain = 'unknown' THEN 0.65 ELSE 0.93 END END::DOUBLE"
_TASK = ", ".join("(" + " + ".join("len(regexp_extract_all(t, '" + p.replace("'", "''") + "'))" for p in ps) + f") AS {k}" for k, ps in tx.TASKS.items())
_RANKED = ("debug", "rejects", "route", "session", "that", "the", "token", "tokens", "upload")
_WEIGHT = "CASE lower(type) WHEN 'file' THEN 10.0 WHEN 'class' THEN 20.0 WHEN 'function' THEN 20.0 WHEN 'method' THEN 20.0 WHEN 'symbol' THEN 20.0 WHEN 'route' THEN 50.0 ELSE 5.0 END"
_GRAPH = r"""f AS (SELECT file_id, file_path, 'file:' || coalesce(file_path, '') AS file, classes, functions, methods, routes, imports, calls, inherits FROM file_symbols),
    d AS (SELECT file, 'class' AS k, c.name AS name FROM (SELECT file, unnest(classes) AS c FROM f) UNION SELECT file, 'function', c.name FROM (SELECT file, unnest(functions) AS c FROM f)
      UNION SELECT file, 'method', concat_ws('.', c.class_name, c.name) FROM (SELECT file, unnest(methods) AS c FROM f) WHERE c IS NOT NULL UNION SELECT file, 'route', concat_ws(':', c.method, c.path) FROM (SELECT file, unnest(routes) AS c FROM f) WHERE c IS NOT NULL
      UNION SELECT file, 'module', c.module FROM (SELECT file, unnest(imports) AS c FROM f)),
    g AS (SELECT coalesce('function:' || c.name, file) AS source, unnest(c.decorators) AS name FROM (SELECT file, unnest(functions) AS c FROM f) UNION SELECT 'method:' || concat_ws('.', c.class_name, c.name), unnest(c.decorators) FROM (SELECT file, unnest(methods) AS c FROM f) WHERE c IS NOT NULL),
    h AS (SELECT DISTINCT c.class_name AS child, c.parent AS parent FROM (SELECT unnest(inherits) AS c FROM f)),
    n0 AS (SELECT 'file:' || file_path AS id, 'FILE' AS type, file_path AS name FROM f UNION SELECT k || ':' || name, upper(k), name FROM d UNION SELECT 'decorator:' || name, 'DECORATOR', name FROM g UNION SELECT 'class:' || parent, 'CLASS', parent FROM h UNION SELECT 'class:' || child, 'CLASS', child FROM h WHERE parent <> ''),
    k AS (SELECT name, arg_min(id, CASE type WHEN 'FUNCTION' THEN 1 WHEN 'METHOD' THEN 2 ELSE 3 END) AS id FROM n0 WHERE type IN ('FUNCTION', 'METHOD', 'CLASS') GROUP BY name),
    c AS (SELECT DISTINCT CASE WHEN c.caller <> '' AND c.caller <> '<module>' THEN 'function:' || c.caller ELSE file END AS source, c.target AS t FROM (SELECT file, unnest(calls) AS c FROM f) WHERE c.target <> ''),
    r AS (SELECT c.source, c.t, coalesce(k.id, 'symbol:' || c.t) AS target FROM c LEFT JOIN k ON k.name = c.t),
    n AS (SELECT * FROM n0 WHERE name <> '' UNION SELECT target, 'EXTERNAL_SYMBOL', t FROM r WHERE starts_with(target, 'symbol:')),
    e AS (SELECT file AS source, k || ':' || name AS target, CASE k WHEN 'route' THEN 'EXPOSES_ROUTE' WHEN 'module' THEN 'IMPORTS' ELSE 'DEFINES' END AS relationship FROM d WHERE name <> '' UNION SELECT source, 'decorator:' || name, 'DECORATED_BY' FROM g WHERE name <> ''
      UNION SELECT 'class:' || child, 'class:' || parent, 'INHERITS' FROM h WHERE child IS NOT NULL AND parent <> '' UNION SELECT source, target, 'CALLS' FROM r)"""
_SYMBOLS = """s AS (SELECT DISTINCT file_path AS file, 'class' AS type, x.name AS name, coalesce(x.line, 0) AS line FROM (SELECT file_path, unnest(classes) AS x FROM file_symbols) WHERE x.name IS NOT NULL UNION SELECT file_path, 'function', x.name, coalesce(x.line, 0) FROM (SELECT file_path, unnest(functions) AS x FROM file_symbols) WHERE x.name IS NOT NULL UNION SELECT file_path, 'method', x.name, coalesce(x.line, 0) FROM (SELECT file_path, unnest(methods) AS x FROM file_symbols) WHERE x.name IS NOT NULL)"""
_IMPORTS = r"""i AS (SELECT DISTINCT file_id, file_path AS source, x.module AS module, x.imported AS imported, x.line AS line FROM (SELECT file_id, file_path, unnest(imports) AS x FROM file_symbols) WHERE x.module IS NOT NULL),
    mf AS (SELECT name, min(file) AS file FROM (SELECT replace(regexp_replace(file_path, '/[^/]*$|^src/', '', 'g'), '/', '.') AS name, file_path AS file FROM file_symbols) GROUP BY name),
    tp AS (SELECT module, k, array_to_string(string_split(module, '.')[1:k], '.') AS prefix FROM (SELECT module, unnest(range(1, len(string_split(module, '.')) + 1)) AS k FROM (SELECT DISTINCT module FROM i) WHERE module <> '')),
    bm AS (SELECT module, arg_max(mf.file, k) AS file FROM tp JOIN mf ON mf.name = tp.prefix GROUP BY module),
    im AS (SELECT i.source, i.module, i.imported, i.line, bm.file AS target FROM i LEFT JOIN bm USING (module))"""

SQL = {
    "graph_nodes_v2": f"WITH {_GRAPH} SELECT id, type, name FROM n",
    "graph_edges_v2": f"WITH {_GRAPH} SELECT source, target, relationship FROM e",
    "find_node_first_wins": """WITH n AS (SELECT DISTINCT concat_ws('/', project_name, name) AS name, id, upper(type) AS type, node_key AS ord FROM graph_node WHERE id IS NOT NULL)
        SELECT name, id, type, ord FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY type = 'EXTERNAL_SYMBOL', ord, id) AS r FROM n) WHERE r = 1""",
    "search_nodes_substring": "SELECT DISTINCT node_key, name FROM graph_node WHERE contains(lower(name), 'token')",
    "node_type_counts": "SELECT type, count(*) AS n FROM (SELECT DISTINCT node_key, upper(type) AS type FROM graph_node) GROUP BY type",
    "callers_callees": f"WITH c AS ({_CALLS}) SELECT name, CAST(sum(i) AS BIGINT) AS n_callers, CAST(sum(o) AS BIGINT) AS n_callees FROM (SELECT target AS name, 1 AS i, 0 AS o FROM c UNION ALL SELECT source, 0, 1 FROM c) GROUP BY name",
    "definition_reference_join": f"""WITH {_SYMBOLS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY lower(file) DESC, file DESC, line DESC, type DESC) AS r FROM s) WHERE r = 1),
        f AS (SELECT name, count(*) AS n_refs, count(DISTINCT file) AS n_files FROM (SELECT DISTINCT file_id, file_path AS file, c.target AS name, c.line AS line FROM (SELECT file_id, file_path, unnest(calls) AS c FROM file_symbols) WHERE c.target IS NOT NULL) GROUP BY name)
        SELECT l.name, l.type, l.file, l.line, coalesce(n_refs, 0) AS n_refs, coalesce(n_files, 0) AS n_files FROM l LEFT JOIN f USING (name)""",
    "longest_prefix_resolution": f"WITH {_IMPORTS} SELECT DISTINCT module, target AS file FROM im",
    "bounded_bfs": f"""WITH RECURSIVE c AS ({_CALLS}), s AS ({_STARTS}), w AS (SELECT start, start AS id, 0 AS depth FROM s UNION SELECT w.start, c.target, w.depth + 1 FROM w JOIN c ON c.source = w.id WHERE w.depth < 3),
        m AS (SELECT start, id, min(depth) AS depth FROM w GROUP BY start, id) SELECT start, count(*) AS n_reached, CAST(max(depth) AS BIGINT) AS depth FROM m WHERE depth > 0 GROUP BY start""",
    "upstream_closure": """WITH RECURSIVE e AS (SELECT DISTINCT i.class_name AS s, i.parent AS t FROM (SELECT unnest(inherits) AS i FROM file_symbols) WHERE i.class_name IS NOT NULL AND i.parent IS NOT NULL),
        w AS (SELECT DISTINCT t AS start, t AS id, 0 AS depth FROM e UNION SELECT w.start, e.s, w.depth + 1 FROM w JOIN e ON e.t = w.id WHERE w.depth < 60)
        SELECT start, id, CAST(min(depth) AS BIGINT) AS depth FROM w WHERE id <> start GROUP BY start, id""",
    "impact_counts": f"""WITH RECURSIVE c AS ({_CALLS}), s AS ({_STARTS}), w AS (SELECT start, start AS id, 0 AS depth FROM s UNION SELECT w.start, c.source, w.depth + 1 FROM w JOIN c ON c.target = w.id WHERE w.depth < 4),
        m AS (SELECT start, id, min(depth) AS depth FROM w GROUP BY start, id) SELECT start, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM m WHERE depth > 0 GROUP BY start, depth""",
    "adjacency_lists": f"WITH c AS ({_CALLS}) SELECT source, count(*) AS n, string_agg(target, ',' ORDER BY target) AS targets FROM c GROUP BY source",
    "file_dependencies": f"WITH {_IMPORTS} SELECT source, target, count(*) AS n_imports FROM im WHERE target IS NOT NULL GROUP BY ALL",
    "symbol_dependencies": f"WITH {_IMPORTS} SELECT source, module, count(*) AS n_rows, count(imported) AS n_names, bool_or(target IS NOT NULL) AS resolved FROM im GROUP BY source, module",
    "route_catalogue": "SELECT DISTINCT coalesce(r.path, '') AS path, upper(r.method) AS method, r.function_name AS handler FROM (SELECT unnest(routes) AS r FROM file_symbols) WHERE r IS NOT NULL",
    "node_relevance": "WITH n AS (SELECT DISTINCT node_key, type, name, metadata, regexp_replace(lower(name), '[_-]', ' ', 'g') AS m FROM graph_node), s AS (SELECT node_key, "
    + f"CASE WHEN m = '{ISSUE.lower()}' THEN 40.0 WHEN contains(m, '{ISSUE.lower()}') THEN 20.0 ELSE 0.0 END + "
    + " + ".join(f"CASE WHEN contains(m, '{t}') THEN {_WEIGHT} ELSE 0.0 END" for t in _RANKED)
    + " + "
    + " + ".join(f"CASE WHEN contains(lower(metadata), '{t}') THEN 3.0 ELSE 0.0 END" for t in _RANKED)
    + " AS score FROM n) SELECT node_key, CAST(max(score) AS DOUBLE) AS score FROM s WHERE score > 0 GROUP BY node_key ORDER BY score DESC, node_key LIMIT 50",
    "evidence_text_score": "WITH e AS (SELECT DISTINCT evidence_id, lower(content) AS c FROM evidence), s AS (SELECT evidence_id, 5.0::DOUBLE * ("
    + " + ".join(f"(length(c) - length(replace(c, '{t}', ''))) / {len(t)}" for t in ("route", "session", "timeout"))
    + ") AS score FROM e) SELECT DISTINCT evidence_id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0",
    "file_rank_topk": f"WITH {_SYMBOLS}, {_IMPORTS}, f AS (SELECT DISTINCT file_path, lower(regexp_extract(file_path, '([^/]+)$', 1)) AS b FROM file_symbols), o AS (SELECT DISTINCT file AS file_path, type, name, replace(lower(name), '_', ' ') AS b FROM s), r AS (SELECT DISTINCT file_path, x.path AS path FROM (SELECT file_path, unnest(routes) AS x FROM file_symbols) WHERE x.path IS NOT NULL), g AS ("
    + " UNION ALL ".join(f"SELECT file_path, 10.0 AS score, 'filename matches ' || chr(39) || '{t}' || chr(39) AS reason FROM f WHERE contains(b, '{t}') UNION ALL SELECT file_path, 20.0, 'symbol matches ' || chr(39) || '{t}' || chr(39) FROM o WHERE contains(b, '{t}')" for t in _RANKED)
    + " UNION ALL SELECT file_path, 50.0, 'route match ' || chr(39) || path || chr(39) FROM r WHERE path = '/tokens/session'), h AS (SELECT * FROM g UNION ALL SELECT target, 5.0, 'imported by ' || source FROM im WHERE target IS NOT NULL AND source IN (SELECT file_path FROM g)) SELECT file_path, CAST(sum(score) AS DOUBLE) AS score, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM h GROUP BY file_path ORDER BY score DESC, file_path LIMIT 20",
    "ranked_files_topk": "SELECT project_name, rank, rank_id, file_path, score FROM (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY score DESC, rank_id) AS rank FROM (SELECT DISTINCT rank_id, project_name, file_path, score FROM ranked_file WHERE score IS NOT NULL AND project_name IS NOT NULL)) WHERE rank <= 5",
    "token_frequency": "SELECT token, count(*) AS n_docs FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '([a-zA-Z_][a-zA-Z0-9_]*)', 1), lambda t: lower(t)))) AS token FROM documents) GROUP BY token",
    "path_params": "SELECT path, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(path, '<([^>]+)>', 1), regexp_extract_all(path, ':([a-zA-Z_][a-zA-Z0-9_]*)', 1)))), ',') AS params FROM (SELECT DISTINCT r.path AS path FROM (SELECT unnest(routes) AS r FROM file_symbols) WHERE r.path IS NOT NULL)",
    "camel_to_snake": r"SELECT name, lower(regexp_replace(regexp_replace(name, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake FROM (SELECT DISTINCT c.name AS name FROM (SELECT unnest(classes) AS c FROM file_symbols) WHERE c.name IS NOT NULL)",
    "route_mentions": r"WITH d AS (SELECT doc_id, regexp_extract_all(text, '(?i)\b(GET|POST|PUT|PATCH|DELETE)\s+(/[/a-zA-Z0-9_\-]*)', 1) AS m, regexp_extract_all(text, '(?i)\b(GET|POST|PUT|PATCH|DELETE)\s+(/[/a-zA-Z0-9_\-]*)', 2) AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, coalesce(array_to_string(list_transform(range(1, len(m) + 1), lambda i: upper(m[i]) || ':' || p[i]), ','), '') AS routes FROM d",
    "classify_task": f"WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, {_TASK} FROM d), g AS (SELECT *, greatest(debug, research, code, explain, design) AS b FROM s) SELECT doc_id, CASE WHEN b = 0 THEN 'general' WHEN debug = b THEN 'debug' WHEN research = b THEN 'research' WHEN code = b THEN 'code' WHEN explain = b THEN 'explain' ELSE 'design' END AS task FROM g",
    "intent_rules": rf"WITH c AS (SELECT DISTINCT request_id, intent FROM prompt_request), s AS (SELECT request_id, intent, {_KIND} AS investigation_type, {_DOMAIN} AS domain FROM c) SELECT request_id, investigation_type, domain, {_CONF} AS confidence, CASE WHEN regexp_matches(lower(intent), '\b(?:error|bug|fail|exception|500|404)\b') THEN 'bug_investigation' WHEN regexp_matches(lower(intent), '\b(?:where|find|handled|implemented)\b') THEN 'symbol_lookup' ELSE 'general_search' END AS question FROM s",
    "extract_keywords": r"""WITH c AS (SELECT DISTINCT request_id, 'intent' AS field, coalesce(intent, '') AS t FROM prompt_request UNION SELECT request_id, 'conversation', coalesce(conversation, '') FROM prompt_request),
        m AS (SELECT request_id, field, regexp_extract_all(t, '\b([a-zA-Z0-9_/]+)(\.[a-zA-Z0-9_]{2,6})\b', 1) AS a, regexp_extract_all(t, '\b([a-zA-Z0-9_/]+)(\.[a-zA-Z0-9_]{2,6})\b', 2) AS b, regexp_extract_all(regexp_replace(t, '[À-ÖØ-öø-ɏ]', '0', 'g'), '\b([A-Z][a-zA-Z]{2,})\b', 1) AS k, regexp_extract_all(regexp_replace(t, '[À-ÖØ-öø-ɏ]', '0', 'g'), '\b([a-z]+(?:_[a-z]+){1,})\b', 1) AS n, list_filter(regexp_extract_all(t, '`([^`\n]+)`', 1), lambda x: x IS NOT NULL) AS q FROM c),
        w AS (SELECT request_id, field, list_concat(list_concat(list_concat(list_transform(range(1, len(a) + 1), lambda i: lower(a[i] || b[i])), list_transform(a, lambda x: lower(x))), list_concat(list_transform(k, lambda x: lower(x)), list_transform(k, lambda x: lower(regexp_replace(regexp_replace(x, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'))))),
                list_concat(n, list_concat(list_transform(q, lambda x: trim(lower(x))), list_transform(q, lambda x: trim(lower(CASE WHEN regexp_matches(split_part(x, '/', -1), '[^.].*\.') THEN x[1:length(x) - length(split_part(x, '.', -1)) - 1] ELSE x END)))))) AS w FROM m)
        SELECT request_id, field, coalesce(array_to_string(list_sort(list_distinct(list_filter(w, lambda x: length(x) > 2))), ','), '') AS keywords FROM w""",
    "route_query_rules": r"WITH c AS (SELECT DISTINCT request_id, intent, trim(coalesce(intent, '')) AS t, lower(trim(coalesce(intent, ''))) AS l FROM prompt_request) SELECT request_id, CASE WHEN t = '' THEN 'none' WHEN regexp_matches(t, '(?i)\b(GET|POST|PUT|PATCH|DELETE)\s+(/[/a-zA-Z0-9_\-]*)') AND ("
    + "regexp_matches(l, 'trace|flow|path|route')) THEN 'route_trace' WHEN regexp_matches(l, 'what breaks if|impact|affected by|depends on|blast radius') THEN 'impact_analysis' WHEN regexp_matches(l, 'who calls|what calls|callers of|called by|what does|callees of|calls from') THEN 'where_is_symbol' WHEN regexp_matches(l, 'execution flow|execution path|call chain|flow') THEN 'call_chain' WHEN regexp_matches(l, 'where|find|implemented|handled|defined') THEN 'where_is_symbol'"
    + " ELSE 'unknown' END AS capability FROM c",
    "rule_summary": r"""WITH c AS (SELECT DISTINCT request_id, conversation AS t FROM prompt_request WHERE conversation IS NOT NULL),
        m AS (SELECT request_id, t, regexp_extract_all(t, '\b(GET|POST|PATCH|PUT|DELETE)\s+(/[a-zA-Z0-9_/.<>?=&\-]+)', 1) AS a, regexp_extract_all(t, '\b(GET|POST|PATCH|PUT|DELETE)\s+(/[a-zA-Z0-9_/.<>?=&\-]+)', 2) AS b, regexp_extract_all(t, '([a-zA-Z0-9_/]+\.[a-zA-Z0-9_]{2,5})', 1) AS f, list_filter(list_transform(regexp_split_to_array(t, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM c),
        p AS (SELECT request_id, t, list_transform(range(greatest(1, len(a) - 2), len(a) + 1), lambda i: a[i] || ' ' || b[i]) AS r, list_filter(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN list_position(f, f[i]) = i AND NOT starts_with(f[i], 'http') THEN f[i] END), lambda x: x IS NOT NULL)[1:5] AS f, array_to_string(l[greatest(1, len(l) - 9):len(l)], ' ') AS l FROM m),
        s AS (SELECT request_id, t, concat_ws(' ', CASE WHEN len(r) > 0 THEN 'Routes discussed: ' || array_to_string(r, ', ') || '.' END, CASE WHEN len(f) > 0 THEN 'Files involved: ' || array_to_string(f, ', ') || '.' END, CASE WHEN l <> '' THEN 'Last context: ' || substr(l, 1, 400) END) AS s FROM p)
        SELECT request_id, CASE WHEN s = '' THEN substr(t, 1, 600) ELSE s END AS summary FROM s""",
    "repo_fingerprint": """WITH f AS (SELECT file_id, any_value(project_name) AS project_name, any_value(file_path) AS path, any_value(n_bytes) AS n FROM file_symbols GROUP BY file_id),
        h AS (SELECT project_name, n, CAST('0x' || substr(sha256(concat_ws(chr(0), path, CAST(n AS VARCHAR))), 1, 12) AS HUGEINT) AS v FROM f)
        SELECT project_name, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(CAST(sum(v) AS HUGEINT) AS VARCHAR) AS fingerprint FROM h GROUP BY project_name""",
    "chunk_evidence": r"""WITH e AS (SELECT evidence_id, regexp_split_to_array(regexp_replace(content, '\r?\n$', ''), '\r?\n') AS a FROM (SELECT DISTINCT evidence_id, content FROM evidence WHERE length(content) > 0)),
        c AS (SELECT evidence_id, a, CAST(ceil(len(a) / 20.0) AS BIGINT) AS n, unnest(range(CAST(ceil(len(a) / 20.0) AS BIGINT))) AS i FROM e)
        SELECT evidence_id, i AS chunk_index, n AS total_chunks, i * 20 + 1 AS start_line, least(i * 20 + 20, len(a)) AS end_line, md5(array_to_string(a[i * 20 + 1 : i * 20 + 20], chr(10))) AS digest FROM c""",
    "chunk_gaps": "SELECT parent_evidence_id, count(DISTINCT chunk_index) AS n_there, CAST(max(total_chunks) AS BIGINT) AS n_wanted FROM evidence_chunk WHERE parent_evidence_id IS NOT NULL GROUP BY parent_evidence_id HAVING count(DISTINCT chunk_index) < max(total_chunks)",
    "log_error_filter": f"WITH {_LINES} SELECT src, count(*) AS n_errors, min(pos) AS first_pos FROM l WHERE {_ERR} GROUP BY src",
    "log_dedupe_consecutive": f"WITH {_LINES}, p AS (SELECT src, line, lag(line) OVER (PARTITION BY src ORDER BY pos) AS b FROM l) SELECT src, count(*) AS n_lines FROM p WHERE b IS NULL OR b <> line GROUP BY src",
    "log_error_context": f"WITH {_LINES}, e AS (SELECT *, max(CASE WHEN {_ERR} THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 5 FOLLOWING) AS e FROM l) SELECT src, pos, line FROM e WHERE e = 1",
    "log_trace_sessions": rf"""WITH {_LINES}, g AS (SELECT *, coalesce(sum(CASE WHEN {_BLANK} THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM l),
        m AS (SELECT *, min(CASE WHEN regexp_matches(line, '(?i)(?:traceback|exception|stack trace)') AND NOT {_BLANK} THEN pos END) OVER (PARTITION BY src, seg) AS start FROM g)
        SELECT src, min(pos) AS first_pos, max(pos) AS last_pos, string_agg(line, chr(10) ORDER BY pos) AS trace FROM m WHERE pos >= start GROUP BY src, seg""",
    "log_head_tail": f"WITH {_LINES}, s AS (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM l) SELECT src, count(*) AS n_kept, max(n) AS n_lines, bool_or(n > 20) AS was_trimmed FROM s WHERE n <= 20 OR pos < 5 OR pos >= n - 10 GROUP BY src",
    "log_investigation_view": f"""WITH {_LINES}, c AS (SELECT *, lag(line) OVER (PARTITION BY src ORDER BY pos) AS b FROM l WHERE NOT {_BLANK}), d AS (SELECT src, pos, line, row_number() OVER (PARTITION BY src ORDER BY pos) AS n FROM c WHERE b IS NULL OR b <> line),
        e AS (SELECT *, CASE WHEN {_ERR} THEN 1 ELSE 0 END AS x FROM d), f AS (SELECT *, max(x) OVER (PARTITION BY src ORDER BY n ROWS BETWEEN 10 PRECEDING AND 5 FOLLOWING) AS near, max(x) OVER (PARTITION BY src) AS anyx FROM e)
        SELECT src, count(*) AS n_lines, min(pos) AS first_pos, max(pos) AS last_pos FROM f WHERE anyx = 0 OR near = 1 GROUP BY src""",
    "fact_extract": f"WITH {_FACTS} SELECT id, statement, evidence_id, confidence FROM f",
    "hypothesis_generate": f"WITH {_FACTS}, {_HYPS} SELECT id, statement, n_support, CAST(CASE WHEN n_support >= 2 THEN least(1.0, 0.5 + 0.1 * n_support) ELSE 0.5 END AS DOUBLE) AS score, CASE WHEN n_support >= 2 THEN 'supported' ELSE 'active' END AS status FROM h",
    "root_cause_rank": f"WITH {_FACTS}, {_HYPS} SELECT row_number() OVER (ORDER BY confidence DESC, rule) AS rank, statement, confidence FROM (SELECT *, CAST(greatest(0.0, least(1.0, round(0.5 + 0.1 * n_support, 2))) AS DOUBLE) AS confidence FROM h)",
    "missing_evidence": f"WITH c AS (SELECT DISTINCT request_id, intent FROM prompt_request), s AS (SELECT request_id, {_KIND} AS t, {_DOMAIN} AS d FROM c), n AS (SELECT request_id, unnest(CASE WHEN t = 'debugging' AND d = 'backend' THEN ['server_logs', 'api_routes', 'stack_trace'] WHEN t = 'debugging' AND d = 'mobile' THEN ['stack_trace', 'terminal_output', 'project_structure'] WHEN t = 'debugging' AND d = 'api' THEN ['api_routes', 'server_logs', 'project_structure'] WHEN t = 'test_failure' AND d = 'unknown' THEN ['test_results', 'stack_trace'] WHEN t = 'security' AND d = 'auth' THEN ['config_file', 'api_routes'] ELSE ['project_structure'] END) AS evidence_type FROM s) SELECT request_id, evidence_type, CAST(list_position(['stack_trace', 'server_logs', 'terminal_output', 'test_results', 'api_routes', 'repository_code', 'database_schema', 'network_trace', 'config_file', 'project_structure'], evidence_type) AS BIGINT) AS priority FROM n",
    "timeline_recent": "SELECT user_id AS session, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3",
    "session_stats": "SELECT session, CAST(sum(f) AS BIGINT) AS facts, CAST(sum(h) AS BIGINT) AS hypotheses, CAST(sum(e) AS BIGINT) AS evidence, CAST(sum(v) AS BIGINT) AS events FROM (SELECT DISTINCT project_name AS session, CAST(rank_id AS VARCHAR) AS k, 1 AS f, 0 AS h, 0 AS e, 0 AS v FROM ranked_file UNION ALL SELECT DISTINCT project_name, CAST(request_id AS VARCHAR), 0, 1, 0, 0 FROM prompt_request UNION ALL SELECT DISTINCT project_name, evidence_id, 0, 0, 1, 0 FROM evidence UNION ALL SELECT DISTINCT project_name, CAST(run_id AS VARCHAR), 0, 0, 0, 1 FROM terminal_run) GROUP BY session",
    "event_windows": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "extension_histogram": "SELECT extension, count(*) AS n, CASE extension WHEN '.py' THEN 'Python' WHEN '.dart' THEN 'Dart' WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript' WHEN '.js' THEN 'JavaScript' WHEN '.jsx' THEN 'JavaScript' WHEN '.sql' THEN 'SQL'" + r" END AS language FROM (SELECT file_id, lower(regexp_extract(any_value(file_path), '[^/.][^/]*(\.[^./]+)$', 1)) AS extension FROM file_symbols GROUP BY file_id) GROUP BY extension",
    "terminal_blocks": r"""WITH r AS (SELECT DISTINCT run_id, command, exit_code, stdout, stderr, regexp_replace(coalesce(stdout, ''), '^\s+|\s+$', '', 'g') AS o, regexp_replace(coalesce(stderr, ''), '^\s+|\s+$', '', 'g') AS e FROM terminal_run)
        SELECT run_id, md5('COMMAND: ' || coalesce(command, '') || chr(10) || 'EXIT CODE: ' || coalesce(CAST(exit_code AS VARCHAR), 'None') || chr(10) || chr(10) || '================ STDOUT ================' || chr(10) || o || chr(10) || chr(10) || '================ STDERR ================' || chr(10) || e) AS digest,
               coalesce(length(stdout), 0) AS stdout_length, coalesce(length(stderr), 0) AS stderr_length, e <> '' AS has_errors FROM r""",
    "log_evidence_trim": r"""WITH r AS (SELECT src, regexp_split_to_array(regexp_replace(t, '\r?\n$', ''), '\r?\n') AS a FROM (SELECT 'stdout:' || run_id AS src, stdout AS t FROM terminal_run WHERE stdout IS NOT NULL UNION SELECT 'stderr:' || run_id, stderr FROM terminal_run WHERE stderr IS NOT NULL)),
        k AS (SELECT src, len(a) AS n, CASE WHEN len(a) > 20 THEN list_concat(list_concat(a[1:5], ['', '================ TRIMMED LOG ================', CAST(len(a) - 15 AS VARCHAR) || ' lines omitted', 'Chronology preserved:', '- beginning retained', '- ending retained', '=============================================', '']), a[len(a) - 9:len(a)]) ELSE a END AS b FROM r)
        SELECT src, md5(array_to_string(b, chr(10))) AS digest, n AS original, len(b) AS retained, n > len(b) AS was_trimmed FROM k""",
    "route_handlers": """WITH r AS (SELECT DISTINCT upper(r.method) || ':' || r.path AS route, r.function_name AS handler, file_path, file_id FROM (SELECT file_id, file_path, unnest(routes) AS r FROM file_symbols) WHERE r IS NOT NULL AND r.function_name <> ''),
        h AS (SELECT route, handler, file_path FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY file_id DESC, handler DESC, file_path DESC) AS n FROM r) WHERE n = 1),
        c AS (SELECT handler, count(*) AS n_calls FROM (SELECT DISTINCT file_id, c.target AS handler, c.line AS line FROM (SELECT file_id, unnest(calls) AS c FROM file_symbols) WHERE c.target IS NOT NULL) GROUP BY handler)
        SELECT route, handler, file_path, coalesce(n_calls, 0) AS n_calls FROM h LEFT JOIN c USING (handler)""",
    "evidence_questions": f"""WITH c AS (SELECT DISTINCT request_id, intent FROM prompt_request), s AS (SELECT request_id, {_KIND} AS t, {_DOMAIN} AS d FROM c), n AS (SELECT request_id, CASE WHEN t = 'debugging' AND d = 'backend' THEN ['stack trace', 'server logs', 'API routes'] WHEN t = 'debugging' AND d = 'mobile' THEN ['stack trace', 'terminal output', 'project structure'] WHEN t = 'debugging' AND d = 'api' THEN ['server logs', 'API routes', 'project structure'] WHEN t = 'test_failure' AND d = 'unknown' THEN ['stack trace', 'test results'] WHEN t = 'security' AND d = 'auth' THEN ['API routes', 'configuration files'] ELSE ['project structure'] END AS e FROM s)
        SELECT request_id, len(e) AS n_questions, 'Please provide:' || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(e) + 1), lambda i: CAST(i AS VARCHAR) || '. ' || e[i]), chr(10)) AS combined FROM n""",
    "dependency_depths": """WITH RECURSIVE e AS (SELECT DISTINCT i.class_name AS s, i.parent AS t FROM (SELECT unnest(inherits) AS i FROM file_symbols) WHERE i.class_name IS NOT NULL AND i.parent IS NOT NULL),
        w AS (SELECT DISTINCT s AS start, s AS id, 0 AS depth FROM e UNION SELECT w.start, e.t, w.depth + 1 FROM w JOIN e ON e.s = w.id WHERE w.depth < 60),
        m AS (SELECT start, id, min(depth) AS depth FROM w GROUP BY start, id) SELECT start, CAST(max(depth) AS BIGINT) AS depth FROM m GROUP BY start""",
    "prompt_build": r"""WITH p AS (SELECT DISTINCT request_id, task_type, intent, expected, actual, conversation, conversation_summary, extra_context, files FROM prompt_request),
        f AS (SELECT *, nullif(array_to_string(list_transform(list_filter(coalesce(files, []), lambda x: x IS NOT NULL AND x.content IS NOT NULL), lambda x: '=== FILE: ' || coalesce(x.path, '') || ' ===' || chr(10) || x.content || chr(10)), chr(10)), '') AS ff FROM p),
        b AS (SELECT request_id, concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10),
            CASE WHEN task_type = 'debug' THEN 'I have a bug I need help debugging.' END,
            CASE WHEN length(conversation_summary) > 0 THEN 'Context from our previous conversation:' || chr(10) || conversation_summary WHEN length(conversation) > 0 THEN 'Here is the conversation so far:' || chr(10) || chr(10) || substr(conversation, 1, 4000) END,
            CASE WHEN length(intent) > 0 THEN CASE WHEN task_type = 'debug' THEN 'Bug description:' || chr(10) || intent ELSE intent END END,
            CASE WHEN length(extra_context) > 0 THEN 'Additional context:' || chr(10) || extra_context END,
            'Relevant files:' || chr(10) || chr(10) || ff,
            CASE WHEN length(expected) > 0 THEN 'Expected behavior:' || chr(10) || expected END,
            CASE WHEN length(actual) > 0 THEN 'Current behavior / what is going wrong:' || chr(10) || actual END,
            CASE WHEN task_type = 'debug' THEN 'Please identify the root cause and provide a specific fix.' END) AS prompt FROM f)
        SELECT request_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM b""",
}

QUERIES = {
    f.__name__: f
    for f in (
        graph_nodes_v2, graph_edges_v2, find_node_first_wins, search_nodes_substring, node_type_counts, callers_callees, definition_reference_join, longest_prefix_resolution, bounded_bfs, upstream_closure, impact_counts, adjacency_lists, file_dependencies, symbol_dependencies,
        route_catalogue, node_relevance, evidence_text_score, file_rank_topk, ranked_files_topk, token_frequency, extract_keywords, path_params, camel_to_snake, route_mentions, classify_task, rule_summary, route_query_rules, intent_rules, chunk_evidence,
        chunk_gaps, log_error_filter, log_dedupe_consecutive, log_error_context, log_trace_sessions, log_head_tail, log_investigation_view, fact_extract, hypothesis_generate, root_cause_rank, missing_evidence, timeline_recent, session_stats, event_windows,
        extension_histogram, repo_fingerprint, terminal_blocks, prompt_build, log_evidence_trim, route_handlers, evidence_questions, dependency_depths,
    )
}
