import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import analysis, graph, logs, prompts, ranking, symbols
from tessera.plans import ask, investigate
from tessera.sources import repository, stores
from tessera.streaming import events

NODES = [("route:POST:/login", "ROUTE", "POST:/login", 0), ("function:login", "FUNCTION", "login", 1), ("function:validate_user", "FUNCTION", "validate_user", 2), ("function:create_token", "FUNCTION", "create_token", 3), ("class:UserService", "CLASS", "UserService", 4), ("class:AdminService", "CLASS", "AdminService", 5), ("class:SuperAdminService", "CLASS", "SuperAdminService", 6), ("symbol:DATABASE_URL", "EXTERNAL_SYMBOL", "DATABASE_URL", 7), ("symbol:login", "EXTERNAL_SYMBOL", "login", -1)]
EDGES = [("function:login", "function:validate_user", "CALLS"), ("function:validate_user", "function:create_token", "CALLS"), ("route:POST:/login", "function:login", "CALLS"), ("function:login", "symbol:DATABASE_URL", "REFERENCES"), ("class:AdminService", "class:UserService", "INHERITS"), ("class:SuperAdminService", "class:AdminService", "INHERITS"), ("function:create_token", "function:gone", "CALLS")]


@pytest.fixture(scope="module")
def repo(spark):
    return ask.Repository(spark.createDataFrame(NODES, "id string, type string, name string, ord int"), spark.createDataFrame(EDGES, "source string, target string, relationship string"))


def test_search(repo):
    assert graph.find_node(repo.nodes, "login").first()["type"] == "FUNCTION"
    a = repo.ask("Where is validate_user handled?")
    assert a.capability == "where_is_symbol" and a.confidence == 0.95 and a.evidence == ["create_token", "login", "validate_user"]
    assert repo.ask("Trace POST /login").metadata["route"] == "POST:/login"
    assert {"login", "validate_user", "create_token", "DATABASE_URL"} <= set(repo.ask("Trace POST /login").evidence)
    i = repo.ask("What breaks if login changes?")
    assert i.capability == "impact_analysis" and i.metadata["risk_score"] > 0 and "POST:/login" in i.metadata["dependents"]
    assert repo.ask("Show login execution flow").evidence == ["create_token", "login", "validate_user"]
    assert repo.ask("Where is nothing_here?").confidence == 0.0
    assert repo.ask("  ").answer == "Empty query." and repo.ask("hello").capability == "unknown"


def test_impact_lists(repo):
    rows = {(r.section, r.name) for r in graph.impact(repo.nodes, repo.edges, "validate_user").collect()}
    assert {("callers", "login"), ("callees", "create_token")} <= rows


def test_inheritance_and_closure(spark, repo):
    start = spark.createDataFrame([("class:AdminService",)], "start string")
    assert {(r.id, r.side) for r in graph.inheritance(repo.edges, start).collect()} == {("class:UserService", "parent"), ("class:SuperAdminService", "child")}
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", None), ("a", "b")], "source string, target string").withColumn("relationship", F.lit("CALLS"))
    one = spark.createDataFrame([("a",)], "start string")
    assert {(r.id, r.depth) for r in graph.reach(loop, one, None).collect()} == {("b", 1), ("c", 2)}
    assert {r.id for r in graph.reach(loop, one, None, seeded=False).collect()} == {"a", "b", "c"}
    assert graph.reach(loop, one.limit(0), None).count() == 0
    assert graph.dependency_depth(loop, spark.createDataFrame([("a",), ("z",)], "start string")).orderBy("start").collect() == [("a", 2), ("z", 0)]


def test_paths(spark):
    e = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e")], "source string, target string")
    assert graph.shortest_path(e, "a", "e") == ["a", "b", "d", "e"]
    assert graph.shortest_path(e, "q", "q") == ["q"] and graph.shortest_path(e, "e", "a") == [] and graph.has_path(e, "a", "d")


def test_grammar(repo):
    p = ask.parse("Who calls AuthService.login?")
    assert (p["intent_type"], p["symbol"]) == ("who_calls", "AuthService.login")
    assert ask.parse("What does AuthController.login call?")["symbol"] == "AuthController.login"
    assert ask.parse("can A reach B?")["target"] == "B" and ask.parse("Trace A -> B")["start"] == "A" and ask.parse("x")["intent_type"] == "unknown"
    assert repo.execute(ask.parse("who calls function:validate_user")) == ["function:login"]
    assert repo.execute(ask.parse("trace function:login -> function:create_token")) == ["function:login", "function:validate_user", "function:create_token"]
    assert repo.execute(ask.parse("x")) is None


def test_routed_column_equals_the_driver(spark):
    qs = ["Where is login handled?", "Trace POST /login", "what is called by X", "impact of foo", "Show login execution flow", "", "hello", "find bar"]
    got = spark.createDataFrame([(q,) for q in qs], "q string").select("q", ask.routed(F.col("q")).alias("r")).collect()
    for r in got:
        assert (r.r.capability, r.r.argument.split()) == (ask.route(r.q)[0], ask.route(r.q)[1].split())


SOURCE = '''
import os.path
from pkg import A as B, C
class Base: pass
class Service(Base):
    def helper(self): return 1
    @app.get("/users")
    def login(self):
        self.helper()
        s = Other()
        s.run()
        Other().stop()
@app.route("/r", methods=["GET", "POST"])
def handler(): return Service().login()
async def later(): await go()
'''


def test_symbols(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def ("), ("c.py", None), ("d.py", "class Other:\n    def run(self): pass\n    def stop(self): pass")], "path string, content string")
    s = symbols.extract(files).cache()
    kinds = {(r.file_path, r.kind, r.name, r.owner, r.detail) for r in s.collect()}
    assert ("a.py", "class", "Service", None, None) in kinds and ("a.py", "method", "login", "Service", None) in kinds and ("a.py", "function", "later", None, None) in kinds
    assert ("a.py", "import", "pkg", None, "A") in kinds and ("a.py", "inherit", "Base", "Service", None) in kinds and ("b.py", "error", "SyntaxError", None, None) in kinds
    assert {("a.py", "route", "/r", "handler", "POST"), ("a.py", "route", "/users", "login", "GET")} <= kinds
    assert not symbols.extract(files.filter("path = 'a.py'"), asynchronous=False).filter("name = 'later' and kind = 'function'").count()
    with pytest.raises(Exception, match="SyntaxError|invalid syntax"):
        symbols.extract(files, strict=True).collect()
    calls = {(r.caller_symbol, r.callee_symbol, r.callee_file) for r in symbols.resolved_calls(s).collect()}
    assert calls == {("Service.login", "Service.helper", "a.py"), ("Service.login", "Other.run", "d.py"), ("Service.login", "Other.stop", "d.py")}
    doc = symbols.symbol_document(s).withColumn("file_id", F.monotonically_increasing_id())
    nodes, edges = graph.build_v2(doc)
    assert edges.filter("source = 'class:Service' and target = 'class:Base' and relationship = 'INHERITS'").count() == 1
    assert nodes.groupBy("id").count().filter("count > 1").count() == 0


def test_script_routes(spark):
    files = spark.createDataFrame([("a.js", "app.get('/a', f)\nx\nrouter.POST(\"/b\")"), ("b.dart", "router.get('/c', h); app.get('/no')"), ("c.py", "app.get('/n')")], "path string, content string")
    got = {(r.file_path, r.line, r.method, r.path, r.framework) for r in symbols.script_routes(files).collect()}
    assert got == {("a.js", 1, "GET", "/a", "express"), ("a.js", 3, "POST", "/b", "express"), ("b.dart", 1, "GET", "/c", "shelf")}


def test_text(spark):
    row = spark.createDataFrame([("/u/<int:id>/:name", "HTTPServerError", "see auth/login.py and `main.dart`, UserService, create_token GET /a PUT /b-c/1", None)], "p string, c string, t string, n string").select(
        tx.path_parameters(F.col("p")), tx.camel_to_snake(F.col("c")), tx.keywords(F.col("t")), tx.route_mentions(F.col("t")), tx.keywords(F.col("n")), tx.task_type(F.lit("fix the error, why is it broken")), tx.extension(F.lit("a/.env")), tx.extension(F.lit("a/b.PY"))
    ).first()
    assert row[0] == ["id", "int:id", "name"] and row[1] == "http_server_error" and {"auth/login.py", "user_service", "create_token", "main"} <= set(row[2])
    assert row[3] == ["GET:/a", "PUT:/b-c/1"] and row[4] == [] and row[5] == "debug" and row[6] == "" and row[7] == ".py"


def test_logs(spark):
    text = "\n".join(["a"] * 3 + ["b", "Traceback x", "  in f", "", "c"] + [f"l{i}" for i in range(12)] + ["boom 404"])
    df = logs.exploded(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, t string"), "k", "t")
    assert logs.without_repeats(df).filter("src = 1 and line = 'a'").count() == 1
    assert {r.pos for r in logs.error_context(df, 1, 2).collect()} == {3, 4, 5, 6, 19, 20}
    tr = logs.stack_traces(df).collect()
    assert [(r.first_pos, r.last_pos, r.trace) for r in tr] == [(4, 6, "Traceback x\n  in f\n")]
    assert logs.head_and_tail(df, 10, 2, 3).filter("src = 1").count() == 5
    c = logs.chunks(spark.createDataFrame([(1, text), (2, "")], "k int, t string"), "k", "t", 8).orderBy("chunk_index").collect()
    assert "\n".join(r.content for r in c) == text and [(r.start_line, r.end_line) for r in c] == [(1, 8), (9, 16), (17, 21)]
    with pytest.raises(ValueError):
        logs.chunks(df, "src", "line", 0)


def test_ranking(spark):
    files = spark.createDataFrame([("auth/login.py",), ("db/x.py",)], "file_path string")
    syms = spark.createDataFrame([("db/x.py", "login_user"), ("db/x.py", None)], "file_path string, name string")
    routes = spark.createDataFrame([("auth/login.py", "/login")], "file_path string, path string")
    imports = spark.createDataFrame([("auth/login.py", "lib/u.py")] * 2, "source string, target string")
    got = [(r.file_path, r.score) for r in ranking.file_ranking(files, syms, routes, imports, "POST /login login fails").collect()]
    assert got == [("auth/login.py", 60.0), ("db/x.py", 20.0), ("lib/u.py", 10.0)]
    seeds = spark.createDataFrame([("symbol", "login", 1.0, 1), ("file", "a.py", 0.9, 0)], "source string, name string, score double, ord int")
    nodes = spark.createDataFrame(NODES, "id string, type string, name string, ord int")
    edges = spark.createDataFrame(EDGES, "source string, target string, relationship string")
    best = {r.name: round(r.score, 2) for r in ranking.evidence_expansion(seeds, nodes.filter("ord >= 0"), edges).collect()}
    assert best["login"] == 1.0 and best["validate_user"] == 0.8 and best["DATABASE_URL"] == 0.75 and best["POST:/login"] == 0.85
    f = spark.createDataFrame([("src/main.py", "x login", 10, "2026-01-01 00:00:00"), ("z.txt", "y", 10, "2020-01-01 00:00:00")], "path string, content string, length int, modified string").withColumn("modified", F.to_timestamp("modified"))
    assert [(r.path, r.score) for r in ranking.composite_file_score(f, ["login", "main"], F.to_timestamp(F.lit("2026-01-01 00:30:00"))).collect()] == [("src/main.py", 6.5)]


def test_analysis(spark):
    ev = spark.createDataFrame([("1", "connection refused on port 5432", 1), ("2", " connection  refused on port 5432 ", 2), ("3", "[USER]: x", 3), ("4", None, 4), ("5", "GET /promise 404", 5), ("6", "z" * 601, 6), ("7", "w" * 400, 7)], "evidence_id string, content string, o int")
    f = analysis.facts(ev, "evidence_id", "content", "o")
    got = {r.statement[:20]: (r.evidence_id, len(r.statement)) for r in f.collect()}
    assert got == {"connection refused o": ("1", 31), "GET /promise 404": ("5", 16), "w" * 20: ("7", 353)}
    h = analysis.hypotheses(f)
    assert h.count() == 4 and {r.status for r in h.collect()} == {"active"}
    rc = analysis.root_causes(h).orderBy("rank").collect()
    assert rc[0].statement == "Requested route is not registered" and rc[0].confidence == 0.6
    assert analysis.status(spark.createDataFrame([(0, 1), (3, 1)], "n_support int, n_contra int")).select("score", "status").collect() == [(0.0, "rejected"), (0.8, "supported")]
    i = spark.createDataFrame([("Debug missing endpoint on the backend server, fix bug",), (None,)], "t string").select(analysis.intent(F.col("t")).alias("i")).collect()
    assert tuple(i[0].i) == ("debugging", "backend", 0.95) and tuple(i[1].i) == ("unknown", "unknown", 0.4)


def test_investigation(spark):
    ev = spark.createDataFrame([("1", "[ERROR] GET /promise returns 404", None, "LOG")], "evidence_id string, content string, collected_at timestamp_ntz, evidence_type string")
    r = investigate.investigate("Debug missing endpoint on the backend server, fix 404", ev)
    assert r.facts.count() == 2 and r.hypotheses.count() == 2 and r.root_causes.orderBy("rank").first()["statement"] == "Requested route is not registered"
    assert "# FACTS" in r.prompt.first()["prompt"] and r.plan.filter("evidence_type = 'stack_trace'").first()["priority"] == 1
    with pytest.raises(investigate.InvalidRequest):
        investigate.investigate(" ", ev)


def test_prompts(spark):
    s = F.array(prompts.text_section("current_issue", F.lit("")), prompts.list_section("facts", F.array(F.lit("a"), F.lit("b"))), prompts.list_section("none", F.array().cast("array<string>")))
    df = spark.range(1)
    assert df.select(prompts.render(F.lit("I"), s)).first()[0] == "# SYSTEM INSTRUCTIONS\n\nI\n\n# CURRENT ISSUE\n\n\n\n# FACTS\n\n- a\n- b"
    assert df.select(prompts.for_target(F.lit("I"), s, F.lit("local"))).first()[0].startswith("Task: Analyze the investigation.\n\nSYSTEM")
    with pytest.raises(Exception, match="unknown target"):
        df.select(prompts.for_target(F.lit("I"), s, F.lit("nope"))).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "node_modules" / "b.js").write_text("y")
    files = repository.listing(spark, str(tmp_path), content=True)
    assert {r.path for r in repository.keep(files, repository.CODE_FOLDERS, repository.CODE_EXTENSIONS).collect()} == {"src/a.py"}
    assert {(r.path, r.parent, r.node_type) for r in repository.tree(files).collect()} == {(".", None, "directory"), ("src", ".", "directory"), ("src/a.py", "src", "file")}
    e = repository.file_evidence(files.filter("path = 'src/a.py'")).first()
    assert e.content == "x = 1\n" and e.metadata["size_bytes"] == "6"
    assert repository.bounded_text(files.filter("length = 6"), 0).first()["text"].startswith("[Truncated — showing first 0KB of 0KB]")
    a = repository.fingerprint(files).first()
    assert a == repository.fingerprint(files.repartition(3)).first() and a != repository.fingerprint(files.limit(1)).first()
    b = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string")
    c = spark.createDataFrame([("b", "2"), ("c", "1")], "path string, hash string")
    assert {tuple(r) for r in repository.changed(b, c).collect()} == {("a", "deleted"), ("b", "changed"), ("c", "added")}


def test_stores(spark, tmp_path):
    nodes = spark.createDataFrame(NODES, "id string, type string, name string, ord int")
    edges = spark.createDataFrame(EDGES, "source string, target string, relationship string")
    stores.save_graph(nodes, edges, str(tmp_path / "g"), "p")
    n, e = stores.load_graph(spark, str(tmp_path / "g"))
    assert n.count() == len(NODES) and e.count() == len(EDGES) and spark.read.json(str(tmp_path / "g" / "metadata")).first()["node_count"] == len(NODES)
    edges.drop("source").write.mode("overwrite").parquet(str(tmp_path / "g" / "edges"))
    with pytest.raises(ValueError, match="source"):
        stores.load_graph(spark, str(tmp_path / "g"))
    assert stores.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    old = spark.createDataFrame([("x", 0, 1)], "statement string, o int, v int")
    new = spark.createDataFrame([("x", 1, 9), ("y", 3, 3), ("y", 2, 2)], "statement string, o int, v int")
    assert stores.insert_missing(old, new, "statement", "o").collect() == [("y", 2, 2)]
    t = spark.createDataFrame([("s", i, str(i), "", "fact_verified" if i % 2 else "noise", "same" if i < 4 else f"c{i}", None) for i in range(6)], stores.TIMELINE)
    assert {r.seq for r in stores.recent(t, 2).collect()} == {4, 5} and {r.seq for r in stores.signals(t).collect()} == {1, 5}


def test_streams(spark, tmp_path):
    t = spark.createDataFrame([("s", i, str(i), "2026-01-01", "a", f"c{i}", None) for i in range(5)], stores.TIMELINE)
    t.write.json(str(tmp_path / "in"))
    q = events.copy_new(events.timeline(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    ev = spark.createDataFrame([(1, "2026-01-01 00:05:00", "x"), (1, "2026-01-01 00:10:00", "x"), (1, "2026-01-01 02:00:00", "y")], "u int, ts string, k string")
    assert {(r.k, r.n) for r in events.event_counts(ev, "ts", "k").collect()} == {("x", 2), ("y", 1)}
    assert events.sessions(ev, "u", "ts").count() == 2


def test_file_watch(spark, tmp_path):
    d = tmp_path / "snap"
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("a", "2", 2), ("b", "", 2)], "path string, hash string, seq int").coalesce(1).write.json(str(d))
    s = events.file_changes(spark.readStream.schema("path string, hash string, seq int").json(str(d)))
    q = s.writeStream.format("memory").queryName("watch").option("checkpointLocation", str(tmp_path / "wcp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {tuple(r) for r in spark.table("watch").collect()} == {("a", "1", "added"), ("a", "2", "changed"), ("b", "1", "added"), ("b", "", "deleted")}


def test_longest_prefix(spark):
    i = spark.createDataFrame([("a.b.c",), ("a.x",), ("q",), ("",)], "module string")
    m = spark.createDataFrame([("a", "a.py"), ("a.b", "a/b.py")], "name string, file string")
    assert {(r.module, r.file) for r in graph.longest_prefix(i, m).collect()} == {("a.b.c", "a/b.py"), ("a.x", "a.py"), ("q", None), ("", None)}


def test_graph_of_the_second_generation(spark):
    doc = [(1, "a.py", [("A", ["B"])], [("f", ["deco"]), (None, None)], [("A", "m", None)], [("GET", "/x")], [("os",), (None,)], [("f", "A"), ("<module>", "f"), (None, "ext"), ("A.m", "A.m")], [("A", "f"), ("A", None)])]
    schema = "file_id int, file_path string, classes array<struct<name: string, bases: array<string>>>, functions array<struct<name: string, decorators: array<string>>>, methods array<struct<class_name: string, name: string, decorators: array<string>>>, routes array<struct<method: string, path: string>>, imports array<struct<module: string>>, calls array<struct<caller: string, target: string>>, inherits array<struct<class_name: string, parent: string>>"
    files = spark.createDataFrame(doc * 2, schema)
    nodes, edges = graph.build_v2(files)
    got = {(r.source, r.relationship, r.target) for r in edges.collect()}
    assert got == {
        ("file:a.py", "DEFINES", "class:A"), ("file:a.py", "DEFINES", "function:f"), ("file:a.py", "DEFINES", "method:A.m"), ("file:a.py", "EXPOSES_ROUTE", "route:GET:/x"), ("file:a.py", "IMPORTS", "module:os"),
        ("function:f", "DECORATED_BY", "decorator:deco"), ("function:f", "CALLS", "class:A"), ("file:a.py", "CALLS", "function:f"), ("file:a.py", "CALLS", "symbol:ext"), ("function:A.m", "CALLS", "method:A.m"), ("class:A", "INHERITS", "class:f"),
    }
    assert edges.count() == len(got)
    types = {r.id: r.type for r in nodes.collect()}
    assert types["class:f"] == "CLASS" and types["symbol:ext"] == "EXTERNAL_SYMBOL" and types["decorator:deco"] == "DECORATOR" and len(types) == nodes.count() == 9
    more = files.withColumn("references", F.array(F.struct(F.lit("X").alias("symbol")))).withColumn("instantiations", F.array(F.struct(F.lit("K").alias("class_name")))).withColumn("decorators", F.array(F.struct(F.lit("d").alias("decorator"))))
    extra = {(r.source, r.relationship, r.target) for r in graph.build_v2(more)[1].collect()} - got
    assert extra == {("file:a.py", "REFERENCES", "symbol:X"), ("file:a.py", "INSTANTIATES", "class:K"), ("file:a.py", "DECORATED_BY", "decorator:d")}
    empty = graph.build_v2(files.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_depth_first_and_closures(spark):
    e = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), (None, "a")], "source string, target string")
    one = spark.createDataFrame([("a",), ("zz",)], "start string")
    got = [r.id for r in graph.depth_first(e, one).filter("start = 'a'").orderBy("path").collect()]
    assert got == ["b", "d", "c"]
    assert {r.file for r in graph.file_closure(e, one).collect()} == {"a", "b", "c", "d"} == {r.file for r in graph.file_closure(e, one, incoming=True).collect()}
    s = {r.start: tuple(r)[1:] for r in graph.dependency_summary(e, one).collect()}
    assert s == {"a": (2, 1, 4, 2), "zz": (0, 0, 0, 0)}
    lengths = {(r.start, r.target): r.length for r in graph.path_lengths(e, one, spark.createDataFrame([("d",), ("a",)], "target string")).collect()}
    assert lengths == {("a", "a"): 0, ("a", "d"): 2}
    assert graph.depth_first(e, one.limit(0)).count() == 0


def test_impact_and_lookups(spark, repo):
    got = {(r.section, r.name) for r in graph.impact(repo.nodes, repo.edges, "validate_user").collect()}
    assert got == {("callers", "login"), ("dependents", "login"), ("callees", "create_token"), ("dependencies", "create_token")}
    calls = spark.createDataFrame([("A.x", "B.y"), ("B.y", "C.z")], "source string, target string")
    assert {(r.section, r.name) for r in graph.impact_v3(calls, "C.z").collect()} == {("callers", "B.y"), ("dependents", "B.y"), ("dependents", "A.x")}
    assert graph.find_v1(repo.nodes, "LOGIN", "symbol").count() == 1 and graph.find_v1(repo.nodes, "nope", "id").count() == 0
    docs = {r.what for r in graph.projection(repo.nodes, repo.edges).collect()}
    assert docs == {"node", "edge"} and {r.what: r.n for r in graph.counts(repo.nodes, repo.edges).collect()}["edge CALLS"] == 4
    repo.register("where_is_symbol", lambda name: ask.Answer("mine", 1.0, name))
    assert repo.ask("find bar").capability == "mine" and repo.capabilities() == sorted(ask.CAPABILITIES)
    repo.plugins["where_is_symbol"] = repo.where_is_symbol


def test_lines_within_the_row(spark):
    text = "\n".join(["a"] * 3 + ["b", "Traceback x", "  in f", "", "c"] + [f"l{i}" for i in range(12)] + ["boom 404", "", "stack trace z"])
    texts = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x\n\ny\ny"), (5, "error " * 50_000)], "k int, t string")
    df, rows = logs.in_rows(texts, "k", "t"), logs.exploded(texts, "k", "t")
    pairs = lambda d: {(r.src, r.pos, r.line) for r in d.collect()}
    flat = lambda c: pairs(df.select("src", F.explode(c).alias("x")).select("src", "x.pos", "x.line"))
    length = F.col("l")
    assert flat(logs.error_lines_of(length)) == pairs(logs.error_lines(rows)) and flat(logs.without_blank_of(length)) == pairs(logs.without_blank(rows))
    assert flat(logs.without_repeats_of(length)) == pairs(logs.without_repeats(rows)) and flat(logs.error_context_of(length, 1, 2)) == pairs(logs.error_context(rows, 1, 2))
    assert flat(logs.investigation_view_of(length)) == pairs(logs.investigation_view(rows))
    assert flat(logs.head_and_tail_of(length, 10, 2, 3)) == pairs(logs.head_and_tail(rows, 10, 2, 3).select("src", "pos", "line"))
    traces = {tuple(r) for r in df.select("src", F.explode(logs.stack_traces_of(length)).alias("t")).select("src", "t.*").collect()}
    assert traces == {tuple(r) for r in logs.stack_traces(rows).collect()} and len(traces) == 2


def test_next_step_and_routing(spark):
    rows = [("Please paste these files: `a/b.py` and `c.dart`",), ("got 404, not found on GET /x/1",), ("404 missing",), ("the JSON contract",), ("what i need next",), ("hm",), ("",), (None,)]
    got = [tuple(r.n) if r.n else None for r in spark.createDataFrame(rows, "t string").select(tx.next_step(F.col("t")).alias("n")).collect()]
    assert got[0] == ("AI requested specific files to be pasted", "Paste the requested files into the conversation", "Here are the requested files: a/b.py, c.dart", ["a/b.py", "c.dart"])
    assert got[1][1:3] == ("Implement missing GET /x/1 endpoint", "Implement GET /x/1 endpoint as discussed") and got[2][1:3] == ("Review conversation and continue debugging", "")
    assert got[3][2] == "Verify JSON contract between server and Flutter models" and got[4][0] == "AI outlined next steps" and got[5][0] == got[6][0] == "Analyzed conversation"
    t = [tuple(r.t) if r.t else None for r in spark.createDataFrame([("fix the crash", None), ("latest news", "x"), (None, None), (" ", "")], "i string, c string").select(tx.task_routing(F.col("i"), F.col("c")).alias("t")).collect()]
    assert t[0][:2] == ("debug", "claude") and t[1][:3] == ("research", "gemini", "Gemini") and t[2:] == [None, None]


def test_keywords_of_ticked_names(spark):
    got = spark.createDataFrame([("see ` Main.dart ` and `.env` or `x.tar.gz` and `a\nb`",)], "t string").select(tx.keywords(F.col("t"))).first()[0]
    assert {"main.dart", ".env", "x.tar.gz", "x.tar"} <= set(got) and "a\nb" not in got


def test_suggested_files(spark):
    f = spark.createDataFrame([("src/main.py", "", 1, "2020-01-01"), ("lib/main.py", "", 1, "2020-01-01")], "path string, content string, length int, modified string").withColumn("modified", F.to_timestamp("modified"))
    now = F.to_timestamp(F.lit("2026-01-01"))
    assert [(r.path, r.score) for r in ranking.composite_file_score(f, [], now, ["app/src/main.py"]).collect()] == [("src/main.py", 7.0), ("lib/main.py", 2.0)]


def test_patterns(spark):
    names = ["a.py", ".hid.py", "src/a.py", "src/x/b.py", "src/.h/c.py", "src/x/d[1].ts", "top/e.md"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    of = lambda p, **k: {r.path for r in repository.expand(files, [p], **k).collect()}
    assert of("*.py") == {"a.py"} and of("**/*.py") == {"a.py", "src/a.py", "src/x/b.py"} and of("src") == {"src/a.py", "src/x/b.py", "src/.h/c.py", "src/x/d[1].ts"}
    assert of("s?c/[!x].py") == {"src/a.py"} and of("wrong/b.py") == {"src/x/b.py"} and of("wrong/b.py", fallback=False) == set() and of("none.x") == set()
    assert repository.expand(files, []).count() == 0 and of("src/**") == {"src/a.py", "src/x/b.py", "src/x/d[1].ts"}
    given = spark.createDataFrame([("log", "a.py"), ("log", "zz"), ("odd", "a.py")], "evidence_type string, path string")
    assert [tuple(r) for r in repository.file_arguments(given, ["log"], files).collect()] == [("log", "a.py")]


def test_questions_as_a_column(spark):
    qs = ["Who calls A.b?", "what does X call", "Can A reach B?", "trace A -> B", " Who  calls  x ", "hello", "", None]
    for r in spark.createDataFrame([(q,) for q in qs], "q string").select("q", ask.parsed(F.col("q")).alias("p")).collect():
        want = ask.parse(r.q or "")
        assert (r.p.intent_type, r.p["first"], r.p.second) == (want["intent_type"], want.get("symbol", want.get("start", "")), want.get("target", "")), r.q


def test_kept_investigation(spark, tmp_path):
    from tessera.sources import projects

    ev = spark.createDataFrame([("1", "[ERROR] GET /promise returns 404", None, "LOG"), ("2", "timeout after 3 s", None, "LOG")], "evidence_id string, content string, collected_at timestamp_ntz, evidence_type string")
    s = projects.Sessions(spark, str(tmp_path / "ses"))
    got = investigate.investigate("Debug the 404", ev, sessions=s, session="p")
    assert got.summary()["root_cause"] == "Requested route is not registered" and got.questions.count() == 1
    st = s.stats().first()
    assert (st.facts, st.hypotheses, st.evidence) == (3, 3, 2) and s.memory("p")["root_cause"] == ["Requested route is not registered"]
    investigate.investigate("Debug the 404", ev, sessions=s, session="p")
    again = s.summary("p").first()
    assert (again.facts, again.hypotheses, again.evidence) == (3, 3, 4) and again.root_cause == "Requested route is not registered"
    s.delete("p")
    assert not s.exists("p") and s.table("facts", "p").count() == 0
    s.delete("p")
    s.create("p")
    assert s.resume("p").count() == 2 and s.path("facts").endswith("/facts")
    with pytest.raises(investigate.AdaptionFailed):
        investigate.investigate("x", ev.drop("content"))
    with pytest.raises(investigate.AnalysisFailed):
        investigate.investigate("x", ev, stages=investigate.Stages(facts=lambda *a: 1 / 0))
    assert issubclass(investigate.UnknownEvidence, investigate.CollectionFailed)


def test_context_and_cache(spark, repo, tmp_path):
    from tessera.plans import context

    seeds = spark.createDataFrame([("login",), ("nope",)], "name string")
    got = {(r.section, r.source, r.target, r.relationship) for r in context.investigation_context(repo.nodes, repo.edges, seeds, "post /login fails", ["GET /q"]).collect()}
    assert ("dependencies", "login", "DATABASE_URL", "DEPENDS_ON") in got and ("dependencies", "POST:/login", "login", "CALLS") in got and ("dependencies", "login", "validate_user", "CALLS") in got
    assert ("routes", "GET:/q", "GET:/q", "") in got and ("route_chains", "POST:/login", "create_token", "") in got and ("call_chains", "login", "create_token", "CALLS") in got
    path = str(tmp_path / "g")
    stores.save_graph(repo.nodes, repo.edges, path, "p")
    cache = stores.GraphCache(spark)
    assert cache.load(path)[0] is cache.load(path)[0] and cache.contains(path)
    cache.invalidate(path)
    cache.clear()
    assert not cache.contains(path)


def test_repository_section(spark):
    r = spark.createDataFrame([(1, "debug", "I", None, None, None, None, None, None, "r" * 2000)], "request_id int, task_type string, intent string, expected string, actual string, conversation string, conversation_summary string, extra_context string, files array<struct<path: string, content: string>>, readme string")
    repo_ = F.struct(F.lit("o").alias("owner"), F.lit("n").alias("repo"), F.col("readme"), F.lit("a\nb").alias("file_tree"))
    p = prompts.build(r, repo_).first()["prompt"]
    assert "GitHub Repository: o/n\n\nREADME:\n" + "r" * 1500 + "\nFile structure:\na\nb" in p and "r" * 1501 not in p
    assert "GitHub" not in prompts.build(r).first()["prompt"]


def test_shared_folder(spark, tmp_path):
    from tessera import session

    staged = session.stage(spark.range(3), "x")
    path = session._STAGED[-1][1]
    assert staged.count() == 3 and path.startswith(spark.conf.get("spark.checkpoint.dir"))
    session.drop_stages()
    import os

    assert not os.path.exists(path.removeprefix("file://")) and session._STAGED == []

    class Conf:
        @staticmethod
        def get(name, default=None):
            return default

    class Fake:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://h:7077"

    with pytest.raises(ValueError, match="share"):
        session.shared_dir(Fake())
