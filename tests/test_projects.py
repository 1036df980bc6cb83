import pytest
from pyspark.sql import functions as F

from tessera.operators import analysis, graph, prompts, routes
from tessera.plans import context
from tessera.sources import projects, repository

ROUTES = [("GET", "/a", "ha", "x.py", 1), ("GET", "/a", "hb", "y.py", 2), ("POST", "/b", None, "x.py", 3)]


def test_routes(spark):
    r = spark.createDataFrame(ROUTES, "method string, path string, handler string, file_path string, ord int")
    d = spark.createDataFrame([("y.py", "f", "function"), ("x.py", "g", "function")], "file string, name string, type string")
    u = spark.createDataFrame([("hb", "z.py", 4), ("hb", "a.py", 9), ("ha", "q.py", 1)], "name string, file string, line int")
    assert routes.handlers(r).collect() == [("GET:/a", "hb", "y.py")]
    assert routes.symbols_of(r, d).collect() == [("GET:/a", "f", "function")]
    assert [x.name for x in routes.request_trace(r, u).orderBy("step").collect()] == ["GET:/a", "hb", "a.py:9", "z.py:4"]
    c = spark.createDataFrame([("hb", "m"), ("m", "t")], "source string, target string")
    assert routes.trace_to(r, c, "GET:/a", "t") == ["GET:/a", "hb", "m", "t"] and routes.trace_to(r, c, "GET:/zz", "t") == []
    assert routes.catalogue(r).count() == 3
    m = spark.createDataFrame([("S", "login")], "class_name string, name string")
    assert routes.find_callable(c, m, "login").collect() == [("S.login", "login", "method")] and routes.find_callable(c, m, "m").first()["type"] == "function"


def test_context(spark):
    nodes = spark.createDataFrame([("f:a", "FUNCTION", "login", 0), ("f:b", "FUNCTION", "check", 1), ("f:c", "FUNCTION", "deep", 2), ("r", "ROUTE", "GET:/x", 3)], "id string, type string, name string, ord int")
    edges = spark.createDataFrame([("f:a", "f:b", "CALLS"), ("f:b", "f:c", "CALLS"), ("r", "f:a", "CALLS")], "source string, target string, relationship string")
    ctx = context.repository_context(nodes, edges, spark.createDataFrame([("login",)], "name string")).cache()
    assert {(x.section, x.value) for x in ctx.collect()} == {("symbols", "FUNCTION"), ("callers", "GET:/x"), ("callees", "check"), ("dependencies", "check"), ("call_chains", "check"), ("call_chains", "deep")}
    assert context.answer("Where is login?", ctx) == ("login is present in the repository as a function.", 0.90)
    assert context.answer("x", ctx, ["GET:/x"])[1] == 0.85 and context.answer("x", ctx)[1] == 0.80 and context.answer("x", ctx.limit(0))[1] == 0.0
    assert {(x.section, x.value) for x in context.retrieve(nodes, edges, "is login ok", ["GET:/x"]).collect()} == {("symbols", "login"), ("symbols", "check"), ("symbols", "deep"), ("routes", "GET:/x")}
    refs = spark.createDataFrame([("login", "z.py", 3)], "name string, file string, line int")
    ranked = spark.createDataFrame([("a.py", 5.0), ("b.py", 9.0)], "file_path string, score double")
    got = {(x.section, x.ord, x.value) for x in context.package_v1(nodes, refs, ranked, "login").collect()}
    assert got == {("files", 1, "b.py"), ("files", 2, "a.py"), ("symbols", 1, "login"), ("references", 1, "z.py:3:login")}


def test_prompt_v2(spark):
    strings = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    deps = F.array(F.struct(F.lit("a").alias("source"), F.lit("b").alias("target")))
    p = spark.range(1).select(context.prompt_v2(F.lit("I"), strings("f.py"), strings(), deps, F.array(strings("x", "y")), strings("R"), strings("fact"), strings("h1", "h2"))).first()[0]
    assert p.startswith("INVESTIGATION ISSUE\n\nI\n\nRELEVANT FILES\n\n- f.py\n\nDEPENDENCIES\n\na\n  -> b\n\nEXECUTION PATHS\n\nx\n ↓\ny\n\nROUTE CONTEXT\n\nR\n\nFACTS\n\n- fact\n\nHYPOTHESES\n\n1. h1\n2. h2\n\nINVESTIGATION INSTRUCTIONS")


def test_templates(spark):
    assert prompts.template("nope") == prompts.template("debugging") and len(prompts.TEMPLATES) == 5
    i, s = prompts.package("code_review", {"project": F.lit("P"), "extra": F.lit("E")}, {"verified_facts": F.array(F.lit("x"))})
    text = spark.range(1).select(prompts.render(i, s)).first()[0]
    assert text.startswith("# SYSTEM INSTRUCTIONS\n\nAct as a senior reviewer.") and "# VERIFIED FACTS\n\n- x" in text and text.endswith("# EXTRA\n\nE") and "TIMELINE" not in text


def test_log_evidence(spark):
    df = spark.createDataFrame([(1, "\n".join(map(str, range(200)))), (2, "a\nb\n"), (3, None)], "k int, t string")
    got = {r.k: r for r in projects.log_evidence(df, "k", "t", 50, 10, 20).collect()}
    assert got[1].was_trimmed and got[1].retained_line_count == 38 and "170 lines omitted" in got[1].content and got[1].content.endswith("199")
    assert not got[2].was_trimmed and got[2].content == "a\nb"


def test_project(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("class A:\n    def m(self):\n        return f()\ndef f(): pass\n")
    (src / "README.md").write_text("hello")
    out = str(tmp_path / "art")
    nodes, edges = projects.open_project(spark, str(src), out)
    assert edges.filter("source = 'function:m' and target = 'function:f'").count() == 1
    assert projects.build_artifacts(spark, str(src), out)["symbols"] == 3 and graph.type_counts(projects.open_project(spark, str(src), out)[0]).count() >= 3
    files = repository.listing(spark, str(src), content=True)
    ev = projects.project_evidence(files).collect()
    assert {(r.evidence_type, r.path) for r in ev} == {("PROJECT_SUMMARY", "."), ("PROJECT_FILE", "a.py"), ("PROJECT_FILE", "README.md")} and "Python" in next(r.content for r in ev if r.path == ".")
    assert projects.repository_digest(files.withColumn("path", F.col("path"))).first()["readme"] == "hello"
    got = projects.by_plan(["stack_trace", "repository_code", "config_file", "nope"], {"file": lambda: repository.file_evidence(files)})
    assert got.count() == 2 and projects.by_plan(["x"], {}) is None


def test_registry_and_sessions(spark, tmp_path):
    r = projects.Registry(spark, str(tmp_path / "reg"))
    assert r.projects().count() == 0
    r.register("Zed", "/z", "/a1")
    r.register("alpha", "/p", "/a2")
    r.register("Zed2", "/z", "/a3")
    assert [x.project_name for x in r.projects().collect()] == ["alpha", "Zed2"] and r.find("ALPHA").count() == 1
    assert r.remove("zed2") and not r.remove("zed2") and r.projects().count() == 1
    s = projects.Sessions(spark, str(tmp_path / "ses"))
    s.create("p")
    with pytest.raises(FileExistsError):
        s.create("p")
    with pytest.raises(FileNotFoundError):
        s.load("q")
    assert s.add_fact("p", " x ") and not s.add_fact("p", "x")
    s.add_hypothesis("p", "h", "it broke")
    s.set_status("p", "h", "confirmed")
    s.remember("p", "decision", "b")
    s.remember("p", "decision", "a")
    s.save("p")
    assert s.hypotheses("p").first()["status"] == "confirmed" and s.memory("p") == {"decision": ["a", "b"]}
    assert [e.type for e in s.load("p").collect()][-1] == "session_loaded" and s.names().first()["session"] == "p"
    st = s.stats().first()
    assert (st.facts, st.evidence, st.events) == (1, 0, 3)


def test_questions(spark):
    plan = analysis.evidence_plan(spark.createDataFrame([("r", "debugging", "backend"), ("s", "unknown", "unknown")], "request_id string, investigation_type string, domain string"), spark.createDataFrame([("s", "repository_code"), ("s", "project_structure"), ("r", "server_logs")], "request_id string, evidence_type string"))
    q = {r.request_id: r for r in projects.questions(plan).collect()}
    assert q["r"].questions[0] == "Please provide stack trace." and q["r"].combined == "Please provide:\n\n1. stack trace\n2. API routes\n3. repository implementation"
    assert q["s"].combined == "All required evidence has been collected."
    h = spark.createDataFrame([("u", i) for i in range(8)], "u string, t int")
    assert {x.t for x in projects.prompt_history(h, "u", "t").collect()} == {3, 4, 5, 6, 7}
