import json

from hypothesis import given, settings, strategies as st

from tessera.operators import nested

DOC = {"project": "p", "files": [{"file_path": "a.py", "classes": [{"name": "C", "line": "3", "methods": {"name": "m", "line": 4, "calls": [{"target": "f", "line": 5}, None]}}, None], "functions": [{"name": "f", "line": 9, "calls": {"target": "C.m"}}], "routes": [{"method": "GET", "path": "/x", "line": 8}], "imports": {"module": "os", "line": 1}, "x_new": {"seen": 1}}]}


def kids(df):
    return {tuple(r) for r in df.collect()}


def test_layouts_give_the_same_children(spark):
    as_map = {"files": {"a.py": {k: v for k, v in DOC["files"][0].items() if k != "file_path"}}}
    flat_methods = json.loads(json.dumps(DOC))
    f = flat_methods["files"][0]
    m = f["classes"][0].pop("methods")
    f["methods"] = [m | {"class_name": "C"}]
    rows = [(1, json.dumps(DOC)), (2, json.dumps(as_map)), (3, json.dumps(flat_methods)), (4, json.dumps(json.dumps(DOC)))]
    df = spark.createDataFrame(rows, "artifact_id bigint, symbols string")
    got = nested.child_rows(nested.flatten_json(df, "artifact_id", "symbols"), "o")
    by = {k: {tuple(r)[2:] for r in got.filter(f"record_id = '{k}'").collect()} for k in "1234"}
    want = {("a.py", "class", "a.py", "C", 3), ("a.py", "method", "C", "m", 4), ("a.py", "call", "C.m", "f", 5), ("a.py", "function", "a.py", "f", 9), ("a.py", "call", "f", "C.m", 0), ("a.py", "route", "a.py", "GET /x", 8), ("a.py", "import", "a.py", "os", 1)}
    assert by["1"] == by["2"] == by["3"] == by["4"] == want


def test_links_and_unknown_fields(spark):
    df = spark.createDataFrame([(1, json.dumps(DOC))], "artifact_id bigint, symbols string")
    rows = nested.flatten_json(df, "artifact_id", "symbols").collect()
    ids = {r.node_id for r in rows}
    assert all(r.parent_id in ids for r in rows if r.subtype in nested.CHILD_KINDS)
    assert json.loads(next(r.extra for r in rows if r.subtype == "file")) == {"x_new": {"seen": 1}}
    assert next(r.variant for r in rows if r.subtype == "route") == "route{line:int,method:str,path:str}"


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "{broken"), (5, "[]"), (6, "null"), (7, '{"files": null}'), (8, '{"files": [null, 3]}')]
    df = spark.createDataFrame(rows, "artifact_id bigint, symbols string")
    got = nested.flatten_json(df, "artifact_id", "symbols").collect()
    assert [(r.record_id, r.subtype) for r in got] == [("4", "unparsed")]


def test_all_sources_and_repeats(spark):
    arts = spark.createDataFrame([(1, json.dumps(DOC), "x")] * 2, "artifact_id bigint, symbols string, record_id string")
    calls = "calls array<struct<caller string, target string, line int>>".replace("caller string", "caller: string").replace("target string", "target: string").replace("line int", "line: int")
    files = spark.createDataFrame([(7, "b.py", [(None, "g", None), ("A.b", "h", 2), None]), (7, "b.py", [(None, "g", None), ("A.b", "h", 2), None]), (8, "c.py", None), (9, None, [])], f"file_id bigint, file_path string, {calls}")
    meta = {"file_path": "d.py", "body": {"calls": [{"target": "z", "line": "4", "args": {"name": "q", "value": None}}, {"target": "y", "args": [None]}]}}
    nodes = spark.createDataFrame([(5, "n", json.dumps(meta)), (6, None, None)], "node_key bigint, name string, metadata string")
    got = kids(nested.nested_children(arts, files, nodes))
    assert ("file_symbols", "7", "b.py", "call", "b.py", "g", 0) in got and ("file_symbols", "7", "b.py", "call", "A.b", "h", 2) in got
    assert ("graph_node", "5", "d.py", "call", "n", "z", 4) in got and ("graph_node", "5", "d.py", "argument", "z", "q", 4) in got and ("graph_node", "5", "d.py", "call", "n", "y", 0) in got
    assert len(got) == 7 + 2 + 3


def test_empty_tables(spark):
    assert nested.flatten_json(spark.createDataFrame([], "artifact_id bigint, symbols string"), "artifact_id", "symbols").count() == 0


def test_calls_of_files_go_through_the_automaton(spark):
    from tessera.operators import nested

    call = "array<struct<caller: string, target: string, line: int>>"
    rows = [(1, "a.py", [("f", "g", 3), None, ("", "h", None), (None, None, 4), ("f", "g", 3)]), (2, None, [("f", "g", 1), (None, "k", 2)]), (3, "b.py", None), (4, "c.py", [])]
    files = spark.createDataFrame(rows, f"file_id bigint, file_path string, calls {call}")
    flat = nested.flatten_calls(files, "file_id", "file_path", "calls")
    got = nested.child_rows(flat, "file_symbols").distinct()
    want = nested.call_rows(files, "file_id", "file_path", "calls", "file_symbols").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 5
    keys = flat.filter("subtype = 'call'").select("record_id", "node_id", "parent_id", "variant").collect()
    assert len({(r.record_id, r.node_id) for r in keys}) == 6 and {r.parent_id for r in keys} == {"$"} and all(r.variant.startswith("call{") for r in keys)


def test_elements_of_other_kinds(spark):
    doc = {"files": [{"file_path": "a.py", "imports": ["os", 7, None, ["re", [{"module": "ast"}]]], "calls": ["g"], "functions": {"f": {"line": 3, "calls": "h"}, "k": {"line": 4}}, "classes": {"name": "C", "bases": "B"}}]}
    df = spark.createDataFrame([(1, json.dumps(doc))], "artifact_id bigint, symbols string")
    got = {(r.child_kind, r.parent_name, r.child_name, r.line_no) for r in nested.child_rows(nested.flatten_json(df, "artifact_id", "symbols"), "o").collect()}
    assert got == {("import", "a.py", n, 0) for n in ("os", "7", "re", "ast")} | {("call", "a.py", "g", 0), ("function", "a.py", "f", 3), ("function", "a.py", "k", 4), ("call", "f", "h", 0), ("class", "a.py", "C", 0)}


def test_any_depth(spark):
    deep = '{"a":' * 10_000 + json.dumps(DOC) + "}" * 10_000
    broken = "[" * 10_000 + "]" * 9_999 + "}"
    calls = '{"calls":[{"target":"f"}],"body":' * 3_000 + "1" + "}" * 3_000
    df = spark.createDataFrame([(1, deep, "n"), (2, broken, "n"), (3, calls, "n")], "k bigint, j string, n string")
    got = nested.flatten_json(df, "k", "j").groupBy("record_id", "subtype").count().collect()
    by = {(r.record_id, r.subtype): r["count"] for r in got}
    assert by[("1", "method")] == by[("1", "file")] == 1 and by[("1", "call")] == 2 and by[("2", "unparsed")] == 1
    assert nested.flatten_json(df.filter("k = 3"), "k", "j", "n").filter("subtype = 'call'").count() == 3_000


def test_states_are_bounded():
    a = nested.TreeAutomaton()
    sizes = []
    for n in range(2000):
        a.states({"files": {f"src/m{n}.py": {"functions": [{"name": "f", "line": n}], f"x{n}": n}, f"lib/m{n}.py": {"calls": []}}, f"k{n}": [n]})
        sizes.append(len(a.names))
    assert sizes[0] == sizes[-1] < 12


def test_typed_tables(spark):
    df = spark.createDataFrame([(1, json.dumps(DOC))], "artifact_id bigint, symbols string")
    tables = nested.subtype_tables(nested.flatten_json(df, "artifact_id", "symbols"))
    assert set(tables) == set(nested.TYPED)
    m = tables["method"].first()
    c = tables["class"].first()
    assert m.class_name == "C" and m.parent_id == c.node_id and m.name == "m" and "bases" not in m.asDict() and c.line == 3
    r = tables["route"].first()
    assert (r.method, r.path) == ("GET", "/x") and tables["import"].first().name == "os" and tables["unparsed"].count() == 0


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(JSON, st.booleans())
def test_deep_reader_and_writer(value, spaced):
    text = json.dumps(value, indent=1 if spaced else None)
    assert nested._deep(text) == value
    for cut in range(0, len(text), max(1, len(text) // 5)):
        try:
            want = json.loads(text[:cut])
        except ValueError:
            want = ValueError
        try:
            got = nested._deep(text[:cut])
        except ValueError:
            got = ValueError
        assert got == want, text[:cut]


def test_deep_writer():
    deep = [1]
    for _ in range(20_000):
        deep = [deep, {"k": "é"}]
    assert nested._dumps(deep).startswith("[" * 20_001 + "1]") and nested._dumps({"a": [{}, []]}) == '{"a":[{},[]]}'
