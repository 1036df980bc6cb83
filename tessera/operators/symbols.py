"""Symbols of source files: one parse a file, one table of tagged rows.

``extract`` runs Python's parser in ``mapInPandas`` (nothing JVM-side can read
Python) and emits every kind at once; all further work is on columns. Routes of
Dart and JavaScript are read by expressions without Python.

Files that don't parse give one ``error`` row in lenient mode and fail the job
in strict mode. Null and empty contents give no rows.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SCHEMA = "file_path string, ord int, kind string, name string, owner string, detail string, line int, end_line int, items array<string>"
# Verbs of route decorators.
VERBS = ("get", "post", "put", "delete", "patch")


def qualified(node: ast.AST) -> str | None:
    """Dotted name of a name or attribute chain; None if it has no name."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(parts)])


class Extractor(ast.NodeVisitor):
    """All kinds of one file, in source order.

    ``asynchronous=False`` reproduces the first generation, which doesn't
    record async functions (what stands inside them is)."""

    def __init__(self, asynchronous: bool = True) -> None:
        self.rows: list[tuple] = []
        self.classes: list[str] = []
        self.functions: list[str] = []
        self.methods: dict[str, set[str]] = {}
        self.locals: list[dict[str, str]] = []
        self.asynchronous = asynchronous

    def add(self, kind, name, owner=None, detail=None, line=None, end=None, items=None) -> None:
        self.rows.append((kind, name, owner, detail, line, end, items))

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", a.name, line=node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("import", node.module or "", detail=a.name, line=node.lineno)

    def _decorators(self, node) -> list[str]:
        out = []
        for d in node.decorator_list:
            name = qualified(d.func if isinstance(d, ast.Call) else d)
            if name:
                out.append(name)
                self.add("decorator", name, node.name, line=d.lineno)
        return out

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [b for b in map(qualified, node.bases) if b]
        self.add("class", node.name, line=node.lineno, end=node.end_lineno, items=bases)
        self._decorators(node)
        for b in bases:
            self.add("inherit", b, node.name, line=node.lineno)
        self.methods[node.name] = {n.name for n in node.body if isinstance(n, ast.FunctionDef)}
        self.classes.append(node.name)
        self.generic_visit(node)
        self.classes.pop()

    def _function(self, node, recorded: bool) -> None:
        if recorded:
            decorators = self._decorators(node)
            if self.classes:
                self.add("method", node.name, self.classes[-1], line=node.lineno, end=node.end_lineno, items=decorators)
            else:
                self.add("function", node.name, line=node.lineno, end=node.end_lineno, items=decorators)
            for d in node.decorator_list:
                self._route(node, d)
        self.functions.append(node.name)
        self.locals.append({})
        self.generic_visit(node)
        self.locals.pop()
        self.functions.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._function(node, True)

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self._function(node, self.asynchronous)

    def _route(self, node, d: ast.AST) -> None:
        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str)):
            return
        path, verb = d.args[0].value, d.func.attr.lower()
        if verb in VERBS:
            self.add("route", path, node.name, verb.upper(), node.lineno, items=["fastapi"])
        elif verb == "route":
            methods = ["GET"]
            for k in d.keywords:
                if k.arg == "methods" and isinstance(k.value, ast.List):
                    methods = [e.value.upper() for e in k.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)] or methods
            for m in methods:
                self.add("route", path, node.name, m, node.lineno, items=["flask"])

    def visit_Assign(self, node: ast.Assign) -> None:
        if self.locals and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name) and node.value.func.id[:1].isupper():
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self.locals[-1][t.id] = node.value.func.id
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            self.add("called", node.func.id if isinstance(node.func, ast.Name) else node.func.attr, line=node.lineno)
        target = qualified(node.func)
        caller = self.functions[-1] if self.functions else "<module>"
        if target:
            self.add("call", target, caller, line=node.lineno)
            if target.rpartition(".")[2][:1].isupper():
                self.add("instantiation", target, caller, line=node.lineno)
        if isinstance(node.func, ast.Attribute) and self.classes and self.functions:
            value, method = node.func.value, node.func.attr
            owner = None
            if isinstance(value, ast.Name) and value.id == "self":
                owner = self.classes[-1] if method in self.methods.get(self.classes[-1], ()) else None
            elif isinstance(value, ast.Name):
                owner = self.locals[-1].get(value.id)
            elif isinstance(value, ast.Call) and isinstance(value.func, ast.Name):
                owner = value.func.id
            if owner:
                self.add("method_call", f"{owner}.{method}", f"{self.classes[-1]}.{self.functions[-1]}", line=node.lineno)
        self.generic_visit(node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.add("member", node.attr, line=node.lineno)
        if (name := qualified(node.value)) is not None:
            self.add("attribute", node.attr, name, line=node.lineno)
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        self.add("reference", node.id, line=node.lineno)


def extract(files: DataFrame, *, strict: bool = False, asynchronous: bool = True) -> DataFrame:
    """Tagged rows of ``files(path, content)``; ``ord`` is the source order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                if not content:
                    continue
                try:
                    visitor = Extractor(asynchronous)
                    visitor.visit(ast.parse(content))
                    got = visitor.rows
                except (SyntaxError, ValueError, RecursionError) as e:
                    if strict:
                        raise
                    got = [("error", type(e).__name__, None, None, getattr(e, "lineno", None), None, None)]
                rows += [(path, i, *r) for i, r in enumerate(got)]
            frame = pd.DataFrame(rows, columns=columns)
            for c in ("ord", "line", "end_line"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def script_routes(files: DataFrame) -> DataFrame:
    """(file_path, line, method, path, framework) of Dart and JavaScript: the
    first registration of each line, by expressions alone."""
    rows = files.select(F.col("path").alias("file_path"), F.posexplode(F.split("content", r"\r?\n")).alias("pos", "text"))
    dart = F.lower("file_path").rlike(r"\.dart$")
    script = F.lower("file_path").rlike(r"\.(?:js|ts)$")
    call = r"\.(get|post|put|patch|delete)\s*\(\s*['\"]([^'\"]+)['\"]"
    either, router = rf"(?i)(?:app|router){call}", rf"(?i)router{call}"
    pick = lambda g: F.when(dart, F.regexp_extract("text", router, g)).when(script, F.regexp_extract("text", either, g))
    rows = rows.select("file_path", (F.col("pos") + 1).alias("line"), F.upper(pick(1)).alias("method"), pick(2).alias("path"), F.when(dart, "shelf").otherwise("express").alias("framework"))
    return rows.filter("path <> ''")


def route_index(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """All routes of all languages, by path, method and file."""
    python = symbols.filter("kind = 'route'").select("file_path", "line", F.col("detail").alias("method"), F.col("name").alias("path"), F.col("owner").alias("handler"), F.col("items")[0].alias("framework"))
    return python.unionByName(script_routes(files).withColumn("handler", F.lit("unknown"))).orderBy("path", "method", "file_path", "line")


def resolved_calls(symbols: DataFrame) -> DataFrame:
    """Calls between class methods with the first file that has the callee."""
    calls = symbols.filter("kind = 'method_call'").select(F.col("owner").alias("caller_symbol"), F.col("name").alias("callee_symbol"), F.col("file_path").alias("caller_file"), F.col("line").alias("line_number"))
    where = symbols.filter("kind = 'method'").groupBy(F.concat_ws(".", "owner", "name").alias("callee_symbol")).agg(F.min("file_path").alias("callee_file"))
    return calls.join(where, "callee_symbol", "left").select("caller_symbol", "callee_symbol", "caller_file", F.coalesce("callee_file", F.lit("")).alias("callee_file"), "line_number")


def symbol_document(symbols: DataFrame) -> DataFrame:
    """One row a file with the arrays of the symbol-index document."""
    pick = lambda kind, *f: F.array_sort(F.filter(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", *f))), lambda x: x.isNotNull()))
    name, owner, line, end = F.col("name"), F.col("owner"), F.col("line"), F.col("end_line")
    return symbols.groupBy("file_path").agg(
        pick("class", name, line, end, F.col("items").alias("bases")).alias("classes"),
        pick("function", name, line, end, F.col("items").alias("decorators")).alias("functions"),
        pick("method", owner.alias("class_name"), name, line, end, F.col("items").alias("decorators")).alias("methods"),
        pick("route", name.alias("path"), F.col("detail").alias("method"), owner.alias("function_name"), line).alias("routes"),
        pick("import", name.alias("module"), F.col("detail").alias("imported"), line).alias("imports"),
        pick("call", owner.alias("caller"), name.alias("target"), line).alias("calls"),
        pick("inherit", owner.alias("class_name"), name.alias("parent"), line).alias("inherits"),
        pick("reference", name.alias("symbol"), line).alias("references"),
        pick("instantiation", name.alias("class_name"), line).alias("instantiations"),
        pick("decorator", name.alias("decorator"), line).alias("decorators"),
    )


def definitions_and_references(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, type, file, line) of classes and functions, methods among the
    latter, and (name, file, line, context) of their uses: names, calls (again as
    name or attribute) and attributes."""
    d = symbols.filter("kind in ('class', 'function', 'method')").select("name", F.when(F.col("kind") == "class", "class").otherwise("function").alias("type"), F.col("file_path").alias("file"), "line")
    context = F.create_map(*[F.lit(x) for x in ("reference", "name", "called", "call", "member", "attribute")])
    r = symbols.filter("kind in ('reference', 'called', 'member')").select("name", F.col("file_path").alias("file"), "line", context[F.col("kind")].alias("context"))
    return d, r
