"""Questions about a repository: grammar, router, capabilities, answers.

A question is one string, so it is routed on the driver; what it asks for is a
DataFrame plan over nodes and edges. :func:`routed` does the routing of a
column of questions as expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators import graph

# Phrases and noise words of the router, in order of its rules.
ROUTE = r"\b(GET|POST|PUT|PATCH|DELETE)\s+(/[/\w\-]*)"
TRACE_WORDS = ("trace", "flow", "path", "route")
RULES = (
    ("impact_analysis", ("what breaks if", "impact", "affected by", "depends on", "blast radius"), ("what breaks if", "impact", "affected by", "depends on", "blast radius", "changes", "change", "for", "the", "of")),
    ("where_is_symbol", ("who calls", "what calls", "callers of", "called by"), ("who calls", "what calls", "callers of", "called by", "who", "what", "calls", "the")),
    ("where_is_symbol", ("what does", "callees of", "calls from", "what is called by"), ("what does", "callees of", "calls from", "what is called by", "what", "does", "call", "calls", "the")),
    ("call_chain", ("execution flow", "execution path", "call chain", "flow"), ("show", "trace", "execution flow", "execution path", "call chain", "flow", "for", "the")),
    ("where_is_symbol", ("where is", "where", "find", "implemented", "handled", "defined"), ("where is", "where", "find", "handled", "implemented", "defined", "located", "declared", "for", "the")),
)
GRAMMAR = (
    ("who_calls", r"who\s+calls\s+(.+?)\??$"),
    ("what_does_call", r"what\s+does\s+(.+?)\s+call\??$"),
    ("can_reach", r"can\s+(.+?)\s+reach\s+(.+?)\??$"),
    ("trace", r"trace\s+(.+?)\s*->\s*(.+?)$"),
)
CAPABILITIES = ("call_chain", "impact_analysis", "route_trace", "where_is_symbol")
#: Texts of the answers.
TEXTS = {
    "no symbol": "Symbol '{0}' was not found.",
    "symbol": "{0} is a {1}.",
    "chain": "Execution chain for '{0}' contains {1} nodes.\n\nCall Chain:\n{2}",
    "no route": "Route '{0}' was not found.",
    "route": "Route '{0}' resolved to an execution path of {1} nodes.\n\nExecution Path:\n{2}",
    "no impact": "No impact information found for '{0}'.",
    "impact": "{0} affects {1} related symbols.",
    "empty": "Empty query.",
    "unknown": "Unable to determine the repository question being asked.",
}


def parsed(query: Column) -> Column:
    """struct<intent_type, first, second> of a column of questions by the
    grammar of :func:`parse`; second is '' where a form has one part."""
    text = F.regexp_replace(query, r"^\s+|\s+$", "")
    part = lambda p, g: F.regexp_replace(F.regexp_extract(text, p, g), r"^\s+|\s+$", "")
    value = lambda n, a, b: F.struct(F.lit(n).alias("intent_type"), a.alias("first"), b.alias("second"))
    out = F.when(F.lit(False), value("unknown", F.lit(""), F.lit("")))
    for name, pattern in GRAMMAR:
        p = f"(?i)^{pattern}"
        out = out.when(text.rlike(p), value(name, part(p, 1), part(p, 2) if re.compile(pattern).groups > 1 else F.lit("")))
    return out.otherwise(value("unknown", F.lit(""), F.lit("")))


@dataclass
class Answer:
    """What a question gives; lists are those of one symbol."""

    capability: str
    confidence: float
    answer: str
    evidence: list[str] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)


def _dashes(names: list[str]) -> str:
    return "\n".join(f"- {x}" for x in names)


def clean_symbol(query: str, noise: tuple[str, ...]) -> str:
    out = query
    for word in noise:
        out = re.sub(rf"\b{re.escape(word)}\b", "", out, flags=re.IGNORECASE)
    return out.replace("?", "").strip()


def route(query: str) -> tuple[str, str]:
    """(capability, argument) of one question; the argument of a route trace is
    METHOD and path."""
    query = query.strip()
    if not query:
        return "none", ""
    low = query.lower()
    m = re.search(ROUTE, query, re.IGNORECASE)
    if m and any(w in low for w in TRACE_WORDS):
        return "route_trace", f"{m[1]} {m[2]}"
    for capability, phrases, noise in RULES:
        if any(p in low for p in phrases):
            return capability, clean_symbol(query, noise)
    return "unknown", ""


def routed(query: Column) -> Column:
    """struct<capability, argument> of a column of questions: the rules of
    :func:`route` as one expression."""
    low, text = F.lower(F.trim(query)), F.trim(query)
    ascii_route = r"(?i)\b(GET|POST|PUT|PATCH|DELETE)\s+(/[/a-zA-Z0-9_\-]*)"
    has = lambda words: F.greatest(*[F.contains(low, F.lit(w)) for w in words])
    value = lambda c, a: F.struct(F.lit(c).alias("capability"), a.alias("argument"))
    out = F.when(F.coalesce(text, F.lit("")) == "", value("none", F.lit("")))
    out = out.when(text.rlike(ascii_route) & has(TRACE_WORDS), value("route_trace", F.concat_ws(" ", F.regexp_extract(text, ascii_route, 1), F.regexp_extract(text, ascii_route, 2))))
    for capability, phrases, noise in RULES:
        symbol = text
        for w in noise:
            symbol = F.regexp_replace(symbol, rf"(?i)\b{w}\b", "")
        out = out.when(has(phrases), value(capability, F.trim(F.replace(symbol, F.lit("?"), F.lit("")))))
    return out.otherwise(value("unknown", F.lit("")))


def parse(query: str) -> dict:
    """The question grammar: intent_type with symbol, or start and target."""
    query = query.strip()
    for name, pattern in GRAMMAR:
        m = re.match(pattern, query, re.IGNORECASE)
        if m:
            parts = [g.strip() for g in m.groups()]
            return {"intent_type": name, "raw_query": query} | ({"symbol": parts[0]} if len(parts) == 1 else {"start": parts[0], "target": parts[1]})
    return {"intent_type": "unknown", "raw_query": query}


class Repository:
    """A graph to ask: nodes(id, type, name, ord), edges(source, target, relationship).

    Lists on the driver are those of one symbol's neighbourhood."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = nodes, edges
        self.plugins = {name: getattr(self, name) for name in CAPABILITIES}

    def capabilities(self) -> list[str]:
        """The names of what can be asked, sorted."""
        return sorted(self.plugins)

    def register(self, name: str, answer: Callable[..., Answer]) -> None:
        """Takes in or replaces a capability: its argument gives an answer."""
        self.plugins[name] = answer

    def _names(self, rows: DataFrame, ids: str = "id") -> list[str]:
        got = rows.join(self.nodes.select("id", "name"), ids).select("depth", "name").distinct() if "depth" in rows.columns else rows.select("name").distinct()
        return [r["name"] for r in got.orderBy(*got.columns).collect()]

    def _around(self, name: str, incoming: bool, rel=(graph.CALLS,)) -> list[str]:
        start = graph.find_node(self.nodes, name).select(F.col("id").alias("from_id"))
        rows = graph.neighbours(self.nodes, self.edges, list(rel) if rel else None, incoming=incoming).join(start, "from_id", "left_semi")
        return self._names(rows)

    def where_is_symbol(self, name: str) -> Answer:
        node = graph.find_node(self.nodes, name).take(1)
        if not node:
            return Answer("where_is_symbol", 0.0, TEXTS["no symbol"].format(name))
        callers, callees = self._around(name, True), self._around(name, False)
        text = TEXTS["symbol"].format(name, node[0]["type"].lower())
        text += "".join(f"\n\n{title}:\n" + "\n".join(f"- {x}" for x in xs) for title, xs in (("Called by", callers), ("Calls", callees)) if xs)
        return Answer("where_is_symbol", 0.95, text, sorted({name, *callers, *callees}), {"node_id": node[0]["id"], "node_type": node[0]["type"]})

    def call_chain(self, name: str, depth: int = 10) -> Answer:
        start = graph.find_node(self.nodes, name).select(F.col("id").alias("start"))
        if start.isEmpty():
            return Answer("call_chain", 0.0, TEXTS["no symbol"].format(name), [name])
        path = [name, *self._names(graph.reach(self.edges, start, depth, [graph.CALLS]))]
        text = TEXTS["chain"].format(name, len(path), _dashes(path))
        return Answer("call_chain", 0.95, text, sorted(set(path)), {"length": len(path)})

    def route_trace(self, method: str, path: str) -> Answer:
        name = f"{method.upper()}:{path}"
        found = self._names(graph.route_trace(self.nodes, self.edges, method.upper(), path))
        if not found:
            return Answer("route_trace", 0.0, TEXTS["no route"].format(name), [name])
        text = TEXTS["route"].format(name, len(found), _dashes(found))
        return Answer("route_trace", 0.95, text, sorted({name, *found}), {"route": name, "path_length": len(found)})

    def impact_analysis(self, name: str) -> Answer:
        parts: dict[str, list[str]] = {"callers": [], "callees": [], "dependencies": [], "dependents": []}
        for r in graph.impact(self.nodes, self.edges, name).distinct().orderBy("section", "name").collect():
            parts[r["section"]].append(r["name"])
        if not any(parts.values()):
            return Answer("impact_analysis", 0.0, TEXTS["no impact"].format(name), [name])
        risk = len(parts["dependents"]) + len(parts["callers"]) + len(parts["callees"])
        text = TEXTS["impact"].format(name, risk)
        if parts["dependents"]:
            text += "\n\nDependents:\n" + _dashes(parts["dependents"])
        return Answer("impact_analysis", 0.90, text, sorted({name, *parts["callers"], *parts["callees"]}), {"risk_score": risk, "dependents": parts["dependents"]})

    def ask(self, query: str) -> Answer:
        """Routes one question and answers it; search, explain, trace and
        impact are the same call."""
        capability, argument = route(query)
        if capability == "none":
            return Answer("none", 0.0, TEXTS["empty"])
        if capability == "unknown":
            return Answer("unknown", 0.0, TEXTS["unknown"])
        answer = self.plugins[capability]
        return answer(*argument.split(" ", 1)) if capability == "route_trace" else answer(argument)

    search = explain = trace = impact = ask

    def execute(self, intent: dict):
        """The question grammar over the call edges: a list of names, a path,
        a truth value, or None for an unknown intent."""
        calls = self.edges.filter(F.col("relationship") == graph.CALLS)
        kind = intent["intent_type"]
        if kind in ("who_calls", "what_does_call"):
            a, b = ("target", "source") if kind == "who_calls" else ("source", "target")
            return [r[0] for r in calls.filter(F.col(a) == intent["symbol"]).select(b).distinct().orderBy(b).collect()]
        if kind == "can_reach":
            return graph.has_path(calls, intent["start"], intent["target"])
        return graph.shortest_path(calls, intent["start"], intent["target"]) if kind == "trace" else None
