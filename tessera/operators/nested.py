"""Deeply nested JSON records into related flat tables (structural variants).

Every JSON value is classified bottom-up by a tree automaton: the class of an
object follows from its known fields and the classes of their values. Then the
tree is walked from the root: the class of an object and the slot in which it
hangs route it to one subtype. Each subtype has a table of its own with typed
columns (:func:`subtype_tables`); all keep the supertype keys (record_id,
node_id, parent_id), so each row still points to its parent and its record.

The automaton's alphabet is fixed: known fields, and for all others only the
classes of their values. So maps keyed by data (paths, names) are one state,
and the number of states doesn't grow with the records. Nothing recurses: depth
has no limit.

Defined results for odd input:

* null, empty or blank documents give no rows;
* text that is not JSON gives one row of subtype ``unparsed``;
* a document encoded twice (a JSON string holding JSON) is read as the inner;
* a single element in place of a list counts as a list of one, a map of objects
  as the list of its values, named by their keys; nulls in lists are no
  children; strings and numbers in a slot are children of that name (arguments:
  of that value); unknown fields stay in ``extra`` as JSON;
* numbers written as strings are numbers; what is no number becomes null;
* repeated rows give equal rows again: ``child_rows`` keeps one of each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.session import stage

#: Slots of a parent under which children of a subtype hang (fixed values).
SLOTS = {
    "classes": "class",
    "functions": "function",
    "methods": "method",
    "routes": "route",
    "imports": "import",
    "calls": "call",
    "args": "argument",
}
CHILD_KINDS = tuple(SLOTS.values())
#: Columns of each subtype beside the common ones (fixed values).
TYPED = {
    "file": (),
    "record": (),
    "class": ("end_line", "bases"),
    "function": ("end_line", "decorators"),
    "method": ("class_name", "end_line", "decorators"),
    "route": ("method", "path", "function_name"),
    "import": ("imported",),
    "call": ("caller",),
    "argument": ("value",),
    "unparsed": (),
}
_NAMES = {"import": "module", "call": "target", "argument": "value"}
_OWN = {
    "class": {"name", "line", "end_line", "bases"},
    "function": {"name", "line", "end_line", "decorators"},
    "method": {"name", "line", "end_line", "decorators", "class_name"},
    "route": {"path", "method", "function_name", "line"},
    "import": {"module", "imported", "line"},
    "call": {"target", "line", "caller"},
    "argument": {"name", "value"},
    "file": {"file_path"},
}
FIELDS = frozenset().union(*_OWN.values(), SLOTS, ("files",))
_STRINGS = ("record_id", "node_id", "parent_id", "subtype", "variant", "file_path", "parent_name", "name")
_LATER = ("class_name", "method", "path", "function_name", "imported", "caller", "value", "extra")
SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in _STRINGS]
    + [T.StructField(n, T.LongType()) for n in ("line", "end_line")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("bases", "decorators")]
    + [T.StructField(n, T.StringType()) for n in _LATER]
)
_ARROW = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.list_(pa.string()) if isinstance(f.dataType, T.ArrayType) else pa.string()) for f in SCHEMA])
#: Columns that every subtype has.
COMMON = ("record_id", "node_id", "parent_id", "variant", "file_path", "parent_name", "name", "line")


class TreeAutomaton:
    """Bottom-up deterministic automaton over JSON trees.

    A transition goes from the known fields of an object with the classes of
    their values, and the set of the other values' classes, to a state; a list
    goes by the set of its elements' classes. ``names`` are the states' classes,
    ``variants`` what they look like. Transitions are built as they turn up;
    their number is bounded by the fixed alphabet."""

    def __init__(self) -> None:
        self.transitions: dict[tuple, int] = {}
        self.names: list[str] = []
        self.variants: list[str] = []

    def _at(self, key: tuple) -> int:
        found = self.transitions.get(key)
        if found is None:
            found = self.transitions[key] = len(self.names)
            kind, known, others = key
            self.names.append(self._classify(dict(known), others) if kind == "object" else kind)
            inner = [f"{k}:{c}" for k, c in known] + [f"*:{c}" for c in others]
            self.variants.append("{" + ",".join(inner) + "}" if kind == "object" else "[" + ",".join(inner) + "]" if kind == "list" else kind)
        return found

    def states(self, value) -> dict[int, int]:
        """id -> state of all objects and lists in ``value``: those below first."""
        order, todo = [], [value]
        while todo:
            v = todo.pop()
            if isinstance(v, (dict, list)):
                order.append(v)
                todo += v.values() if isinstance(v, dict) else v
        out: dict[int, int] = {}
        kind = lambda v: self.names[out[id(v)]] if isinstance(v, (dict, list)) else "null" if v is None else type(v).__name__
        for v in reversed(order):
            if isinstance(v, dict):
                known = tuple(sorted((k, kind(x)) for k, x in v.items() if k in FIELDS))
                key = ("object", known, tuple(sorted({kind(x) for k, x in v.items() if k not in FIELDS})))
            else:
                key = ("list", (), tuple(sorted({kind(x) for x in v})))
            out[id(v)] = self._at(key)
        return out

    @staticmethod
    def _classify(known: dict[str, str], others: tuple[str, ...]) -> str:
        """The finest class that the fields prove."""
        if "target" in known:
            return "call"
        if "module" in known:
            return "import"
        if "path" in known and "method" in known:
            return "route"
        if "name" in known and "value" in known:
            return "argument"
        if "class_name" in known:
            return "method"
        if "name" in known and ("bases" in known or "methods" in known):
            return "class"
        if "name" in known:
            return "named"
        if "file_path" in known or known.keys() & SLOTS.keys():
            return "file"
        if others and not known and set(others) <= OBJECTS:
            return "map"
        return "object"


#: Classes of objects; an object of nothing but these under unknown keys is a map.
OBJECTS = frozenset(("call", "import", "route", "argument", "method", "class", "named", "file", "object"))


def _number(value) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        return int(value)
    except (TypeError, ValueError, OverflowError):
        return None


def _dumps(value) -> str:
    """JSON of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        pass
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Raw):
            out.append(v)
        elif isinstance(v, (dict, list)) and v:
            parts: list = []
            for i, x in enumerate(v.items() if isinstance(v, dict) else v):
                parts.append(_Raw("," if i else "{" if isinstance(v, dict) else "["))
                parts += [_Raw(json.dumps(x[0], ensure_ascii=False) + ":"), x[1]] if isinstance(v, dict) else [x]
            todo.append(_Raw("}" if isinstance(v, dict) else "]"))
            todo += reversed(parts)
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


class _Raw(str):
    """Text that stands in JSON as it is."""


_ATOM = re.compile(r"[ \t\n\r]*(?:([\[\]{},:])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)|(\"))")
_END = re.compile(r"[ \t\n\r]*")


def _deep(text: str):
    """:func:`json.loads` for documents that are too deep for it."""
    stack: list[tuple] = []  # containers with the key that waits for its value
    at, want, key, value = 0, "value", None, None
    while True:
        m = _ATOM.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        sign = m[1]
        if want in ("colon", "more"):
            if want == "colon" and sign == ":":
                want = "value"
            elif want == "more" and sign == ",":
                want = "key" if isinstance(stack[-1], dict) else "value"
            elif want == "more" and sign == ("}" if isinstance(stack[-1], dict) else "]"):
                value = stack.pop()
                if not stack:
                    break
                key = stack.pop()
                (stack[-1].__setitem__(key, value) if isinstance(stack[-1], dict) else stack[-1].append(value))
            else:
                raise ValueError(f"no JSON at {at}")
            continue
        if want in ("key", "first key"):
            if sign == "}" and want == "first key":
                want, at = "more", m.start(1)
            elif m[3]:
                key, at = json.decoder.scanstring(text, at)
                want = "colon"
            else:
                raise ValueError(f"no JSON at {at}")
            continue
        if sign == "]" and want == "first value":
            want, at = "more", m.start(1)
            continue
        if sign in ("{", "["):
            new: dict | list = {} if sign == "{" else []
            stack += [key, new] if stack else [new]
            want = "first key" if sign == "{" else "first value"
            continue
        if sign:
            raise ValueError(f"no JSON at {at}")
        if m[3]:
            value, at = json.decoder.scanstring(text, at)
        else:
            value = json.loads(m[2])
        if not stack:
            break
        (stack[-1].__setitem__(key, value) if isinstance(stack[-1], dict) else stack[-1].append(value))
        want = "more"
    if _END.match(text, at).end() != len(text):
        raise ValueError(f"more than one value at {at}")
    return value


def _loads(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else _dumps(value)


def _texts(value) -> list[str] | None:
    """A field of names as an array; a lone one is an array of one."""
    return None if value is None else [None if v is None else _text(v) for v in (value if isinstance(value, list) else [value])]


def parse_document(text: str):
    """The JSON value, decoded again while it is a string; None if blank."""
    if text is None or not text.strip():
        return None
    value = _loads(text)
    for _ in range(3):
        if not isinstance(value, str) or not value.strip():
            break
        value = _loads(value)
    return value


class _Flattener:
    """One record's rows. ``todo`` holds what is still to be routed."""

    def __init__(self, automaton: TreeAutomaton, record_id: str, record_name: str, value) -> None:
        self.automaton, self.record_id, self.record_name, self.value = automaton, record_id, record_name, value
        self.states = automaton.states(value)
        self.rows: list[tuple] = []
        self.todo: list[tuple] = []
        self.made: list[dict] = []

    def kind(self, obj) -> str:
        return self.automaton.names[self.states[id(obj)]]

    def emit(self, subtype, node, parent, obj, file_path, parent_name, name, line, caller=None) -> None:
        own = _OWN.get(subtype, set())
        extra = {k: v for k, v in obj.items() if k not in own and k not in SLOTS}
        if subtype == "record":  # what hangs below stands in rows of its own
            extra = {k: v for k, v in extra.items() if k not in ("file_path", "line") and not isinstance(v, (dict, list))}
        state = self.states.get(id(obj))
        typed = TYPED[subtype]
        pick = lambda c: _text(obj[c]) if c in typed and obj.get(c) is not None else None
        self.rows.append(
            (
                self.record_id,
                node,
                parent,
                subtype,
                subtype + (self.automaton.variants[state] if state is not None else "{}"),
                file_path,
                parent_name,
                name,
                line,
                _number(obj.get("end_line")),
                _texts(obj.get("bases")) if "bases" in typed else None,
                _texts(obj.get("decorators")) if "decorators" in typed else None,
                pick("class_name"),
                pick("method"),
                pick("path"),
                pick("function_name"),
                pick("imported"),
                caller if subtype == "call" else None,
                pick("value"),
                _dumps(extra) if extra else None,
            )
        )

    def elements(self, value, slot: str, node: str) -> list[tuple[dict, str]]:
        """(object, node) of a slot's elements: lists in lists are opened, maps
        give their values, what is no object becomes one of that name."""
        name, out, todo = _NAMES.get(SLOTS[slot], "path" if slot == "routes" else "name"), [], [(value, f"{node}/{slot}[0]", f"{node}/{slot}")]
        while todo:
            v, at, above = todo.pop()
            if isinstance(v, list):
                todo += reversed([(x, f"{above}[{i}]", f"{above}[{i}]") for i, x in enumerate(v)])
            elif isinstance(v, dict) and self.kind(v) == "map":
                todo += reversed([(x if name in x else self.like(x, {name: k} | x), f"{above}[{k}]", f"{above}[{k}]") for k, x in v.items()])
            elif isinstance(v, dict):
                out.append((v, at))
            elif v is not None:
                out.append(({name: v}, at))
        return out

    def children(self, obj, slot, node, file_path, owner, class_name=None, parent=None) -> None:
        """``parent`` is the row above, where that isn't ``node`` itself."""
        if obj.get(slot) is not None:
            self.todo += [("child", SLOTS[slot], child, at, parent or node, file_path, owner, class_name) for child, at in self.elements(obj[slot], slot, node)]

    def child(self, subtype, obj, node, parent, file_path, owner, class_name) -> None:
        line = _number(obj.get("line"))
        if subtype == "class":
            name = _text(obj.get("name"))
            self.emit(subtype, node, parent, obj, file_path, file_path, name, line)
            self.children(obj, "methods", node, file_path, name, name)
        elif subtype in ("function", "method"):
            name = _text(obj.get("name"))
            above = file_path if subtype == "function" else _text(class_name if class_name is not None else obj.get("class_name"))
            if subtype == "method" and obj.get("class_name") is None:
                obj = self.like(obj, {**obj, "class_name": above or None})
            self.emit(subtype, node, parent, obj, file_path, above, name, line)
            self.children(obj, "calls", node, file_path, name if subtype == "function" else f"{above}.{name}")
        elif subtype == "route":
            self.emit(subtype, node, parent, obj, file_path, file_path, f"{_text(obj.get('method'))} {_text(obj.get('path'))}", line)
        elif subtype == "import":
            self.emit(subtype, node, parent, obj, file_path, file_path, _text(obj.get("module")), line)
        elif subtype == "call":
            target = _text(obj.get("target"))
            if owner == file_path:  # a call of the file's own list may name its caller
                owner = _text(obj.get("caller"))
            self.emit(subtype, node, parent, obj, file_path, owner or file_path, target, line, owner or None)
            if obj.get("args") is not None:
                for arg, at in self.elements(obj["args"], "args", node):
                    self.emit("argument", at, node, arg, file_path, target, _text(arg.get("name")), line)

    def like(self, old: dict, new: dict) -> dict:
        """``new`` in the state of ``old``; it is kept while the record is."""
        if id(old) in self.states:
            self.states[id(new)] = self.states[id(old)]
            self.made.append(new)  # or its id could come back
        return new

    def file(self, obj, node, parent, path) -> None:
        self.emit("file", node, parent, obj, path, self.record_name, path, None)
        for slot in ("classes", "functions", "methods", "routes", "imports", "calls"):
            self.children(obj, slot, node, path, path)

    def walk(self, value, node, parent) -> None:
        """Routes by the automaton's class: file maps, file lists, bodies. What is
        walked through is no row, so the parent stays."""
        if isinstance(value, list):
            self.todo += [("walk", v, f"{node}[{i}]", parent) for i, v in enumerate(value) if isinstance(v, (dict, list))]
            return
        kind = self.kind(value)
        if kind == "file":
            self.file(value, node, parent, _text(value.get("file_path")))
        elif kind == "call":
            self.todo.append(("child", "call", value, node, parent, "", self.record_name, None))
        else:
            for key, v in value.items():
                if key == "files" and isinstance(v, dict) and self.kind(v) in ("map", "object"):
                    for path, obj in v.items():
                        if isinstance(obj, dict):
                            self.todo.append(("file", obj, f"{node}/files[{path}]", parent, _text(obj.get("file_path")) or path))
                elif isinstance(v, (dict, list)):
                    self.todo.append(("walk", v, f"{node}/{key}", parent))

    def inside(self, obj, node, path) -> None:
        self.children(obj, "calls", node, path, self.record_name, parent="$")
        self.todo += [("inside", v, f"{node}/{key}", path) for key, v in obj.items() if isinstance(v, dict) and key not in SLOTS]

    def owned(self) -> None:
        """A record that is itself the caller: its calls, at any depth of
        wrapping objects, hang under the record's name."""
        if isinstance(self.value, dict):
            path = _text(self.value.get("file_path"))
            self.emit("record", "$", None, self.value, path, "", self.record_name, _number(self.value.get("line")))
            self.todo.append(("inside", self.value, "$", path))

    def run(self, owned: bool) -> Iterator[list[tuple]]:
        """The rows, some thousands at a time."""
        if owned:
            self.owned()
        elif isinstance(self.value, (dict, list)):
            self.todo.append(("walk", self.value, "$", None))
        while self.todo:
            step, *args = self.todo.pop()
            getattr(self, step)(*args)
            if len(self.rows) >= 5000:
                yield self.rows
                self.rows = []
        yield self.rows


def flatten_json(df: DataFrame, key: str, json_col: str, owner_col: str | None = None) -> DataFrame:
    """All objects of ``json_col`` as rows of :data:`SCHEMA`.

    ``owner_col`` set: the record itself is the caller of its calls, by that
    column's name. Unset: the document holds files with symbols.
    """
    source = df.select(F.col(key).cast("string").alias("k"), F.col(json_col).alias("j"), (F.col(owner_col) if owner_col else F.lit("")).alias("n"))
    owned = owner_col is not None
    unparsed = lambda k, j: [(k, "$", None, "unparsed", "unparsed{}", *[None] * (len(_ARROW) - 6), j)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TreeAutomaton()
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
        for batch in batches:
            rows: list[tuple] = []
            for k, j, n in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    value = parse_document(j)
                except ValueError:
                    rows += unparsed(k, j)
                    continue
                if value is None:
                    continue
                for part in _Flattener(automaton, k, n or "", value).run(owned):
                    rows += part
                    if len(rows) >= 20_000:
                        yield out(rows)
                        rows = []
            if rows:
                yield out(rows)

    return source.mapInArrow(run, SCHEMA)


def flatten_calls(df: DataFrame, key: str, path: str, calls: str) -> DataFrame:
    """The files and calls of an array<struct<caller,target,line>> column as
    rows of :data:`SCHEMA`, by the same automaton as the documents'."""
    record = F.struct(F.col(path).alias("file_path"), F.col(calls).alias("calls"))
    return flatten_json(df.select(key, F.to_json(record, {"ignoreNullFields": "false"}).alias("j")), key, "j")


def subtype_tables(flat: DataFrame) -> dict[str, DataFrame]:
    """One table a subtype: the common columns and its own, typed. Rows are
    written once, by subtype, so that a table reads its own part only."""
    keys = [c for c in flat.columns if c not in SCHEMA.names]
    staged = stage(flat, "nested", by=["subtype"])
    return {s: staged.filter(F.col("subtype") == s).select(*keys, *COMMON, *own, "extra") for s, own in TYPED.items()}


def all_nested(artifacts: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of the three nested sources, with their origin."""
    parts = (
        (flatten_json(artifacts, "artifact_id", "symbols"), "repository_artifact"),
        (flatten_calls(files, "file_id", "file_path", "calls"), "file_symbols"),
        (flatten_json(nodes, "node_key", "metadata", "name"), "graph_node"),
    )
    out = None
    for df, origin in parts:
        df = df.select(F.lit(origin).alias("origin"), "*")
        out = df if out is None else out.unionByName(df)
    return out


def child_rows(flat: DataFrame, origin: str) -> DataFrame:
    """Children of the seven kinds in the common form."""
    return flat.filter(F.col("subtype").isin(*CHILD_KINDS)).select(
        F.lit(origin).alias("origin"),
        "record_id",
        "file_path",
        F.col("subtype").alias("child_kind"),
        "parent_name",
        F.col("name").alias("child_name"),
        F.coalesce("line", F.lit(0)).cast("long").alias("line_no"),
    )


def call_rows(df: DataFrame, key: str, path: str, calls: str, origin: str) -> DataFrame:
    """Calls of an array<struct<caller,target,line>> column in the common form;
    all JVM-side. Null arrays and null elements give no rows."""
    item = df.select(F.col(key).cast("string").alias("record_id"), F.coalesce(F.col(path), F.lit("")).alias("file_path"), F.explode(calls).alias("c")).filter("c is not null")
    return item.select(
        F.lit(origin).alias("origin"),
        "record_id",
        "file_path",
        F.lit("call").alias("child_kind"),
        F.coalesce(F.nullif(F.col("c.caller"), F.lit("")), F.col("file_path")).alias("parent_name"),
        F.coalesce(F.col("c.target"), F.lit("")).alias("child_name"),
        F.coalesce(F.col("c.line"), F.lit(0)).cast("long").alias("line_no"),
    )


def nested_children(artifacts: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct children of the three nested sources."""
    return (
        child_rows(flatten_json(artifacts, "artifact_id", "symbols"), "repository_artifact")
        .unionByName(child_rows(flatten_calls(files, "file_id", "file_path", "calls"), "file_symbols"))
        .unionByName(child_rows(flatten_json(nodes, "node_key", "metadata", "name"), "graph_node"))
        .distinct()
    )
