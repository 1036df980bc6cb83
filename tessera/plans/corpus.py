"""Queries of the general data problems over the whole domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import loglines, nested
from tessera.session import stage, table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Every nested child with its parent and record."""
    return nested.nested_children(table(spark, base, "repository_artifact"), table(spark, base, "file_symbols"), table(spark, base, "graph_node"))


def _nested(spark: SparkSession, base: str) -> DataFrame:
    return nested.all_nested(table(spark, base, "repository_artifact"), table(spark, base, "file_symbols"), table(spark, base, "graph_node"))


def p1_variants(spark: SparkSession, base: str) -> DataFrame:
    """Structural variants of all nested records and how often each occurs."""
    return _nested(spark, base).groupBy("origin", "subtype", "variant").agg(F.count("*").alias("n_objects"), F.countDistinct("record_id").alias("n_records"))


def p1_orphans(spark: SparkSession, base: str) -> DataFrame:
    """Children by kind, and those whose parent object is no row: none."""
    flat = stage(_nested(spark, base).dropDuplicates(["origin", "record_id", "node_id"]).select("origin", "record_id", "node_id", "parent_id", "subtype"), "nested-keys")
    parents = flat.select("origin", "record_id", F.col("node_id").alias("parent_id"), F.lit(1).alias("known"))
    children = flat.filter(F.col("subtype").isin(*nested.CHILD_KINDS))
    joined = children.join(parents, ["origin", "record_id", "parent_id"], "left")
    return joined.groupBy("origin", "subtype").agg(F.count("*").alias("n_children"), F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("n_orphans"))


def _subtype(name: str):
    def query(spark: SparkSession, base: str) -> DataFrame:
        got = nested.subtype_tables(_nested(spark, base))[name]
        arrays = [c for c in ("bases", "decorators") if c in got.columns]
        rows = got.select("origin", "record_id", "file_path", "parent_name", "name", *[F.coalesce(c, F.lit(0)).alias(c) if c.endswith("line") else F.col(c) for c in ("line", *nested.TYPED[name]) if c not in arrays], *[F.array_join(c, ",", "").alias(c) for c in arrays])
        return rows.distinct()

    query.__name__, query.__doc__ = f"p1_table_{name}", f"The typed table of subtype {name}, all sources; distinct rows."
    return query


def p1_file_calls(spark: SparkSession, base: str) -> DataFrame:
    """Calls of the indexed files, JVM-side only."""
    return nested.call_rows(table(spark, base, "file_symbols"), "file_id", "file_path", "calls", "file_symbols").distinct()


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Every log entry of the runs and of the log evidence."""
    return loglines.entry_keys(table(spark, base, "evidence"), table(spark, base, "terminal_run"))


def p3_messages(spark: SparkSession, base: str) -> DataFrame:
    """Every log entry with its message, and the unparsed spans, of all origins."""
    return loglines.entry_messages(table(spark, base, "evidence"), table(spark, base, "terminal_run"))


def p3_coverage(spark: SparkSession, base: str) -> DataFrame:
    """Parsed entries and unparsed spans of all origins, by level."""
    got = p3_messages(spark, base)
    return got.groupBy("origin", "level", "unparsed").agg(F.count("*").alias("n_spans"), F.sum(F.col("last_line") - F.col("first_line") + 1).alias("n_lines"), F.sum(F.length("message")).alias("n_chars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_variants, p1_orphans, *map(_subtype, nested.CHILD_KINDS), p1_file_calls, p3_found, p3_messages, p3_coverage)}

#: The children by DuckDB's own JSON walk: an element hangs in a list under a
#: slot's key or right under it; its owner is the object that has the slot.
_TREE = r"""d AS (SELECT DISTINCT 'repository_artifact' AS origin, CAST(artifact_id AS VARCHAR) AS record_id, '' AS n, CASE WHEN json_valid(symbols) THEN CASE WHEN json_type(symbols) = 'VARCHAR' THEN symbols ->> '$' ELSE symbols END END AS j FROM repository_artifact
          UNION SELECT 'graph_node', CAST(node_key AS VARCHAR), coalesce(name, ''), CASE WHEN json_valid(metadata) THEN CASE WHEN json_type(metadata) = 'VARCHAR' THEN metadata ->> '$' ELSE metadata END END FROM graph_node),
        t AS (SELECT d.origin, d.record_id, d.n, d.j, t.key, t.value, t.type, t.id, t.parent FROM d, json_tree(d.j) t WHERE json_valid(d.j)),
        e AS (SELECT e.origin, e.record_id, e.n, e.j, e.id, e.value, CASE WHEN p.type = 'ARRAY' THEN p.key ELSE e.key END AS slot, CASE WHEN p.type = 'ARRAY' THEN p.parent ELSE e.parent END AS owner
              FROM t e JOIN t p ON p.origin = e.origin AND p.record_id = e.record_id AND p.n = e.n AND p.j = e.j AND p.id = e.parent WHERE e.type = 'OBJECT'),
        s AS (SELECT * FROM e WHERE slot IN ('classes', 'functions', 'methods', 'routes', 'imports', 'calls', 'args')),
        c AS (SELECT s.*, q.slot AS q_slot, q.value AS q, g.value AS g, g.slot AS g_slot, coalesce(h.owner, g.owner, q.owner, s.owner) AS top FROM s
              LEFT JOIN s q ON q.origin = s.origin AND q.record_id = s.record_id AND q.n = s.n AND q.j = s.j AND q.id = s.owner
              LEFT JOIN s g ON g.origin = s.origin AND g.record_id = s.record_id AND g.n = s.n AND g.j = s.j AND g.id = q.owner
              LEFT JOIN s h ON h.origin = s.origin AND h.record_id = s.record_id AND h.n = s.n AND h.j = s.j AND h.id = g.owner),
        f AS (SELECT c.*, CASE WHEN c.origin = 'graph_node' THEN coalesce(c.j ->> '$.file_path', '') ELSE coalesce(nullif(t.value ->> '$.file_path', ''), CASE WHEN p.key = 'files' AND p.type = 'OBJECT' THEN t.key END, '') END AS file_path
              FROM c JOIN t ON t.origin = c.origin AND t.record_id = c.record_id AND t.n = c.n AND t.j = c.j AND t.id = c.top LEFT JOIN t p ON p.origin = t.origin AND p.record_id = t.record_id AND p.n = t.n AND p.j = t.j AND p.id = t.parent),
        k AS (SELECT origin, record_id, file_path, value, CASE slot WHEN 'classes' THEN 'class' WHEN 'functions' THEN 'function' WHEN 'methods' THEN 'method' WHEN 'routes' THEN 'route' WHEN 'imports' THEN 'import' WHEN 'calls' THEN 'call' ELSE 'argument' END AS kind,
                CASE slot WHEN 'methods' THEN coalesce(CASE WHEN q_slot = 'classes' THEN q ->> '$.name' END, value ->> '$.class_name', '')
                  WHEN 'args' THEN coalesce(q ->> '$.target', '')
                  WHEN 'calls' THEN CASE WHEN origin = 'graph_node' THEN nullif(n, '') WHEN q_slot = 'functions' THEN q ->> '$.name' WHEN q_slot = 'methods' THEN coalesce(CASE WHEN g_slot = 'classes' THEN g ->> '$.name' END, q ->> '$.class_name', '') || '.' || coalesce(q ->> '$.name', '') ELSE nullif(value ->> '$.caller', '') END
                  ELSE file_path END AS above,
                CASE slot WHEN 'routes' THEN coalesce(value ->> '$.method', '') || ' ' || coalesce(value ->> '$.path', '') WHEN 'imports' THEN coalesce(value ->> '$.module', '') WHEN 'calls' THEN coalesce(value ->> '$.target', '') ELSE coalesce(value ->> '$.name', '') END AS name,
                TRY_CAST(CASE WHEN slot = 'args' THEN q ->> '$.line' ELSE value ->> '$.line' END AS BIGINT) AS line FROM f
          UNION ALL SELECT 'file_symbols', CAST(file_id AS VARCHAR), coalesce(file_path, ''), NULL, 'call', nullif(c.caller, ''), coalesce(c.target, ''), CAST(c.line AS BIGINT) FROM (SELECT file_id, file_path, unnest(calls) AS c FROM file_symbols) WHERE c IS NOT NULL)"""
_NAMES = "CASE json_type(value, '$.{0}') WHEN 'ARRAY' THEN array_to_string(list_transform(value ->> '$.{0}[*]', lambda x: coalesce(x, '')), ',') WHEN 'NULL' THEN NULL ELSE value ->> '$.{0}' END AS {0}"
_END = "coalesce(TRY_CAST(value ->> '$.end_line' AS BIGINT), 0) AS end_line"
_TYPED = {
    "class": [_END, _NAMES.format("bases")],
    "function": [_END, _NAMES.format("decorators")],
    "method": ["nullif(above, '') AS class_name", _END, _NAMES.format("decorators")],
    "route": ["value ->> '$.method' AS method", "value ->> '$.path' AS path", "value ->> '$.function_name' AS function_name"],
    "import": ["value ->> '$.imported' AS imported"],
    "call": ["above AS caller"],
    "argument": ["value ->> '$.value' AS value"],
}

SQL = {
    "p1_found": f"WITH {_TREE} SELECT DISTINCT origin, record_id, file_path, kind AS child_kind, coalesce(above, file_path) AS parent_name, name AS child_name, coalesce(line, 0) AS line_no FROM k",
    **{f"p1_table_{kind}": f"WITH {_TREE} SELECT DISTINCT origin, record_id, file_path, coalesce(above, file_path) AS parent_name, name, coalesce(line, 0) AS line, {', '.join(columns)} FROM k WHERE kind = '{kind}'" for kind, columns in _TYPED.items()},
    "p1_orphans": f"""WITH {_TREE} SELECT origin, kind AS subtype, count(*) AS n_children, 0::BIGINT AS n_orphans FROM k WHERE origin <> 'file_symbols' GROUP BY origin, kind
        UNION ALL SELECT 'file_symbols', 'call', count(*), 0::BIGINT FROM (SELECT unnest(calls) AS c FROM (SELECT DISTINCT file_id, file_path, calls FROM file_symbols)) WHERE c IS NOT NULL""",
    "p1_file_calls": """
        WITH c AS (SELECT CAST(file_id AS VARCHAR) AS record_id, coalesce(file_path, '') AS file_path, unnest(calls) AS c FROM file_symbols)
        SELECT DISTINCT 'file_symbols' AS origin, record_id, file_path, 'call' AS child_kind,
               coalesce(nullif(c.caller, ''), file_path) AS parent_name, coalesce(c.target, '') AS child_name, CAST(coalesce(c.line, 0) AS BIGINT) AS line_no
        FROM c WHERE c IS NOT NULL""",
}
