"""Relevance of files, nodes and texts to an issue; top-k per list.

Issues are given as their tokens (few, known on the driver), so scores are
higher-order expressions inside one scan; a top-k is TakeOrderedAndProject.
Ties go by name; null names and texts score nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

# Entry-point file names.
ENTRY_POINTS = (
    "main.py", "app.py", "server.py", "index.py", "main.js", "index.js", "app.js", "server.js", "main.ts", "index.ts", "app.ts", "main.dart", "app.dart", "main.go", "main.rb", "main.rs",
)


def issue_tokens(issue: str) -> list[str]:
    return sorted({t.lower() for t in re.findall(r"[a-zA-Z_][a-zA-Z0-9_]*", issue)})


def _sum(items: list[Column]) -> Column:
    total = F.lit(0.0)
    for i in items:
        total = total + i
    return total


def _contains(text: Column, token: str) -> Column:
    return F.coalesce(F.contains(text, F.lit(token)), F.lit(False))


def node_relevance(nodes: DataFrame, issue: str, metadata: str | None = None) -> DataFrame:
    """Nodes with a score above 0: the whole issue equal to the name 40 or
    within it 20; each token of three characters by node type; each token in
    the metadata 3."""
    tokens, query = issue_tokens(issue), issue.strip().lower()
    name = F.regexp_replace(F.lower("name"), "[_-]", " ")
    kind = F.lower("type")
    weight = F.when(kind == "file", 10.0).when(kind.isin("class", "function", "method", "symbol"), 20.0).when(kind == "route", 50.0).otherwise(5.0)
    parts = [F.when(name == query, 40.0).when(_contains(name, query), 20.0).otherwise(0.0)] if query else []
    parts += [F.when(_contains(name, t), weight).otherwise(0.0) for t in tokens if len(t) >= 3]
    if metadata:
        low = F.lower(metadata)
        parts += [F.when(_contains(low, t), 3.0).otherwise(0.0) for t in tokens]
    return nodes.withColumn("score", _sum(parts)).filter("score > 0")


def text_score(df: DataFrame, text: str, query: str, weight: float = 5.0) -> DataFrame:
    """Rows with occurrences of the query's tokens, ``weight`` for each."""
    low = F.lower(text)
    hits = [(F.length(low) - F.length(F.replace(low, F.lit(t)))) / F.lit(float(len(t))) for t in issue_tokens(query)]
    return df.withColumn("score", F.coalesce(_sum(hits), F.lit(0.0)) * weight).filter("score > 0")


def file_ranking(files: DataFrame, symbols: DataFrame, routes: DataFrame, imports: DataFrame, issue: str, limit: int = 20) -> DataFrame:
    """(file_path, score, reasons) of the best files: tokens in file names 10
    and in symbol names 20, routes named in the issue 50, and 5 for each file
    imported by one of these."""
    tokens = [t for t in issue_tokens(issue) if len(t) >= 3]
    paths = re.findall(r"/[a-zA-Z0-9_\-/]+", issue)
    base = F.lower(F.regexp_extract("file_path", r"([^/]+)$", 1))
    hit = lambda df, text, points, label: df.select("file_path", F.explode(F.filter(F.array(*[F.when(_contains(text, t), F.lit(t)) for t in tokens]), lambda x: x.isNotNull())).alias("t")).select("file_path", F.lit(float(points)).alias("score"), F.concat(F.lit(label), F.lit("'"), F.col("t"), F.lit("'")).alias("reason"))
    if not tokens:
        tokens = ["\x00"]
    signals = hit(files.select("file_path"), base, 10, "filename matches ").unionByName(hit(symbols, F.regexp_replace(F.lower("name"), "_", " "), 20, "symbol matches "))
    signals = signals.unionByName(routes.filter(F.col("path").isin(paths or ["\x00"])).select("file_path", F.lit(50.0).alias("score"), F.concat(F.lit("route match '"), "path", F.lit("'")).alias("reason")))
    scored = signals.select("file_path").distinct()
    deps = imports.join(scored, imports["source"] == scored["file_path"], "left_semi").select(F.col("target").alias("file_path"), F.lit(5.0).alias("score"), F.concat(F.lit("imported by "), "source").alias("reason"))
    return signals.unionByName(deps).groupBy("file_path").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons")).orderBy(F.desc("score"), "file_path").limit(limit)


def composite_file_score(files: DataFrame, keywords: list[str], now: Column, suggested: list[str] = (), limit: int = 6) -> DataFrame:
    """Top files by keywords in path (1) and content (0.5, up to 20 KB), age,
    entry-point name (2) and suggestion (5: the path within it or it within the path).
    ``files(path, content, length, modified)``; the clock is a parameter."""
    path = F.lower("path")
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    low = F.lower("content")
    age = F.unix_timestamp(now) - F.unix_timestamp("modified")
    parts = [F.when(_contains(path, k), 1.0).otherwise(0.0) for k in keywords]
    parts += [F.when((F.col("length") <= 20 * 1024) & _contains(low, k), 0.5).otherwise(0.0) for k in keywords]
    parts += [F.when(age < 3600, 3.0).when(age < 86400, 2.0).when(age < 604800, 1.0).otherwise(0.0), F.when(base.isin(*ENTRY_POINTS), 2.0).otherwise(0.0)]
    parts += [F.when(_contains(path, s.lower()) | F.contains(F.lit(s.lower()), path), 5.0).otherwise(0.0) for s in suggested]
    return files.withColumn("score", _sum(parts)).filter("score > 0").orderBy(F.desc("score"), "path").limit(limit)


def discover(files: DataFrame, keywords: list[str], limit: int = 25) -> DataFrame:
    """Files by 10 points a keyword within the path."""
    score = _sum([F.when(_contains(F.lower("path"), k.lower()), 10.0).otherwise(0.0) for k in keywords])
    return files.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "path").limit(limit)


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group. Spark's group limit keeps ``k`` rows a
    group before the shuffle, so a hot group doesn't reach one task whole."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def evidence_expansion(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Seeds (source, name, score, ord) widened by one hop around symbols:
    dependencies 0.75, callers 0.85, callees 0.80 of the seed's score. The best
    score of a name stays with its source; top ``limit`` a source."""
    at = seeds.filter("source = 'symbol'").join(nodes.select("id", "name"), "name").select("id", "score", "ord")
    named = nodes.select(F.col("id").alias("nid"), F.col("name").alias("found"))
    parts = [seeds.select("source", "name", "score", F.struct("ord", F.lit(0).alias("step"), "name").alias("o"))]
    for step, (a, b, calls, weight) in enumerate((("source", "target", False, 0.75), ("target", "source", True, 0.85), ("source", "target", True, 0.80)), 1):
        e = edges.filter((F.col("relationship") == "CALLS") if calls else F.lit(True))
        got = at.join(e.select(F.col(a).alias("id"), F.col(b).alias("nid")), "id").join(named, "nid")
        parts.append(got.select(F.lit("symbol").alias("source"), F.col("found").alias("name"), (F.col("score") * weight).alias("score"), F.struct("ord", F.lit(step).alias("step"), F.col("found").alias("name")).alias("o")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = rows.groupBy("name").agg(F.max_by(F.struct("source", "score", "o"), F.struct("score", F.struct(-F.col("o.ord"), -F.col("o.step")))).alias("v")).select("name", "v.source", "v.score", "v.o")
    return top_per_group(best, "source", [F.desc("score"), F.col("o")], limit).select("source", "rank", "name", "score")
