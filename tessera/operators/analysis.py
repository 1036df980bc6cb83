"""Intents, evidence plans, facts, hypotheses and root causes as column rules
and small dimension tables. Null requests are unknown; null facts are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# First rule that holds wins.
TYPES = (
    ("debugging", ("fix", "bug", "error", "broken", "not working", "issue", "sync", "failing"), 0.95),
    ("root_cause", ("why", "root cause", "cause", "reason"), 0.90),
    ("performance", ("slow", "latency", "performance", "memory", "cpu"), 0.90),
    ("security", ("security", "auth bypass", "token", "jwt", "vulnerability"), 0.90),
    ("test_failure", ("test", "failing test", "unit test", "integration test"), 0.90),
    ("architecture_review", ("architecture", "design", "review", "structure"), 0.85),
    ("feature_analysis", ("feature", "implement", "analyze", "behaviour", "behavior"), 0.80),
)
DOMAINS = (
    ("backend", ("backend", "server", "repository", "service", "railway")),
    ("frontend", ("frontend", "ui", "react", "page", "component")),
    ("mobile", ("flutter", "android", "ios", "mobile")),
    ("api", ("api", "endpoint", "route", "request", "response")),
    ("database", ("database", "postgres", "sqlite", "schema", "query")),
    ("auth", ("auth", "login", "jwt", "token", "authentication")),
    ("infrastructure", ("docker", "deployment", "infra", "kubernetes", "container")),
)
#: Mean of both confidences, rounded half to even of the binary value.
CONFIDENCE = {(0.95, True): 0.95, (0.95, False): 0.68, (0.90, True): 0.93, (0.90, False): 0.65, (0.85, True): 0.90, (0.85, False): 0.62, (0.80, True): 0.88, (0.80, False): 0.60, (0.40, True): 0.68, (0.40, False): 0.40}
PLANS = {
    ("debugging", "backend"): ("server_logs", "api_routes", "repository_code", "stack_trace"),
    ("debugging", "mobile"): ("stack_trace", "terminal_output", "project_structure"),
    ("debugging", "api"): ("api_routes", "repository_code", "server_logs", "project_structure"),
    ("test_failure", "unknown"): ("test_results", "stack_trace"),
    ("security", "auth"): ("config_file", "api_routes", "repository_code"),
}
DEFAULT_PLAN = ("repository_code", "project_structure")
PRIORITY = ("stack_trace", "server_logs", "terminal_output", "test_results", "api_routes", "repository_code", "database_schema", "network_trace", "config_file", "project_structure")
HYPOTHESES = (
    ("404", "Requested route is not registered"),
    ("404", "Request path is incorrect"),
    ("connection refused", "Target service is not running"),
    ("connection refused", "Network configuration issue exists"),
    ("timeout", "Dependency is responding too slowly"),
)


def _has(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


def _rules(text: Column, rules, default) -> Column:
    pick = F.when(F.lit(False), F.lit(default))
    for value, words in rules:
        pick = pick.when(_has(text, words), F.lit(value))
    return pick.otherwise(F.lit(default))


def intent(text: Column) -> Column:
    """struct<investigation_type, domain, confidence> of a request."""
    low = F.lower(text)
    kind, domain = _rules(low, [(t, w) for t, w, _ in TYPES], "unknown"), _rules(low, DOMAINS, "unknown")
    sure = {t: c for t, _, c in TYPES} | {"unknown": 0.40}
    # the confidence is looked up by type and by whether the domain is known
    table = F.create_map(*[x for t, c in sure.items() for k in (True, False) for x in (F.lit(f"{t} {str(k).lower()}"), F.lit(CONFIDENCE[(c, k)]))])
    both = F.transform(F.array(F.struct(kind.alias("k"), domain.alias("d"))), lambda x: F.struct(x["k"].alias("investigation_type"), x["d"].alias("domain"), F.element_at(table, F.concat_ws(" ", x["k"], (x["d"] != "unknown").cast("string"))).alias("confidence")))
    return both[0]


def repository_intent(text: Column) -> Column:
    """Intent of a question about a repository."""
    low = F.lower(text)
    return F.when(low.rlike(r"\b(?:error|bug|fail|exception|500|404)\b"), "bug_investigation").when(low.rlike(r"\b(?:where|find|handled|implemented)\b"), "symbol_lookup").otherwise("general_search")


def plan_rules(spark: SparkSession) -> DataFrame:
    """(investigation_type, domain, evidence_type, ord)."""
    rows = [(t, d, e, i) for (t, d), es in PLANS.items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "investigation_type string, domain string, evidence_type string, ord int")


def evidence_plan(requests: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """(request_id, evidence_type, priority, missing) of requests
    (request_id, investigation_type, domain): the rule's evidence or the
    default, in fixed priority; ``missing`` where ``available(request_id,
    evidence_type)`` lacks it. The rules are a few fixed rows."""
    needs = F.create_map(*[x for (t, d), es in PLANS.items() for x in (F.lit(f"{t} {d}"), F.array(*[F.lit(e) for e in es]))])
    fallback = F.array(*[F.lit(x) for x in DEFAULT_PLAN])
    rank = F.create_map(*[x for i, e in enumerate(PRIORITY, 1) for x in (F.lit(e), F.lit(i))])
    wanted = F.coalesce(needs[F.concat_ws(" ", "investigation_type", "domain")], fallback)
    got = requests.select("request_id", F.explode(wanted).alias("evidence_type"))
    got = got.withColumn("priority", F.coalesce(rank[F.col("evidence_type")], F.lit(999)))
    if available is None:
        return got.withColumn("missing", F.lit(True))
    have = available.select("request_id", "evidence_type").distinct().withColumn("_h", F.lit(True))
    return got.join(have, ["request_id", "evidence_type"], "left").withColumn("missing", F.col("_h").isNull()).drop("_h")


def facts(evidence: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(id, statement, evidence_id, confidence): short texts that are no chat
    turns, white space made one, cut at 350; one row a statement, the first."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    rows = evidence.filter((F.length(stripped) > 0) & (F.length(stripped) <= 600) & ~stripped.startswith("[USER]:") & ~F.contains(stripped, F.lit("\n---\n")))
    statement = F.when(F.length(clean) > 350, F.concat(F.rtrim(F.substring(clean, 1, 350)), F.lit("..."))).otherwise(clean)
    rows = rows.select(F.col(key).alias("evidence_id"), F.col(order).alias("o"), statement.alias("statement"))
    one = rows.groupBy("statement").agg(F.min_by("evidence_id", F.struct("o", "evidence_id")).alias("evidence_id"))
    return one.select(F.concat(F.lit("fact-"), F.substring(F.sha2("statement", 256), 1, 12)).alias("id"), "statement", "evidence_id", F.lit(1.0).alias("confidence"))


def hypotheses(fact_rows: DataFrame) -> DataFrame:
    """(id, statement, n_support, n_contra, score, status, rule): facts through the keyword
    rules, merged by statement, counted map-side."""
    low = F.lower("statement")
    made = F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.struct(F.lit(h).alias("statement"), F.lit(i).alias("rule"))) for i, (k, h) in enumerate(HYPOTHESES)]), lambda x: x.isNotNull())
    rows = fact_rows.select("id", F.explode(made).alias("h")).select("id", "h.*")
    merged = rows.groupBy("statement").agg(F.min("rule").alias("rule"), F.countDistinct("id").alias("n_support"))
    return status(merged.select(F.concat(F.lit("hyp-"), F.substring(F.sha2("statement", 256), 1, 12)).alias("id"), "statement", "rule", "n_support", F.lit(0).cast("bigint").alias("n_contra")))


def status(rows: DataFrame) -> DataFrame:
    """Score and status from the numbers of supporting and contradicting facts."""
    s, c = F.col("n_support"), F.col("n_contra")
    score = F.when(c > s, 0.0).when(s >= 2, F.least(F.lit(1.0), 0.5 + 0.1 * s)).otherwise(0.5)
    return rows.withColumn("score", score).withColumn("status", F.when(c > s, "rejected").when(s >= 2, "supported").otherwise("active"))


def root_causes(rows: DataFrame, base: Column | None = None) -> DataFrame:
    """Hypotheses by confidence, best first: base score and a tenth for each
    supporting less 0.15 for each contradicting fact, within 0 and 1."""
    raw = (F.lit(0.5) if base is None else base) + 0.10 * F.col("n_support") - 0.15 * F.col("n_contra")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(raw, 2)))
    kept = rows.filter("status <> 'rejected'").withColumn("confidence", confidence)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("confidence"), "rule")))  # a row a rule
