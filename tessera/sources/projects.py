"""Projects: artifacts on disk, registry, evidence by plan, sessions."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.operators import graph, symbols
from tessera.sources import repository, stores

# Sources of each kind of evidence, labels of questions.
DISPATCH = {
    "project_structure": "project", "repository_code": "file", "api_routes": "file", "config_file": "file", "database_schema": "file",
    "server_logs": "log", "stack_trace": "log", "network_trace": "log", "terminal_output": "terminal", "test_results": "terminal",
}
LABELS = {
    "server_logs": "server logs", "stack_trace": "stack trace", "api_routes": "API routes", "repository_code": "repository implementation", "database_schema": "database schema",
    "config_file": "configuration files", "network_trace": "network trace", "terminal_output": "terminal output", "test_results": "test results", "project_structure": "project structure",
}
TRIM_MARK = ("", "================ TRIMMED LOG ================", "{n} lines omitted", "Chronology preserved:", "- beginning retained", "- ending retained", "=============================================", "")
REGISTRY = "project_name string, project_path string, artifact_path string, metadata map<string,string>, seq bigint, removed boolean"


def log_evidence(df: DataFrame, key: str, text: str, most: int = 5000, head: int = 500, tail: int = 2000) -> DataFrame:
    """(key, content, original_line_count, retained_line_count, was_trimmed):
    long logs keep their beginning and end around eight marking lines, which
    count as retained. Within the row: no shuffle."""
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    rows = df.select(F.col(key).alias("_key"), lines.alias("_l")).withColumn("_n", F.size("_l"))
    omitted = (F.col("_n") - head - tail).cast("string")
    mark = F.array(*[F.replace(F.lit(m), F.lit("{n}"), omitted) for m in TRIM_MARK])
    cut = F.concat(F.slice("_l", 1, head), mark, F.slice("_l", F.greatest(F.col("_n") - tail + 1, F.lit(1)), F.lit(tail)))
    kept = rows.withColumn("_kept", F.when(F.col("_n") > most, cut).otherwise(F.col("_l")))
    return kept.select(F.col("_key").alias(key), F.array_join("_kept", "\n").alias("content"), F.col("_n").alias("original_line_count"), F.size("_kept").alias("retained_line_count"), (F.col("_n") > F.size("_kept")).alias("was_trimmed"))


def project_evidence(files: DataFrame) -> DataFrame:
    """PROJECT_FILE rows, one a file, and one PROJECT_SUMMARY row."""
    kept = repository.keep(files, repository.PROJECT_FOLDERS, repository.PROJECT_EXTENSIONS)
    hist = repository.extension_histogram(kept)
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("extension", "n"))), lambda x: F.concat(x["extension"], F.lit("="), x["n"].cast("string")))
    summary = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("file_count"), F.array_join(pairs, ", ").alias("e"), F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"))
    top = summary.select(F.lit("PROJECT_SUMMARY").alias("evidence_type"), F.lit(".").alias("path"), F.concat(F.lit("files: "), F.col("file_count").cast("string"), F.lit("\nextensions: "), "e", F.lit("\nlanguages: "), "languages").alias("content"))
    return top.unionByName(kept.select(F.lit("PROJECT_FILE").alias("evidence_type"), "path", F.col("path").alias("content")))


def by_plan(plan: list[str], sources: dict[str, Callable[[], DataFrame]]) -> DataFrame | None:
    """Evidence in the order of a plan: each kind's source once; kinds without a
    source give no rows. None if nothing was given."""
    out, used = None, set()
    for kind in plan:
        name = DISPATCH.get(kind)
        if name in sources and name not in used:
            used.add(name)
            part = sources[name]().withColumn("source", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def sources_of(plan: DataFrame) -> DataFrame:
    """(request_id, source) of the sources that each plan's evidence comes from."""
    name = F.create_map(*[x for k, v in DISPATCH.items() for x in (F.lit(k), F.lit(v))])
    return plan.select("request_id", name[F.col("evidence_type")].alias("source")).filter("source is not null").distinct()


def questions(plan: DataFrame) -> DataFrame:
    """(request_id, question, combined) of what a plan lacks, by priority."""
    label = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))])
    name = F.coalesce(label[F.col("evidence_type")], F.replace("evidence_type", F.lit("_"), F.lit(" ")))
    lacks = plan.filter("missing").groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", name.alias("label")))), lambda x: x["label"]).alias("labels"))
    asked = lacks.select("request_id", F.transform("labels", lambda x: F.concat(F.lit("Please provide "), x, F.lit("."))).alias("questions"), F.concat(F.lit("Please provide:\n\n"), F.array_join(F.transform("labels", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")).alias("combined"))
    everyone = plan.select("request_id").distinct()
    return everyone.join(asked, "request_id", "left").select("request_id", F.coalesce("questions", F.array().cast("array<string>")).alias("questions"), F.coalesce("combined", F.lit("All required evidence has been collected.")).alias("combined"))


def build_artifacts(spark: SparkSession, root: str, out: str) -> dict[str, int]:
    """Writes tree, symbols, dependencies, graphs (nodes, edges; calls of the third
    generation) and metadata of a source tree; counts of each."""
    files = repository.listing(spark, root, content=True)
    repository.tree(files).write.mode("overwrite").parquet(f"{out}/tree")
    python = repository.keep(files, repository.TREE_FOLDERS, (".py",)).select("path", F.decode("content", "UTF-8").alias("content"))
    symbols.extract(python).write.mode("overwrite").parquet(f"{out}/symbols")
    table = spark.read.parquet(f"{out}/symbols")
    doc = symbols.symbol_document(table).withColumn("file_id", F.xxhash64("file_path"))
    nodes, edges = graph.build_v2(doc)
    nodes.write.mode("overwrite").parquet(f"{out}/nodes")
    edges.write.mode("overwrite").parquet(f"{out}/edges")
    table.filter("kind = 'import'").select("file_path", F.col("name").alias("module"), F.col("detail").alias("imported"), "line").write.mode("overwrite").parquet(f"{out}/dependencies")
    symbols.resolved_calls(table).write.mode("overwrite").parquet(f"{out}/calls_v3")
    tree = spark.read.parquet(f"{out}/tree").groupBy("node_type").count().collect()
    count = {r["node_type"]: r["count"] for r in tree}
    kinds = table.filter("kind in ('class', 'function', 'method', 'route')").count()
    got = {"files": count.get("file", 0), "directories": count.get("directory", 0), "symbols": kinds, "nodes": spark.read.parquet(f"{out}/nodes").count(), "edges": spark.read.parquet(f"{out}/edges").count()}
    spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} bigint" for k in got)).withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{out}/metadata")
    return got


def open_project(spark: SparkSession, root: str, out: str, *, rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; built only if asked for or not there."""
    if not rebuild:
        try:
            return stores.load_graph(spark, out)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    build_artifacts(spark, root, out)
    return stores.load_graph(spark, out)


class Registry:
    """Projects by path; an append-only table whose last row of a path counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._last = spark, path, 0

    def _write(self, name: str | None, path: str, artifacts: str | None, removed: bool, metadata: dict[str, str]) -> None:
        self._last = max(self._last + 1, time.time_ns())
        stores.append(self.spark.createDataFrame([(name, path, artifacts, metadata, self._last, removed)], REGISTRY).coalesce(1), self.path)

    def _all(self) -> DataFrame:
        return stores.read_or_empty(self.spark, self.path, REGISTRY)

    def register(self, name: str, path: str, artifacts: str, metadata: dict[str, str] | None = None) -> None:
        self._write(name, path, artifacts, False, metadata or {})

    def projects(self) -> DataFrame:
        return stores.latest(self._all(), ["project_path"], "seq").filter("not removed").orderBy(F.lower("project_name"))

    def find(self, name_or_path: str) -> DataFrame:
        return self.projects().filter((F.lower("project_name") == name_or_path.lower()) | (F.col("project_path") == name_or_path))

    def remove(self, name: str) -> bool:
        """Whether there was one of that name."""
        gone = [r["project_path"] for r in self.projects().filter(F.lower("project_name") == name.lower()).collect()]
        for p in gone:
            self._write(name, p, None, True, {})
        return bool(gone)


class Sessions:
    """Investigation sessions: timeline, facts, hypotheses, evidence, memory as
    append-only tables. Rows are ordered by ``seq``, the time of their writing in
    nanoseconds; a deletion is a row, too, before which nothing counts."""

    TABLES = {
        "facts": "session string, seq bigint, statement string, evidence array<string>",
        "hypotheses": "session string, seq bigint, id string, statement string, status string",
        "evidence": "session string, seq bigint, evidence_type string, path string, hash string",
        "memory": "session string, seq bigint, kind string, value string",
        "timeline": stores.TIMELINE,
        "deleted": "session string, seq bigint",
    }

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._last = spark, root, 0

    def _seq(self) -> int:
        self._last = max(self._last + 1, time.time_ns())
        return self._last

    def path(self, name: str = "") -> str:
        """Where the sessions' tables stand."""
        return f"{self.root}/{name}" if name else self.root

    def table(self, name: str, session: str | None = None) -> DataFrame:
        """The rows that count, of one session or of all."""
        df = stores.read_or_empty(self.spark, self.path(name), self.TABLES[name])
        df = df if session is None else df.filter(F.col("session") == session)
        gone = stores.read_or_empty(self.spark, self.path("deleted"), self.TABLES["deleted"]).groupBy("session").agg(F.max("seq").alias("_gone"))
        return df.join(gone, "session", "left").filter("_gone is null or seq > _gone").drop("_gone")

    def append(self, name: str, session: str, rows: DataFrame) -> None:
        """Rows of one table (its columns but session and seq) in one write."""
        given = rows.select(F.lit(session).alias("session"), F.lit(self._seq()).cast("bigint").alias("seq"), "*")
        stores.append(given.select(*[c.split()[0] for c in self.TABLES[name].split(", ")]), self.path(name))

    def _add(self, name: str, session: str, *values) -> None:
        stores.append(self.spark.createDataFrame([(session, self._seq(), *values)], self.TABLES[name]).coalesce(1), self.path(name))

    def event(self, session: str, kind: str, content: str) -> None:
        at = datetime.now(timezone.utc).isoformat()
        self._add("timeline", session, f"evt_{uuid.uuid4().hex}", at, kind, content.strip(), None)

    def exists(self, session: str) -> bool:
        return bool(self.table("timeline", session).take(1))

    def create(self, session: str) -> None:
        if self.exists(session):
            raise FileExistsError(session)
        self.event(session, "session_created", f"Investigation session created for '{session}'")

    def load(self, session: str) -> DataFrame:
        """The timeline; reading is an event, too."""
        if not self.exists(session):
            raise FileNotFoundError(session)
        self.event(session, "session_loaded", f"Session loaded: {session}")
        return self.table("timeline", session).orderBy("seq")

    def resume(self, session: str) -> DataFrame:
        """The timeline of a session that is made where there is none."""
        if not self.exists(session):
            self.create(session)
        return self.load(session)

    def save(self, session: str) -> None:
        self.event(session, "decision_made", "Session saved")

    def delete(self, session: str) -> None:
        """What was written so far counts no more; nothing where there is none."""
        if self.exists(session):
            self._add("deleted", session)

    def names(self) -> DataFrame:
        return self.table("timeline").groupBy("session").agg(F.max("timestamp").alias("updated_at"), F.count("*").alias("n_events")).orderBy(F.desc("updated_at"))

    def add_facts(self, session: str, facts: DataFrame) -> None:
        """Facts (statement, evidence) in one write: stripped statements that
        aren't there yet, the first of each; old ones keep their evidence."""
        new = facts.select(F.regexp_replace("statement", r"^\s+|\s+$", "").alias("statement"), "evidence").filter("statement <> ''")
        self.append("facts", session, stores.insert_missing(self.table("facts", session), new.withColumn("_o", F.to_json("evidence")), "statement", "_o").drop("_o"))

    def add_fact(self, session: str, statement: str, evidence: list[str] | None = None) -> bool:
        """Whether the stripped statement was new; an old one keeps its evidence."""
        statement = statement.strip()
        if self.table("facts", session).filter(F.col("statement") == statement).take(1):
            return False
        self._add("facts", session, statement, evidence or [])
        return True

    def add_hypotheses(self, session: str, rows: DataFrame, status: str = "active") -> None:
        """Hypotheses (id, statement) whose statement wasn't there before this."""
        new = rows.select("id", "statement", F.lit(status).alias("status"))
        self.append("hypotheses", session, new.join(self.table("hypotheses", session).select("statement"), "statement", "left_anti"))

    def add_hypothesis(self, session: str, hid: str, statement: str, status: str = "active") -> None:
        self._add("hypotheses", session, hid, statement, status)

    def hypotheses(self, session: str) -> DataFrame:
        return stores.latest(self.table("hypotheses", session), ["id"], "seq").orderBy("seq", "id")

    def set_status(self, session: str, hid: str, status: str) -> None:
        row = self.hypotheses(session).filter(F.col("id") == hid).take(1)
        if not row:
            raise KeyError(hid)
        self._add("hypotheses", session, hid, row[0]["statement"], status)

    def register_evidence(self, session: str, kind: str, path: str, digest: str | None = None) -> None:
        self._add("evidence", session, kind, path, digest)

    def remember(self, session: str, kind: str, value: str) -> None:
        self._add("memory", session, kind, value)

    def memory(self, session: str) -> dict[str, list[str]]:
        return {r["kind"]: r["v"] for r in self.table("memory", session).groupBy("kind").agg(F.array_sort(F.collect_set("value")).alias("v")).collect()}

    def stats(self) -> DataFrame:
        return stores.session_stats(self.table("facts"), self.table("hypotheses"), self.table("evidence"), self.table("timeline"))

    def summary(self, session: str) -> DataFrame:
        """One row: counts, the number of timeline lines, the last root cause."""
        causes = self.table("memory", session).filter("kind = 'root_cause'").agg(F.max_by("value", "seq").alias("root_cause"))
        made = self.table("timeline", session).agg(F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"))
        one = lambda df: df.withColumn("session", F.lit(session))
        return self.stats().filter(F.col("session") == session).join(one(causes), "session").join(one(made), "session")


def prompt_history(prompts: DataFrame, by: str, order: str, keep: int = 5) -> DataFrame:
    """The newest prompts of each user."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return prompts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def repository_digest(files: DataFrame, readme_chars: int = 2000, paths: int = 60) -> DataFrame:
    """(readme, file_tree) of a listing with contents: the README's beginning and
    the first paths outside node_modules. With a column ``repository``, a row
    for each; top paths are cut before the shuffle."""
    rows = files if "repository" in files.columns else files.withColumn("repository", F.lit(""))
    shown = rows.filter(~F.contains("path", F.lit("node_modules"))).select("repository", "path").withColumn("_r", F.row_number().over(Window.partitionBy("repository").orderBy("path"))).filter(F.col("_r") <= paths)
    tree = shown.groupBy("repository").agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("file_tree"))
    readme = rows.filter(F.lower("path") == "readme.md").groupBy("repository").agg(F.substring(F.decode(F.min_by("content", "path"), "UTF-8"), 1, readme_chars).alias("readme"))
    out = tree.join(readme, "repository", "full").select("repository", "readme", "file_tree")
    return out if "repository" in files.columns else out.drop("repository")
