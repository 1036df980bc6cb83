"""Tables of sessions, registries and graphs on disk.

State is append-only: an upsert appends, and the current state is the last row
of each key. Graph tables carry a version and are checked when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

TIMELINE = "session string, seq bigint, id string, timestamp string, type string, content string, metadata map<string,string>"
# Events that a prompt shows.
SIGNALS = ("user_request", "decision_made", "fact_verified", "hypothesis_created", "evidence_added")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table; an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("v")).select(*keys, "v.*")


def insert_missing(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``new`` whose key isn't there, the first of each key."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("v")).select(key, "v.*").select(*new.columns)
    return first.join(existing.select(key), key, "left_anti").select(*new.columns)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, project: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    meta = nodes.agg(F.count("*").alias("node_count")).withColumn("k", F.lit(1)).join(edges.agg(F.count("*").alias("edge_count")).withColumn("k", F.lit(1)), "k")
    meta.select(F.lit(project).alias("project_name"), F.lit("1.0").alias("schema_version"), F.current_timestamp().alias("created_at"), "node_count", "edge_count").write.mode("overwrite").json(f"{path}/metadata")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; names the columns that are missing, sorted."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    missing = sorted(({"id", "type", "name"} - set(nodes.columns)) | ({"source", "target", "relationship"} - set(edges.columns)))
    if missing:
        raise ValueError(f"graph lacks {', '.join(missing)}")
    return nodes, edges


def recent(timeline: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` events of each session."""
    w = Window.partitionBy("session").orderBy(F.desc("seq"))
    return timeline.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def signals(timeline: DataFrame) -> DataFrame:
    """Events a prompt shows, the first of each beginning of 80 characters."""
    head = F.substring("content", 1, 80)
    rest = [c for c in timeline.columns if c != "session"]
    rows = timeline.filter(F.col("type").isin(*SIGNALS)).withColumn("_h", head)
    return rows.groupBy("session", "_h").agg(F.min_by(F.struct(*rest), "seq").alias("v")).select("session", "v.*")


def session_stats(facts: DataFrame, hypotheses: DataFrame, evidence: DataFrame, timeline: DataFrame) -> DataFrame:
    """Counts of the four tables by session: one union, one aggregation."""
    parts = None
    for name, df in (("facts", facts), ("hypotheses", hypotheses), ("evidence", evidence), ("events", timeline)):
        p = df.select("session", F.lit(name).alias("what"))
        parts = p if parts is None else parts.unionByName(p)
    count = lambda n: F.sum(F.when(F.col("what") == n, 1).otherwise(0)).alias(n)
    return parts.groupBy("session").agg(count("facts"), count("hypotheses"), count("evidence"), count("events"))


class GraphCache:
    """Loaded graphs by path, kept in memory and on disk of the executors until
    they are invalidated."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._kept = spark, {}

    def load(self, path: str) -> tuple[DataFrame, DataFrame]:
        if path not in self._kept:
            self._kept[path] = tuple(df.persist() for df in load_graph(self.spark, path))
        return self._kept[path]

    def contains(self, path: str) -> bool:
        return path in self._kept

    def invalidate(self, path: str) -> None:
        for df in self._kept.pop(path, ()):
            df.unpersist()

    def clear(self) -> None:
        for path in list(self._kept):
            self.invalidate(path)
