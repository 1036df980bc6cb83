"""Routes and what handles, uses and executes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.operators import graph


def handlers(routes: DataFrame) -> DataFrame:
    """(route, handler, file_path): METHOD:path with the last handler in order;
    routes without a handler are left out. ``routes(method, path, handler,
    file_path, ord)``."""
    named = routes.filter("handler is not null and handler <> ''").withColumn("route", F.concat(F.upper("method"), F.lit(":"), "path"))
    return named.groupBy("route").agg(F.max_by(F.struct("handler", "file_path"), F.struct("ord", "handler", "file_path")).alias("v")).select("route", "v.*")


def symbols_of(routes: DataFrame, definitions: DataFrame) -> DataFrame:
    """(route, name, type): what the handler's file defines."""
    h = handlers(routes)
    return h.join(definitions.select(F.col("file").alias("file_path"), "name", "type"), "file_path").select("route", "name", "type").distinct()


def references_of(routes: DataFrame, references: DataFrame) -> DataFrame:
    """(route, file, line): where the handler's name is used."""
    h = handlers(routes)
    return h.join(references.select(F.col("name").alias("handler"), "file", "line"), "handler").select("route", "file", "line").distinct()


def request_trace(routes: DataFrame, references: DataFrame) -> DataFrame:
    """(route, step, kind, name): the route, its handler, then its uses by
    file and line."""
    h = handlers(routes)
    head = h.select("route", F.lit(0).alias("step"), F.lit("route").alias("kind"), F.col("route").alias("name")).unionByName(h.select("route", F.lit(1).alias("step"), F.lit("handler").alias("kind"), F.col("handler").alias("name")))
    order = Window.partitionBy("route").orderBy("file", "line")  # sorts and spills, collects nothing
    rest = references_of(routes, references).select("route", (F.row_number().over(order) + 1).alias("step"), F.lit("reference").alias("kind"), F.concat_ws(":", "file", "line").alias("name"))
    return head.unionByName(rest)


def catalogue(routes: DataFrame) -> DataFrame:
    return routes.select(F.coalesce("path", F.lit("")).alias("path"), F.upper("method").alias("method"), "handler").distinct().orderBy("path", "method", "handler")


def trace_to(routes: DataFrame, calls: DataFrame, route: str, target: str) -> list[str]:
    """[route, handler, ..., target]; [] if the route or the path is unknown."""
    h = handlers(routes).filter(F.col("route") == route).select("handler").take(1)
    path = graph.shortest_path(calls, h[0][0], target) if h else []
    return [route, *path] if path else []


def find_callable(calls: DataFrame, methods: DataFrame, name: str) -> DataFrame:
    """(id, name, type) of one name among the endpoints of the call edges, else
    the first method with that bare or qualified name; nothing for classes."""
    ends = calls.select(F.col("source").alias("id")).unionByName(calls.select(F.col("target").alias("id"))).filter(F.col("id") == name).distinct()
    found = ends.select("id", F.lit(name).alias("name"), F.when(F.contains("id", F.lit(".")), "method").otherwise("function").alias("type"), F.lit(0).alias("rank"))
    qualified = F.concat_ws(".", "class_name", "name")
    other = methods.filter((F.col("name") == name) | (qualified == name)).select(qualified.alias("id"), F.lit(name).alias("name"), F.lit("method").alias("type"), F.lit(1).alias("rank"))
    return found.unionByName(other).orderBy("rank", "id").limit(1).drop("rank")
