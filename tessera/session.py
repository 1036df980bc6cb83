"""Session helpers: table loading, durable stages and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One input table; a file or a directory of part files."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    all executors are threads of this machine (tests, local runs) a temporary
    folder stands in, which goes when Python ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(shared_dir, "_own"):
        shared_dir._own = tempfile.TemporaryDirectory(prefix="tessera-")
    return "file://" + shared_dir._own.name


def stage(df: DataFrame, label: str, *, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage
    durably, so that the loss of an executor costs no recomputation. ``by``
    names columns of few values by which the rows are laid out. The folder is
    deleted when Python ends."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[tuple[SparkSession, str]] = []


def drop_stages() -> None:
    """Deletes what :func:`stage` wrote, through the file system of its path."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder is the cluster's to clear
            pass
