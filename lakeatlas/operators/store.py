"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to remove an execution's shuffle files at its end; nothing reads those of a table that is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lakeatlas_tables", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark._lakeatlas_tables = "file://" + tempfile.mkdtemp(prefix="spark-lakeatlas-")
    return base.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows reads it instead of computing it anew, and an
    executor that is lost costs its own tasks only."""
    return written_at(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def written_at(df: DataFrame, path: str) -> DataFrame:
    """The same at a path, in place of what is there."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote, where it is there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


class Relations(dict):
    """Relations by name, each made from ``makers`` and written when it is first asked for."""

    def __init__(self, makers: dict):
        super().__init__()
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = found = written(self.makers[name](), name)
        return found

    def once(self, name: str) -> DataFrame:
        """A relation that is read one time only, which need not be written and keeps its shuffle for what follows."""
        return self[name] if name in self else self.makers[name]()
