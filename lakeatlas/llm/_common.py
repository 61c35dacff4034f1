"""Reading tables and keeping intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one is made and set in local mode (tests), and
    it is an error on a cluster, whose executors don't see the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lakeatlas_shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-lakeatlas-")
        spark._lakeatlas_shared = found
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lakeatlas/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at ``path``."""
    store, found = _hadoop(spark, f"{path}/_SUCCESS")
    return store.exists(found)


@contextlib.contextmanager
def stage(spark: SparkSession, before: list[str], first: bool = False):
    """Remember what ``kept`` writes inside, in ``before``; what is remembered from the stage before is deleted first.

    For pipelines: a stage reads the written result of the one before, and nothing else of it. The ``first`` stage of a
    chain deletes nothing, for the tables remembered may be those of another chain's result.
    """
    if not first:
        for path in before:
            store, found = _hadoop(spark, path)
            store.delete(found, True)
    before.clear()
    spark._lakeatlas_written = before
    try:
        yield
    finally:
        spark._lakeatlas_written = None


#: Spark's setting to remove an execution's shuffle files at its end; nothing reads those of a table that is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives the loss of an executor."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    written = getattr(spark, "_lakeatlas_written", None)
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parts(df: DataFrame) -> int:
    """How many partitions the session gives to a shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch: pa.RecordBatch, column: str, lower: bool = False) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes, null as empty; ``lower`` changes A-Z only."""
    found = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
    return [x.lower() for x in found] if lower else found


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows``, so that a task holds few texts as Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_arrow(df: DataFrame, run: Callable[[pa.RecordBatch], list[pa.Array]], more: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns ``drop`` and with those of ``more`` ("name type, ..."), which ``run`` makes of each batch.

    Columns pass through as Arrow, so that numbers beyond 2 ** 53 keep their value beside nulls.
    """
    left = [c for c in df.columns if c not in drop]
    names = [f.name for f in T.StructType.fromDDL(more).fields]

    def each(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in left), *run(b)], names=[*left, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*(F.col(f"`{c}`") for c in left)).schema)
    return df.mapInArrow(each, ", ".join(x for x in (kinds, more) if x))
