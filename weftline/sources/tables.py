"""Reading and writing tables, and intermediates that survive the loss of executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder as a stream of its files, be it one file or a folder of them (a pattern reads both)."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Any source that Spark reads: parquet, csv, json, text, binaryFile, orc."""
    return spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options) -> None:
    """Any sink that Spark writes; documents are laid out by category with ``partition_by``."""
    df.write.format(kind).options(**options).mode(mode).partitionBy(*partition_by).save(path)


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder in the one that driver and executors share, ``spark.checkpoint.dir``; removed when Spark ends.

    Where that is unset, a temporary folder is made if all runs in one process (``local``); on a cluster it is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        base = context.getCheckpointDir()
    path = f"{base}/weftline-{context.applicationId}"
    if path not in _folders:
        _folders.add(path)
        _path(spark, path)[1].deleteOnExit(_path(spark, path)[0])
    return path


_folders: set[str] = set()
_scopes: list[list[tuple[SparkSession, str]]] = []


def _path(spark: SparkSession, path: str) -> tuple:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, keep: bool = False, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a local checkpoint this survives the loss of executors, and it keeps column pruning. With ``keep`` it outlives
    the innermost scope of ``intermediates``. Filters on ``partition_by`` columns read their folders alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if _scopes[keep:]:
        _scopes[-1 - keep].append((spark, path))
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_written", None):
            found, files = _path(df.sparkSession, path)
            files.delete(found, True)


@contextlib.contextmanager
def intermediates() -> Iterator[None]:
    """Delete what is written within, when it ends; results must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            found, files = _path(spark, path)
            files.delete(found, True)
