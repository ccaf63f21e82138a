"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder of our own where it is unset and the master is local, as in tests. On a cluster an unset folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = own.get() if own.isDefined() else "file://" + tempfile.mkdtemp(prefix="gazeloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths made by the operators that are running, innermost last.
_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later steps don't compute it again and survive lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path  # type: ignore[attr-defined]
    return staged


def staged_batches(path: str, columns: list[str], rows: int) -> Iterator:
    """Inside a task: the rows of a staged table, in Arrow batches of at most so many, from the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    for found in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda x: x.path):
        if found.path.endswith(".parquet"):
            with store.open_input_file(found.path) as source:
                yield from pq.ParquetFile(source).iter_batches(rows, columns=columns, use_threads=False)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scope(made: list[str]) -> Iterator[None]:
    """Paths made meanwhile are noted in the list."""
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is staged when it returns, and whose other tables are deleted then, or where it fails.

    The result itself stays in the shared folder, since the caller reads from it, until the operator that called this one returns.
    """

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        spark = next(x for x in (*args, *kwargs.values()) if isinstance(x, DataFrame)).sparkSession
        made: list[str] = []
        try:
            with scope(made):
                result = operator(*args, **kwargs)
            return stage(result, operator.__name__.replace("_", "-"))
        finally:
            delete(spark, made)

    return run


#: Rows of a side up to which it is broadcast.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast if it has few rows; else the join is left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
