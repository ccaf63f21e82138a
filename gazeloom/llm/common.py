"""What the operators of this subpackage share: input tables, staged tables, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom import staging
from gazeloom.staging import new_path, stage, staged_batches

__all__ = ["BATCH_ROWS", "labelled_text", "new_path", "release", "shuffle_partitions", "small", "small_batches", "stage", "staged_batches", "table", "texts", "tidy"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of texts that go to a Python worker at once, while an operator runs.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to Python in small batches; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """staging.tidy(), with texts in small batches meanwhile: an operator whose result is staged when it returns, and whose other tables are deleted then, or where it fails."""
    whole = staging.tidy(operator)

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        with small_batches(next(x for x in (*args, *kwargs.values()) if isinstance(x, DataFrame)).sparkSession):
            return whole(*args, **kwargs)

    return run


#: Rows of a few numbers each up to which a staged table is broadcast; beyond that the join is left to Spark.
BROADCAST_IDS = 1_000_000


def small(staged: DataFrame) -> DataFrame:
    """Mark a staged table of a few numbers a row for broadcast if it has few rows; else the join is left to Spark, which may split it."""
    return F.broadcast(staged) if staged.count() <= BROADCAST_IDS else staged


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def labelled_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns of any name cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def texts(column) -> list[str]:
    """Values of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def release() -> None:
    """Give back to the system what earlier tasks of this Python worker have freed; an executor's JVM needs the room."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
