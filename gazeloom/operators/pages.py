"""Lists in pages, also very deep ones: a range index of the order, of which a page reads only the ranges that hold its rows.

    <path>/rows/range=R/*.parquet    the rows of range R of the order
    <path>/counts/*.parquet          range, value, n: how many rows of a value a range holds

A page adds up the counts to find its ranges; a total is their sum. Neither reads a row of the list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Orders of the lists: columns, descending with nulls last, the last of them unique. Keys of the same moment stand by their key.
ORDERS = {"notices": ("date", "updated_at", "id"), "submissions": ("date", "id"), "registrations": ("created_at", "id"), "users": ("created_at", "id"), "keys": ("created_at", "key")}
#: The column that a list is filtered by.
FILTERS = {"notices": "label", "submissions": "status", "registrations": "status", "users": "is_active", "keys": "owner"}
#: Rows of a range, and ranges of an index: beyond RANGE_ROWS * MAX_RANGES rows the ranges grow.
RANGE_ROWS, MAX_RANGES = 100_000, 10_000


def order_of(df: DataFrame, kind: str) -> list[Column]:
    return [F.desc(c) for c in ORDERS[kind] if c in df.columns]


def page_of(df: DataFrame, kind: str, page: int, size: int, value=None) -> tuple[DataFrame, DataFrame]:
    """One page of a list of ORDERS and the number of its rows, as a frame of one row. value keeps the rows of one label, status, owner or activity; the number of keys is that of all owners. Pages count from 1; an empty owner is no filter."""
    column = FILTERS[kind]
    kept = df if value is None or (kind == "keys" and value == "") else df.where(F.col(column) == F.lit(value))
    counted = df if kind == "keys" else kept
    return kept.orderBy(*order_of(df, kind)).offset((max(1, page) - 1) * size).limit(size), counted.agg(F.count(F.lit(1)).alias("total"))


@dataclass(frozen=True)
class PageIndex:
    """A list that index_pages() has written."""

    path: str
    kind: str
    schema: T.StructType
    columns: tuple[str, ...]

    def _counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([T.StructField("range", T.IntegerType()), T.StructField("value", self.schema[FILTERS[self.kind]].dataType), T.StructField("n", T.LongType())])).parquet(f"{self.path}/counts")

    def page(self, spark: SparkSession, page: int, size: int, value=None) -> tuple[DataFrame, DataFrame]:
        """What page_of() gives, from the ranges of the page alone. At most MAX_RANGES counts pass through the driver."""
        counts = self._counts(spark)
        kept = counts if value is None or (self.kind == "keys" and value == "") else counts.where(F.col("value") == F.lit(value))
        begin = (max(1, page) - 1) * size
        before, skipped, ranges = 0, 0, []
        for row in kept.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():
            if before < begin + size and before + row["n"] > begin:
                ranges.append(row["range"])
            elif before + row["n"] <= begin:
                skipped += row["n"]
            before += row["n"]
        rows = spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/range={r}" for r in ranges]) if ranges else spark.createDataFrame([], self.schema)
        if kept is not counts:
            rows = rows.where(F.col(FILTERS[self.kind]) == F.lit(value))
        total = (counts if self.kind == "keys" else kept).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        return rows.orderBy(*order_of(rows, self.kind)).offset(begin - skipped).limit(size).select(*self.columns), total


def index_pages(df: DataFrame, kind: str, path: str, range_rows: int = RANGE_ROWS) -> PageIndex:
    """Write a list in ranges of its order, about range_rows rows each, with their counts by the value it is filtered by.

    Equal rows of the order stand in one range; the order ends in a unique column, so a date that a third of the rows share is cut like any other. Nulls of the order come last, as they do in page_of(). An empty
    list has no ranges, and its pages are empty.
    """
    n = max(1, min(MAX_RANGES, math.ceil(df.count() / range_rows)))
    dealt = df.repartitionByRange(n, *order_of(df, kind)).withColumn("range", F.spark_partition_id())
    dealt.write.partitionBy("range").parquet(f"{path}/rows")
    stored = T.StructType([f for f in df.schema.fields])
    rows = df.sparkSession.read.schema(T.StructType([*stored.fields, T.StructField("range", T.IntegerType())])).parquet(f"{path}/rows")
    rows.groupBy("range", F.col(FILTERS[kind]).alias("value")).agg(F.count(F.lit(1)).alias("n")).coalesce(8).write.parquet(f"{path}/counts")
    return PageIndex(path, kind, stored, tuple(df.columns))
