"""Crawl files, article files and log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.operators.adapt import to_article_schema
from gazeloom.schemas import CRAWL


def read_crawl_json(spark: SparkSession, path: str) -> DataFrame:
    """Crawl files, each a JSON array of records or one record; a file that is neither is an error."""
    return spark.read.schema(CRAWL).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_articles_json(df: DataFrame, path: str) -> None:
    """Articles as JSON lines with dates as text."""
    stamps = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX") for c, kind in df.dtypes if kind == "timestamp"}
    df.withColumns(stamps).write.mode("overwrite").json(path) if stamps else df.write.mode("overwrite").json(path)


def append_articles(df: DataFrame, path: str) -> None:
    """Append rows in the article schema, with defaults; rows without an id are left out."""
    to_article_schema(df).write.mode("append").parquet(path)


def read_app_logs(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no and value of log files; line_no ascends within a file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return lines.select("file", F.struct("block", F.monotonically_increasing_id().alias("n")).alias("line_no"), "value")
