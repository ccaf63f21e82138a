"""Batches of several files, and buckets that several tasks write."""

import glob

from pyspark.sql import functions as F

from gazeloom.plans import serve_queries as Q
from gazeloom.streaming import buckets as B


def test_a_batch_is_several_files(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(Q, "FILE_ROWS", 50)
    frame = spark.range(0, 1000, 1, 8).withColumn("part", F.when(F.col("id") < 400, 0).when(F.col("id") < 410, 1).otherwise(2))
    got = Q.drain(Q.streamed(spark, sf_dir, frame, "rows", [F.col("part") == k for k in range(3)]), "batches", "update").groupBy("batch", "part").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 400), (1, 1, 10), (2, 2, 590)]


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    table, schema = f"file://{tmp_path}/t", spark.createDataFrame([], "news_id string, x string").schema
    rows = spark.range(0, 40_000, 1, 4).select(F.concat(F.lit("k"), "id").alias("news_id"), F.sha2(F.col("id").cast("string"), 512).alias("x"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        B.write_buckets(rows, table, 0, {0, 1}, buckets=2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert all(len(glob.glob(f"{tmp_path}/t/data/batch=0/bucket={b}/*.parquet")) > 3 for b in (0, 1))
    assert rows.exceptAll(B.read_buckets(spark, table, schema)).isEmpty() and B.read_buckets(spark, table, schema).count() == 40_000
