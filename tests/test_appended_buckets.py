"""The ingest stream writes what a batch brings, not the buckets that it falls into."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gazeloom.operators import dedup
from gazeloom.plans.views import articles
from gazeloom.streaming import buckets as B
from gazeloom.streaming import streams as S

SCHEMA = "news_id string, n int, bucket_name string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_appended_rows_equal_those_of_a_whole_table(spark, tmp_path):
    """Batches over all buckets, one that runs again, buckets that are written as one, and states that are kept."""
    table, schema = f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema
    states = {-1: spark.createDataFrame([], schema)}
    for number in [0, 1, 2, 2, 3, 4, 5, 6]:
        new = spark.createDataFrame([(f"k{(number * 11 + i * 3) % 60}", number * 100 + i, "x") for i in range(15)] + [("k1", -number, None)], schema).dropDuplicates(["news_id"])
        new = spark.createDataFrame(new.collect(), schema)
        B.append_buckets(new, table, number, schema, B.touched(new, "news_id", 4), buckets=4, segments=3)
        states[number] = spark.createDataFrame(dedup.upsert(states[number - 1], new).collect(), schema)
        assert rows(B.read_buckets(spark, table, schema)) == rows(states[number])
        assert number < 2 or rows(B.read_buckets(spark, table, schema, before=number)) == rows(states[number - 1])
    assert max(map(len, B.manifest(spark, table).values())) <= 3 and B.committed(spark, table) == [4, 5, 6]
    # What no kept state names is gone.
    named = {(n, b) for k in (5, 6, 7) for b, of in B.manifest(spark, table, k).items() for n in of}
    assert {tuple(int(x.split("=")[1]) for x in p.split("/")[-2:]) for kind in ("data", "gone") for p in glob.glob(f"{tmp_path}/t/{kind}/batch=*/bucket=*")} <= named
    # Whole buckets over appended ones, and rows of buckets that weren't there.
    B.upsert_buckets(spark.createDataFrame([("k1", 7, "y")], schema), table, 7, schema, buckets=4)
    assert rows(B.read_buckets(spark, table, schema)) == rows(dedup.upsert(states[6], spark.createDataFrame([("k1", 7, "y")], schema)))
    B.append_buckets(spark.createDataFrame([], schema), table, 8, schema, set(), buckets=4)
    assert rows(B.read_buckets(spark, table, schema, before=9)) == rows(B.read_buckets(spark, table, schema, before=8))


def test_a_stream_writes_each_row_once(spark, sf_dir, tmp_path):
    a = articles(spark, sf_dir).drop("doc_id").withColumn("seq", F.monotonically_increasing_id())
    schema = a.drop("seq").schema
    source = f"file://{tmp_path}/in"
    for k in range(4):
        a.where(F.col("seq") % 4 == k).coalesce(1).write.mode("append").parquet(source)
    again = a.where("seq % 40 = 3").withColumns({"publish_date": F.lit("2025-01-01").cast("timestamp"), "seq": F.col("seq") + 10**12})
    again.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(source)
    S.stream_ingest(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/s", schema, buckets=4).awaitTermination()
    found = S.snapshot(spark, f"file://{tmp_path}/t", schema)
    valid = found.count()
    assert valid == found.select("news_id").distinct().count() > 100
    changed = found.where("publish_date = '2025-01-01'").count()
    assert 0 < changed
    assert sum(pq.read_metadata(p).num_rows for p in glob.glob(f"{tmp_path}/t/data/*/*/*.parquet")) == valid + changed
