"""The table in hash buckets, and the ingest stream that writes it."""

import glob
import os

from pyspark.sql import functions as F

from gazeloom.operators import dedup
from gazeloom.plans.views import articles
from gazeloom.streaming import buckets as B
from gazeloom.streaming import streams as S

SCHEMA = "news_id string, n int, crawl_version int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upserts_equal_those_of_a_whole_table(spark, tmp_path):
    table, schema = f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema
    plain = spark.createDataFrame([], schema)
    for number in range(6):
        new = spark.createDataFrame([(f"k{(number * 7 + i * 3) % 40}", number * 100 + i, 1) for i in range(4)] + [("k1", -number, 1)], schema)
        B.upsert_buckets(new, table, number, schema, buckets=8, order="n", bump=True)
        plain = spark.createDataFrame(dedup.upsert(plain, new, order="n", bump=True).collect(), schema)
        assert rows(B.read_buckets(spark, table, schema)) == rows(plain)
    # A batch that runs again gives the same; states that are kept can be read.
    B.upsert_buckets(new, table, 5, schema, buckets=8, order="n", bump=True)
    assert rows(B.read_buckets(spark, table, schema)) == rows(plain)
    assert B.committed(spark, table) == [3, 4, 5]
    assert B.read_buckets(spark, table, schema, before=5).count() > 0


def test_a_batch_writes_the_buckets_of_its_keys_alone(spark, tmp_path):
    table, schema = f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema
    B.upsert_buckets(spark.range(5000).selectExpr("concat('k', id) AS news_id", "cast(id AS int) AS n", "1 AS crawl_version"), table, 0, schema, buckets=32)
    B.upsert_buckets(spark.createDataFrame([("k7", -1, 1), ("k8", -2, 1)], schema), table, 1, schema, buckets=32)
    size = lambda n: sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/t/data/batch={n}/*/*.parquet"))
    assert len(glob.glob(f"{tmp_path}/t/data/batch=1/bucket=*")) <= 2
    assert size(1) < 0.1 * size(0)
    assert B.read_buckets(spark, table, schema).count() == 5000
    # What no kept state names goes.
    for number in range(2, 6):
        B.upsert_buckets(spark.createDataFrame([("k7", number, 1)], schema), table, number, schema, buckets=32, keep=2)
    assert len(glob.glob(f"{tmp_path}/t/data/batch=*/bucket={B.touched(spark.createDataFrame([('k7',)], 'news_id string'), 'news_id', 32).pop()}")) == 2
    assert dict(B.read_buckets(spark, table, schema).where("news_id in ('k7', 'k8')").select("news_id", "n").collect()) == {"k7": 5, "k8": -2}


def test_deleted_and_empty(spark, tmp_path):
    table, schema = f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema
    B.upsert_buckets(spark.createDataFrame([], schema), table, 0, schema)
    assert B.read_buckets(spark, table, schema).count() == 0
    B.upsert_buckets(spark.createDataFrame([("a", 1, 1)], schema), table, 1, schema)
    which = B.touched(spark.createDataFrame([("a",)], "news_id string"), "news_id", B.BUCKETS)
    B.write_buckets(spark.createDataFrame([], schema), table, 2, which)  # a bucket whose last row was deleted
    assert B.read_buckets(spark, table, schema).count() == 0


def test_stream_ingest_replays_and_leaves_no_litter(spark, sf_dir, tmp_path):
    from gazeloom.staging import shared_dir

    a = articles(spark, sf_dir).drop("doc_id").withColumn("seq", F.monotonically_increasing_id())
    schema = a.drop("seq").schema
    source = f"file://{tmp_path}/in"
    for k in range(3):
        a.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(source)
    shared = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(shared))
    for state in ("s1", "s2"):  # the second stream runs all batches again, over the table as it is
        S.stream_ingest(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/{state}", schema, buckets=4).awaitTermination()
        found = S.snapshot(spark, f"file://{tmp_path}/t", schema)
        assert found.count() == found.select("news_id").distinct().count() > 100
    assert set(os.listdir(shared)) == before
