"""Operators delete their intermediate tables; what stays is what their results read from."""

import os

import pytest
from pyspark.sql import functions as F

from gazeloom.operators import ann, dedup, ingest, retrieval
from gazeloom.plans.views import articles, incoming, table
from gazeloom.staging import shared_dir


@pytest.fixture
def made(spark):
    """The folders made since the test began."""
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    return lambda: sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before)


def test_near_duplicates(spark, sf_dir, made):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("content_text"))
    assert dedup.near_duplicates(rows).where("is_near_duplicate").count() > 0
    assert made() == ["near-flags"]


def test_searches(spark, sf_dir, made):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    assert retrieval.fulltext_search(q, articles(spark, sf_dir), 3).count() > 0
    assert retrieval.simple_text_search(q, articles(spark, sf_dir), 3).count() > 0
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert ann.ann_search(asked, e.select(F.col("vec_id").alias("news_id"), F.col("embedding").alias("content_embedding")), 3).count() > 0
    assert made() == ["ann-search", "fulltext-search", "simple-text-search"]


def test_a_failed_search(spark, sf_dir, made):
    bad = spark.createDataFrame([(1, "x")], "query_id int, query string").withColumn("query", F.raise_error(F.lit("no query")))
    with pytest.raises(Exception, match="no query"):
        retrieval.fulltext_search(bad, articles(spark, sf_dir), 3)
    assert made() == []


def test_ingest(spark, sf_dir, made):
    done = ingest.ingest(incoming(spark, sf_dir).drop("doc_id"), articles(spark, sf_dir).drop("doc_id"), near=True, vectors={"content_embedding": ("content_text", 8)})
    assert done["table"].count() > 0 and done["statuses"].count() > 0
    assert made() == ["articles", "statuses"]
