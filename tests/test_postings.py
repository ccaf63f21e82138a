"""Stored postings give what the scan gives, over batches, and skip segments."""

import random

from pyspark.sql import functions as F

from gazeloom.operators import postings as P
from gazeloom.operators import retrieval as R


def rows(df):
    return sorted((r.query_id, r.news_id, round(r.score, 6), r["rank"]) for r in df.collect())


def test_postings_equal_a_scan(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(300)] + [None, "", "Same text", "Same text", "ü_1 é x-y"]
    docs = spark.createDataFrame([(f"n{i}", f"title {i % 5}", t) for i, t in enumerate(texts)] + [(None, "t", "w1")], "news_id string, title string, content_text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 5, 30])] + [(10, "same SAME text"), (11, ""), (12, None), (13, "nowhere"), (14, "title"), (15, "x-y é")], "query_id int, query string")
    table = f"file://{tmp_path}/t"
    assert P.search_postings(queries, table, 3).count() == 0
    known = docs.where("news_id is not null")
    parts = [F.crc32(F.col("news_id").cast("binary")) % 3 == k for k in range(3)]
    for number, part in enumerate(parts):
        P.add_postings(docs.where(part | F.col("news_id").isNull()).repartition(2), table, number, buckets=5, segment_rows=16)
        so_far = known.where(" or ".join(f"crc32(cast(news_id as binary)) % 3 = {k}" for k in range(number + 1)))
        assert rows(P.search_postings(queries, table, 6, buckets=5)) == rows(R.fulltext_search(queries, so_far, 6))
    P.add_postings(docs.where(parts[2]), table, 2, buckets=5, segment_rows=16)  # the same batch again
    assert rows(P.search_postings(queries, table, 6, buckets=5)) == rows(R.fulltext_search(queries, known, 6))


def test_only_buckets_of_the_terms_are_read(spark, tmp_path):
    docs = spark.range(200).select(F.concat(F.lit("n"), "id").alias("news_id"), F.lit("").alias("title"), F.concat(F.lit("common word"), F.col("id")).alias("content_text"))
    table = f"file://{tmp_path}/t"
    P.add_postings(docs, table, 0, buckets=16)
    found = P.read_postings(spark, table, "string").where(F.col("bucket").isin([3]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert found.select("bucket").distinct().count() == 1
    assert P.search_postings(spark.createDataFrame([(1, "word7 common")], "query_id int, query string"), table, 2, buckets=16).orderBy("rank").first().news_id == "n7"


def test_queries_and_postings_are_not_paired(spark, tmp_path, monkeypatch):
    """20 queries ask for the same two terms; each of these has 3000 postings, which are ranked in tasks."""
    docs = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("news_id"), F.lit("all").alias("title"), F.concat(F.lit("share a word "), F.col("id") % 7).alias("content_text"))
    queries = spark.range(20).select(F.col("id").alias("query_id"), F.concat(F.lit("word share "), F.col("id") % 7).alias("query"))
    table, seen, staged, top = f"file://{tmp_path}/t", [], P.stage, P.top
    P.add_postings(docs, table, 0, buckets=3)
    monkeypatch.setattr(P, "top", lambda df, *more: (seen.append(df.count()), top(df, *more))[1])
    monkeypatch.setattr(P, "stage", lambda df, name: (lambda s: (seen.append(s.count()), s)[1])(staged(df, name)))
    found = P.search_postings(queries, table, 3, buckets=3).collect()
    assert max(seen) <= 20 * 3 * 16
    assert sorted(r.news_id for r in found if r.query_id == 2) == ["n100", "n1003", "n1010"]
