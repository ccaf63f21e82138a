"""Nearest rows: exact, all pairs, and by an index, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeloom.operators import ann, retrieval, vectors


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"news_id {kind}, content_embedding array<float>")


def plain(asked, rows, k, exclude=False):
    """Best rows by cosine of each query, with ties to the smaller key."""
    out = []
    for q, u in asked:
        found = []
        for key, v in rows:
            if v is None or key is None or len(v) != len(u) or (exclude and key == q):
                continue
            size = np.linalg.norm(np.float32(u).astype(float)) * np.linalg.norm(np.float32(v).astype(float))
            found.append((-round(float(np.dot(np.float32(u).astype(float), np.float32(v).astype(float)) / size), 6) if size else 0.0, key))
        out += [(q, key, r) for r, (_, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    out = [(n, [float(x) for x in np.round(r.normal(0, 1, 5), 1)]) for n in range(300)]
    return out + [(n, [1.0, 2.0, 3.0, 0.0, 1.0]) for n in range(400, 430)] + [(500, None), (501, []), (502, [1.0]), (503, [2.0]), (504, [0.0] * 5), (None, [1.0] * 5)]


def test_vector_search(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 64)
    asked = [(n, v) for n, v in rows[::29] if v] + [(502, [1.0])]
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>").unionByName(spark.createDataFrame([(999, None)], "query_id long, vector array<float>"))
    found = vectors.vector_search(queries, frame(spark, rows).repartition(3), 7, exclude_self=True)
    assert sorted((r.query_id, r.news_id, r["rank"]) for r in found.collect()) == plain(asked, rows, 7, True)
    page = vectors.vector_search(queries, frame(spark, rows), 3, offset=4, exclude_self=True)
    assert sorted((r.query_id, r.news_id, r["rank"] + 4) for r in page.collect()) == [x for x in plain(asked, rows, 7, True) if x[2] > 4]
    assert vectors.vector_search(queries.limit(0), frame(spark, rows), 3).count() == 0
    assert vectors.vector_search(queries, frame(spark, []), 3).count() == 0


def test_many_queries_in_one_scan(spark):
    """No query passes through the driver, and the plan reads the corpus once, however many blocks there are."""
    corpus = spark.range(2000).select(F.col("id").cast("string").alias("news_id"), F.array(F.cos("id").cast("float"), F.sin("id").cast("float"), F.cos(F.col("id") * 2).cast("float")).alias("content_embedding"))
    queries = spark.range(20_000).select(F.col("id").alias("query_id"), F.array(F.cos(F.col("id") % 2000).cast("float"), F.sin(F.col("id") % 2000).cast("float"), F.cos(F.col("id") % 2000 * 2).cast("float")).alias("vector"))
    found = vectors.vector_search(queries, corpus, 1)
    assert found.where(F.col("news_id") == (F.col("query_id") % 2000).cast("string")).count() == found.count() == 20_000
    assert found._jdf.queryExecution().executedPlan().toString().count("Range (0, 2000") == 1


@pytest.mark.parametrize("block_rows", [20, 60, 100_000])
def test_nearest_neighbours(spark, rows, block_rows):
    found = vectors.nearest_neighbours(frame(spark, rows), 4, block_rows=block_rows)
    want = plain([(n, v) for n, v in rows if v and n is not None], rows, 4, True)
    got = sorted((r.query_id, r.news_id, r["rank"]) for r in found.collect())
    assert [x for x in got if x[0] != 501] == want
    assert retrieval.similar_documents(None, frame(spark, []), 4).count() == 0


def test_index_on_groups_of_vectors(spark):
    """On vectors that form groups few cells are looked into, few rows scored exactly, and nine in ten of the nearest found; an index serves several searches."""
    r = np.random.default_rng(0)
    data = np.concatenate([c + r.normal(0, 0.25, (60, 32)) for c in r.normal(0, 1, (50, 32))])
    corpus = frame(spark, [(f"n{i}", [float(v) for v in x]) for i, x in enumerate(data)] + [("odd", [1.0]), ("none", None)], "string")
    index = ann.build_index(corpus)
    assert index.n == len(data) and index.width == 32 and index.nprobe <= 0.1 * index.cells
    queries = corpus.where("content_embedding is not null").select(F.col("news_id").alias("query_id"), F.col("content_embedding").alias("vector")).where("hash(query_id) % 40 = 0")
    exact = {(x.query_id, x.news_id) for x in vectors.vector_search(queries.where("size(vector) = 32"), corpus, 10).collect()}
    for k, part in ((10, exact), (1, None)):
        found = ann.search_index(index, queries, k, short=100)
        got = {(x.query_id, x.news_id): x.score for x in found.collect()}
        assert len(set(got) & exact) >= 0.9 * len(part or got)
    assert all(abs(s - 1) < 1e-6 for (q, n), s in got.items())


def test_index_of_few_none_and_equal_rows(spark):
    none = frame(spark, [])
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert ann.ann_search(queries, none, 3).count() == 0
    assert ann.search_index(ann.build_index(none), queries, 3).count() == 0
    equal = frame(spark, [(n, [1.0, 1.0]) for n in range(400)])
    found = ann.ann_search(queries, equal, 5).collect()
    assert len(found) == 5 and all(abs(r.score - 0.5**0.5) < 1e-6 for r in found)


def test_embedding_of_queries_and_one_encoder_a_worker(spark, tmp_path):
    made = str(tmp_path / "made")

    def encoder(width):
        with open(made, "a") as out:
            out.write("x")
        return lambda texts: [[float(len(t)), float(t.startswith("q: "))] + [0.0] * (width - 2) for t in texts]

    df = spark.createDataFrame([(n, "ab") for n in range(40)], "query_id long, query string").repartition(20)
    got = vectors.embed_queries(df, 4, encoder, prefix="q: ").collect()
    assert all(r.vector[1] > 0 for r in got) and len(got) == 40
    plain_form = vectors.embed_columns(df, {"vector": ("query", 4)}, encoder).collect()
    assert all(r.vector[1] == 0 for r in plain_form)
    # Not once for each of the 40 tasks; workers come and go, so there may be some.
    assert len(open(made).read()) < 40


def test_blocks_of_tags_bound_their_scores(spark, tmp_path):
    """Tags in groups: no score exceeds its block's bound, few blocks are within reach, and the result is that of all scores; by angle and by distance."""
    import numpy as np

    from gazeloom.operators import vectors as V

    r = np.random.default_rng(2)
    groups = r.normal(0, 1, (30, 16))
    tags = [(f"t{n:05d}", [float(x) for x in groups[n % 30] + r.normal(0, 0.05, 16)]) for n in range(9000)]
    rows = [(f"n{n:03d}", [float(x) for x in groups[n % 30] + r.normal(0, 0.05, 16)]) for n in range(40)] + [("zero", [0.0] * 16)]
    t = spark.createDataFrame(tags, "tag_id string, embedding array<float>")
    a = spark.createDataFrame(rows, "news_id string, content_embedding array<float>")
    x, y = (np.float32([v for _, v in part]).astype(np.float64) for part in (rows, tags))
    for similarity, threshold in (("cosine", 0.9), ("euclid", 0.5)):
        path = V.tag_blocks(t.selectExpr("tag_id AS query_id", "embedding AS vector"), similarity)
        reached = total = 0
        for row in spark.read.parquet(path).collect():
            part = np.frombuffer(row["data"], np.float64).reshape(-1, 16)
            real = V.scores(part, np.linalg.norm(part, axis=1), x, similarity).T.max(axis=1)
            bound = V.highest_scores(x, np.frombuffer(row["centre"], np.float64), row["radius"], similarity)
            assert (real <= bound).all()
            reached, total = reached + int((bound[:40] >= threshold).sum()), total + 40
        assert total >= 18 * 40 and reached < 0.35 * total
        near = V.scores(y, np.linalg.norm(y, axis=1), x, similarity).T
        want = [(rows[q][0], tags[c][0], k + 1) for q in range(len(rows)) for k, c in enumerate([c for c in np.lexsort((np.arange(len(tags)), -near[q])) if near[q, c] >= threshold][:5])]
        assert sorted(tuple(r) for r in V.match_tags(a, t, threshold, 5, similarity).select("news_id", "tag_id", "rank").collect()) == sorted(want)
