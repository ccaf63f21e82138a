"""Memory of a task does not follow the number of queries and cells."""

import tracemalloc

import numpy as np

from gazeloom.operators import ann as N
from gazeloom.operators import vectors as V


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_scores_of_a_block_are_one_matrix():
    r = np.random.default_rng(1)
    asked, rows = r.normal(size=(V.QUERY_BLOCK, 64)), r.normal(size=(V.ROW_BLOCK, 64))
    assert peak(lambda: V.best_places(V.scores(asked, np.linalg.norm(asked, axis=1), rows, "cosine"), 10)) < 60  # the matrix has 34 MB
    asked[0], rows[0], rows[1, 0] = 0, 0, np.nan
    found = V.scores(asked, np.linalg.norm(asked, axis=1), rows, "cosine")
    assert (found[0, [0, 2]] == 0).all() and found[1, 0] == 0 and np.isnan(found[1:, 1]).all() and abs(found[5, 7] - asked[5] @ rows[7] / np.linalg.norm(asked[5]) / np.linalg.norm(rows[7])) < 1e-12


def test_rows_meet_many_cells_in_stretches():
    r = np.random.default_rng(2)
    x, centres = r.normal(size=(9000, 16)), r.normal(size=(3000, 16))
    assert peak(lambda: N.nearest(x, centres)) < 30


def test_many_queries_and_cells(spark, monkeypatch):
    """Small stretches and lists give the same as large ones."""
    r = np.random.default_rng(3)
    corpus = spark.createDataFrame([(f"n{i}", [float(a) for a in v]) for i, v in enumerate(r.normal(size=(900, 8)).round(1))], "news_id string, content_embedding array<float>")
    queries = corpus.selectExpr("news_id as query_id", "content_embedding as vector").limit(300)
    want = sorted(map(tuple, N.ann_search(queries, corpus, 5).select("query_id", "news_id", "rank").collect()))
    assert len(want) == 1500
    for listed in (1, 40_000):
        monkeypatch.setattr(N, "LISTED", listed)
        monkeypatch.setattr(N, "CLOSE", 1000)
        monkeypatch.setattr(N, "PROBE_ROWS", 7)
        assert sorted(map(tuple, N.ann_search(queries, corpus, 5).select("query_id", "news_id", "rank").collect())) == want
