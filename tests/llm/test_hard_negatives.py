"""Operator 12 against brute force."""

import math

import numpy as np
import pytest

from gazeloom.llm import hard_negatives
from gazeloom.llm.registry import ORACLE_SQL, QUERIES


def brute(rows, anchor_ids, k=5, more=5, low=80, high=100, scale=256):
    whole = [(i, label, [math.floor(scale * float(x)) for x in v]) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    firsts = {}
    for i, label, v in sorted(whole, key=lambda r: (r[0], r[1], r[2])):
        firsts.setdefault(i, (label, v))
    out = []
    for a in anchor_ids:
        if a not in firsts:
            continue
        label, u = firsts[a]
        scored = sorted((-sum(x * y for x, y in zip(u, v, strict=True)), i, other) for i, other, v in whole if i != a and len(v) == len(u))
        for ps, p, _ in [x for x in scored if x[2] == label][:k]:
            near = [x for x in scored if x[2] != label and low * -ps <= 100 * -x[0] <= high * -ps][:more]
            out += [(a, p, n + 1, i, -ps, -s) for n, (s, i, _) in enumerate(near)]
    return sorted(out)


def mined(df, where, **more):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, hard_negatives.mine_hard_negatives(df, df.where(where), **more).select(*columns).collect()))


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("settings", [{}, {"range_rows": 16, "block_rows": 3, "clusters": 4}, {"low": 50, "n_positives": 2, "n_negatives": 3, "range_rows": 100}])
def test_hard_negatives(spark, settings):
    """Ties, repeated scores, a label with a third of all rows, null and odd rows, other widths, columns of clashing names."""
    r = np.random.default_rng(2)
    rows = [(n, [float(x) for x in np.round(r.normal(0.1, 0.2, 6), 1)], int(r.integers(0, 6)) if n % 3 else 9) for n in range(300)]
    rows += [(n, [0.5] * 6, n % 2) for n in range(400, 440)]
    rows += [(500, None, 1), (510, [None] * 6, 1), (520, [float("nan")] * 6, 1), (530, [0.1] * 6, None), (540, [float("-inf")] * 6, 2), (None, [0.1] * 6, 1), (550, [1.0], 1), (551, [1.0], 1), (552, [0.9], 2), (560, [0.0] * 6, 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as dim", "2 as cluster", "3 as no", "4 as v", "5 as rank", "6 as score0")
    names = {"n_positives": "k", "n_negatives": "more", "low": "low"}
    want = brute(rows, [i for i, *_ in rows if i is not None and i % 10 == 0], **{names[k]: v for k, v in settings.items() if k in names})
    assert mined(df, "vec_id % 10 = 0", **settings) == want and len(want) > 50


def test_few_none_and_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1), (2, [1.75], 2), (3, [3.0], 2), (4, [-1.0], 1)], SCHEMA)
    # Positives of 0: 1 and 4; of 4: 0 and 1, of scores below 0.
    assert mined(df, "vec_id in (0, 4)") == [(0, 1, 1, 2, 131072, 114688)]
    assert mined(df.limit(0), "vec_id = 0") == [] and mined(df, "vec_id = 9") == []
    one = df.where("label = 1")
    assert mined(one, "vec_id = 0") == []
    twice = df.unionAll(df.where("vec_id = 2")).unionAll(spark.createDataFrame([(0, [5.0], 7)], SCHEMA))
    assert mined(twice, "vec_id = 0") == [(0, 1, 1, 2, 131072, 114688), (0, 1, 2, 2, 131072, 114688)]


def test_equal_and_negative_shares(spark):
    df = spark.createDataFrame([(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2), (3, [0.5], 2)], SCHEMA)
    assert mined(df, "vec_id = 0", low=100) == [(0, 1, 1, 2, -65536, -65536)]
    assert mined(df, "vec_id = 0") == []
    with pytest.raises(ValueError):
        mined(df, "vec_id = 0", low=101)


def test_very_large_components(spark):
    df = spark.createDataFrame([(0, [2.0**22, 1.0], 1), (1, [2.0**22, 2.0], 1), (2, [2.0**22 - 1, 3.0], 2), (3, [2.0**22, 1.0], 2)], SCHEMA)
    rows = [tuple(x) for x in df.collect()]
    assert mined(df, "vec_id = 0") == brute(rows, [0]) != []
    wide = spark.createDataFrame([(0, [2.0**40], 1), (1, [2.0**40], 1)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        mined(wide, "vec_id = 0")


def test_walks_end_early_and_right():
    """On vectors that form groups most of a list is never scored; results are those of all scores."""
    r = np.random.default_rng(1)
    centres = r.normal(0, 60, (40, 16))
    data = np.concatenate([c + r.normal(0, 4, (200, 16)) for c in centres]).astype(np.int64)
    labels = r.integers(0, 3, len(data))
    ids = np.arange(len(data))
    seen = [0, 0]
    for c in range(0, 40, 5):
        own = np.arange(c * 200, c * 200 + 50)
        none = np.full((50, 1), -(1 << 63) + 1)
        m, _, names, scores, (scored, present) = hard_negatives.walk(ids, labels, data, own, labels[own], data[own], True, none, -none, 5, 128)
        seen = [seen[0] + scored, seen[1] + present]
        for k in range(0, 50, 7):
            full = data[own[k]] @ data.T
            best = sorted((-full[i], i) for i in ids if labels[i] == labels[own[k]] and i != own[k])[:5]
            assert [(-s, n) for s, n in zip(scores[m == k], names[m == k], strict=True)] == best
    assert seen[0] < 0.2 * seen[1]


def test_query_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op12_hard_negatives"]).fetchall())
    got = QUERIES["op12_hard_negatives"](spark, sf_dir).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got)) == want and want
