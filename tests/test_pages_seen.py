"""Deep pages by a range index, and the two-tier set of links that a stream has had."""

import glob

import pytest
from pyspark.sql import functions as F

from gazeloom.operators import pages as P
from gazeloom.streaming import seen as N


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_indexed_pages_equal_sorted_ones(spark, tmp_path):
    """A third of the rows share a date, some have none, and the label is null for some."""
    n = F.col("id")
    df = spark.range(3000).select(
        F.concat(F.lit("n"), n.cast("string")).alias("id"), F.when(n % 3 == 0, "2024-05-05").when(n % 7 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")), "yyyy-MM-dd")).alias("date"),
        F.when(n % 4 != 0, F.concat(F.lit("l"), (n % 4).cast("string"))).alias("label"), F.when(n % 2 == 0, F.lit(5)).alias("updated_at"), F.lit("x").alias("range_"),
    )
    index = P.index_pages(df, "notices", f"file://{tmp_path}/i", 100)
    assert len(glob.glob(f"{tmp_path}/i/rows/range=*")) > 20
    for page, size, value in ((1, 20, None), (0, 7, None), (75, 20, None), (150, 20, None), (151, 20, None), (2, 50, "l3"), (15, 50, "l3"), (1, 5, "none")):
        (got, n1), (want, n2) = index.page(spark, page, size, value), P.page_of(df, "notices", page, size, value)
        assert rows(got) == rows(want) and rows(n1) == rows(n2)


def test_a_deep_page_reads_its_ranges_alone(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id"), F.current_timestamp().alias("created_at"), (F.col("id") % 2 == 0).alias("is_active"))
    index = P.index_pages(df, "users", f"file://{tmp_path}/i", 1000)
    page, total = index.page(spark, 900, 20)
    assert [r[0] for r in rows(page)] == list(range(20_000 - 899 * 20 - 1, 20_000 - 900 * 20 - 1, -1))
    assert rows(total) == [(20_000,)]
    assert len({f.split("/rows/")[1].split("/")[0] for f in page.inputFiles()}) <= 2


def test_keys_count_all_owners_and_empty_lists(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", "y", 2), ("d", None, None)], "key string, owner string, created_at int")
    index = P.index_pages(df, "keys", f"file://{tmp_path}/i", 2)
    for value, want in (("x", ["b", "a"]), ("", ["c", "b", "a", "d"]), (None, ["c", "b", "a", "d"])):
        for page, total in (index.page(spark, 1, 10, value), P.page_of(df, "keys", 1, 10, value)):
            assert [r[0] for r in rows(page)] == want and rows(total) == [(4,)]
    empty = P.index_pages(df.where("false"), "keys", f"file://{tmp_path}/e")
    assert rows(empty.page(spark, 3, 10)[0]) == [] and rows(empty.page(spark, 1, 10)[1]) == [(0,)]


def test_links_come_once_over_many_batches(spark, tmp_path, monkeypatch):
    """Joined spans, batches that run again, filters that grow and know links that aren't there, nulls and an empty batch."""
    monkeypatch.setattr(N, "SPANS", 3)
    table, had = f"file://{tmp_path}/t", set()
    for number in range(10):
        links = [(f"l{i % 3}", f"u{(number * 13 + i * 7) % 90}") for i in range(30)] + [(None, "u1"), ("u1", None), (None, None)]
        links = [] if number == 4 else links + links[:5]
        df = spark.createDataFrame(links, N.LINKS)
        for _ in range(2 if number in (3, 9) else 1):
            fresh = [tuple(r) for r in N.add_links(df, table, number, parts=4).collect()]
            assert len(fresh) == len(set(fresh)) and set(fresh) == set(links) - had
        had |= set(links)
    assert N.spans(spark, table) == [(0, 8), (9, 9)]
    assert sorted(glob.glob(f"{tmp_path}/t/links/span=*")) == [f"{tmp_path}/t/links/span=0-8", f"{tmp_path}/t/links/span=9-9"]
    stored = [tuple(r) for r in N.seen_links(spark, table).collect()]
    assert len(stored) == len(had) and set(stored) == had


def test_filters_miss_no_link_and_grow():
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(1)
    a, b = (r.integers(-(2**63), 2**63 - 1, 300_000) for _ in "ab")
    links = pd.DataFrame({"h": a, "g": b})
    filters = N.added((0,), links[:50_000], pd.DataFrame({"part": [], "level": [], "n": [], "bits": []}))
    filters = N.added((0,), links[50_000:250_000], filters)
    assert list(filters.n) == [65_536, 131_072, 53_392]
    told = N.known(links, filters).maybe
    assert told[:250_000].all() and told[250_000:].mean() < 0.03


@pytest.mark.parametrize("batches", [6])
def test_state_forgets_and_the_stored_set_does_not(spark, tmp_path, batches):
    source, table = f"file://{tmp_path}/in", f"file://{tmp_path}/t"
    for k in range(batches):
        one = spark.range(k * 200, k * 200 + 200).selectExpr("'l' AS list_url", "concat('u', id) AS url")
        one.union(spark.range(50).selectExpr("'l'", "concat('u', id)")).coalesce(1).write.mode("append").parquet(source)
    got = []
    stream = spark.readStream.schema(N.LINKS).option("maxFilesPerTrigger", 1).parquet(source)
    query = N.stream_seen_urls(stream, table, f"file://{tmp_path}/state", "1 millisecond", lambda df, n: got.append((n, df.count())), parts=4)
    query.awaitTermination()
    assert sum(n for _, n in got) == batches * 200 == N.seen_links(spark, table).count()
    states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert max(states) <= 2 * 250
