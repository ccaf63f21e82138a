"""Keyword search looks at every hit: one that matches is found however many better ones don't."""

import duckdb
import pytest

from gazeloom.plans import registry


@pytest.mark.parametrize("name", ["keyword_search_all", "keyword_search_phrase"])
def test_a_match_behind_many_hits(spark, tmp_path, name):
    """Of 41 documents that hold words of the query 40 rank higher, without holding both of them or the phrase."""
    texts = ["red red red red sky"] * 20 + ["blue blue blue blue sky"] * 20 + ["a long text " + "of many other words " * 50 + "in which red blue stands at the end"]
    spark.createDataFrame([(n, text, "en", "s") for n, text in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "red blue"), (2, "RED")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    found = sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))
    assert [r[1] for r in found if r[0] == 1] == ["doc_40"] and len(found) == 6
    assert [r[:2] for r in found] == sorted(r[:2] for r in con.execute(registry.ORACLE_SQL[name]).fetchall())
