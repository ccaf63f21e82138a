"""The SQL of the page queries where a title is cut off within an entity."""

import duckdb
import pytest

from gazeloom.plans import registry

TITLES = ["a &amp; b", "cut &amp", "cut &lt", "cut &am", "cut &", "&amp;lt; &quot;q&quot", "&amp;amp"]


@pytest.mark.parametrize("name", ["complex_tables", "page_metadata", "strip_html"])
def test_cut_entity(spark, tmp_path, name):
    rows = [(n, f"https://h/{n}", f"<html><head><title>{t}</title></head><body><p>{t}</p></body></html>") for n, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = duckdb.connect()
    found.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = found.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).select(columns).collect())) == sorted(want.fetchall())
