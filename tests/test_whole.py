"""Queries over whole inputs, against plain versions where SQL cannot follow."""

import hashlib
import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gazeloom.plans import registry
from gazeloom.plans import serve_queries as Q

RUN = registry.QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents whose words stand beside marks, and benchmark items with marks in their first words."""
    out = str(tmp_path_factory.mktemp("whole"))
    texts = ["a-b c. d", "a-bc c.d", "xa-b_ (c.) d!", "don't stop. now", "dont stop now", "é1 caf\u00e9 x", "caf\u00e9s \u00e91x", None, "", "c. c."]
    asked = {3: "a-b c. d more", 11: "don't stop. now", 25: "caf\u00e9 \u00e91 x"}
    docs = spark.createDataFrame([(k, t, "en", f"src{k}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(k, [1.0, k / 1000], 0) for k in range(0, 201, 25)], "vec_id long, embedding array<float>, label long").write.parquet(f"{out}/embeddings.parquet")
    return out, texts, asked


def test_simple_text_search_with_marks(spark, folder):
    out, texts, asked = folder

    def weigh(term, text):
        if term not in text:
            return 0.0
        return 2.0 if text == term else 1.5 if re.search(rf"\b{re.escape(term)}\b", text) else 1.0

    expected = []
    for q, text in asked.items():
        terms = text.lower().split()
        scores = [(-sum(weigh(t, (f or "").lower()) for t in terms for f in ((x or "")[:60], x, f"src{k}", "en")), f"doc_{k}") for k, x in enumerate(texts)]
        expected += [(q, n, -s) for s, n in sorted(scores)[:5] if s]
    assert sorted(map(tuple, RUN["simple_text_search"](spark, out).collect())) == sorted(expected)


def test_every_query_row(spark, folder):
    out, _, asked = folder
    for name in ("vector_search", "ann_search", "search_results"):
        assert {r["query_id"] for r in RUN[name](spark, out).select("query_id").collect()} == {0, 50, 100, 150, 200}, name
    assert {r["query_id"] for r in RUN["rag_context"](spark, out).collect()} == {0, 50, 100, 150, 200, -1, -151}
    for name in ("hybrid_search", "advanced_search"):
        assert {r["query_id"] for r in RUN[name](spark, out).select("query_id").collect()} == set(asked), name


def test_ann_recall_of_a_growing_share(spark):
    exact, near = ({(r["query_id"], r["news_id"]) for r in RUN[n](spark, "/root/testdata/sf0.01").collect()} for n in ("vector_search", "ann_search"))
    assert len({q for q, _ in exact}) == 10
    assert len(exact & near) >= 0.9 * len(exact)


MARKED = [
    (0, "&amp; plain &lt;b&gt; text", None),
    (1, "# Head\n\nsome **bold** [word](http://l)\n- item", "Head some bold word item"),
    (2, "e\u0301t\u00e9 &eacute;&nbsp;&#65;\r\nx", None),
    (3, "plain   words\n\nand _more_", "plain words and more"),
    (5, "> quote\n1. one", "quote one"),
    (7, "", ""),
]


@pytest.fixture(scope="module")
def marked(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("marked"))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t, _ in MARKED], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{out}/documents.parquet")
    return out


def test_clean_text_decodes_every_document(spark, marked):
    found = {r["doc_id"]: r["clean_md5"] for r in RUN["clean_text"](spark, marked).collect()}
    plain = lambda t: " ".join(html.unescape(unicodedata.normalize("NFC", f"& {t} &lt;x&gt;")).split())
    assert found == {k: hashlib.md5(plain(t).encode()).hexdigest() for k, t, _ in MARKED}


def test_normalize_records_derives_text_from_markdown(spark, marked):
    found = {r["news_id"]: r for r in RUN["normalize_records"](spark, marked).collect()}
    assert len(found) == len(MARKED)
    for k, text, derived in MARKED:
        assert found[f"doc_{k}"]["text_md5"] == hashlib.md5((text if k % 2 == 0 else derived).encode()).hexdigest(), k
        assert found[f"doc_{k}"]["crawl_version"] == (1 if k % 4 == 0 else 1 + k % 3)


def test_long_and_odd_texts(spark, tmp_path):
    texts = ["a" * 199 + "\u00e9" + "b" * 5000, 'say "x" \\ {"a": [1]}\n\ttab ' * 30, "\U0001f600 \u2028 " * 200, "c" * 10_000, "d" * 10_001, "plain text of it"]
    out = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    back = {r["news_id"]: r["text_md5"] for r in RUN["read_crawl_json"](spark, out).collect()}
    assert back == {f"c{k}": hashlib.md5(t.encode()).hexdigest() for k, t in enumerate(texts)}
    numbers = {r["seq"]: r["submission_id"] for r in RUN["submission_ids"](spark, out).collect()}
    assert sorted(numbers) == [0, 1, 2, 3, 5]
    status = {r["submission_id"]: r["status"] for r in RUN["apply_reviews"](spark, out).collect()}
    assert {k: status[i] for k, i in numbers.items()} == {0: "approved", 1: "approved", 2: "approved", 3: "approved", 5: "pending"}


def test_rules_read_the_texts(spark, tmp_path):
    out = str(tmp_path)
    docs = [(0, "近3天的通知"), (1, "line\n【通知】About it\nrest"), (2, "于5月28日举行。more"), (3, None), (4, "\n# Title of it")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(7, "近 2 周 count")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(1, 2, "user", "链接 真伪")], "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    titles = {r["doc_id"]: (r["title"], r["date"]) for r in RUN["title_from_content"](spark, out).collect()}
    assert titles == {0: ("近3天的通知", ""), 1: ("About it", ""), 2: ("于5月28日举行", "5月28日"), 3: ("", ""), 4: ("Title of it", "")}
    kinds = {(r["kind"], r["id"], r["turn"]): r["intent"] for r in RUN["classify_queries"](spark, out).collect()}
    assert len(kinds) == 7
    assert (kinds["documents", 0, None], kinds["benchmark", 7, None], kinds["conversations", 1, 2]) == ("fuzzy_qa", "statistics", "link_verification")
    times = {(r["kind"], r["id"]): r["start_date"] for r in RUN["infer_time_window"](spark, out).collect()}
    assert (times["documents", 0], times["benchmark", 7], times["conversations", 1]) == ("2024-01-30T00:00:00", "2024-01-19T00:00:00", None)


def test_tags_grow_with_the_table(spark):
    count = lambda sf: sum(r["n"] for r in RUN["count_by_category"](spark, f"/root/testdata/{sf}").collect())
    assert (count("sf0.01"), count("sf0.1")) == (10, 40)
