import random

import pytest
from pyspark.sql import functions as F

from gazeloom.operators import activity as A
from gazeloom.operators import adapt, dedup, ingest, reviews
from gazeloom.operators import conversations as C
from gazeloom.operators import discover as DI
from gazeloom.operators import vectors as V
from gazeloom.plans import serve_queries as Q
from gazeloom.plans.views import articles, incoming
from gazeloom.schemas import CRAWL

STORED = "news_id string, url string, publish_date string"


def classes(spark, new, stored):
    df = spark.createDataFrame(new, STORED)
    return [r["status"] for r in dedup.classify_incoming(df, spark.createDataFrame(stored, STORED)).orderBy("news_id", "url").collect()]


def test_classify_incoming(spark):
    assert classes(spark, [("1", "/1", "d"), ("2", "/2", "d")], []) == ["new", "new"]
    assert classes(spark, [("1", "/1", "d")], [("1", "/1", "d")]) == ["duplicate"]
    assert classes(spark, [("1", "/1", "e")], [("1", "/1", "d")]) == ["upsert"]
    assert classes(spark, [("1", "/a", "d")], [("1", "/a/", "d")]) == ["duplicate"]
    assert classes(spark, [("1", "/b", "d")], [("1", "/a", "d")]) == ["new"]
    assert classes(spark, [(None, "/b", "d"), ("1", "/a", None)], [("1", "/a", None)]) == ["new", "duplicate"]


def test_dedup_batch(spark):
    df = spark.createDataFrame([(2, "/1"), (1, "/1/"), (3, None), (4, "")], "seq int, url string")
    assert {r["seq"]: r["is_duplicate"] for r in dedup.dedup_batch(df).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_near_duplicates_as_one_by_one(spark):
    random.seed(5)
    base = [" ".join(random.choice("abcdefghij") * 3 + str(random.randint(0, 9)) for _ in range(30)) for _ in range(6)]
    rows = []
    for n in range(120):
        words = random.choice(base).split()
        for _ in range(random.randint(0, 3)):
            words[random.randrange(len(words))] = "zz" + str(random.randint(0, 5))
        rows.append((n, random.choice([None, "", " "]) if n % 17 == 0 else " ".join(words)))
    df = spark.createDataFrame(rows, "seq long, content_text string").repartition(5)
    found = {r["seq"]: (r["simhash"], r["is_near_duplicate"]) for r in dedup.near_duplicates(df).collect()}
    kept = []
    for n, text in rows:
        bits = found[n][0] & (1 << 64) - 1
        if not (text or "").strip():
            assert not found[n][1]
            continue
        near = any((bits ^ k).bit_count() <= 3 for k in kept)
        assert found[n][1] == near, n
        if not near:
            kept.append(bits)


def test_adapt_both_shapes(spark):
    rows = [
        {"id": "x1", "label": "通知", "title": "T", "date": "2024-01-02", "detail_url": "http://a/1", "is_page": True, "content": '{"text":"body","attachment_urls":["f.pdf"]}'},
        {"success": True, "url": "http://a/2", "title": None, "publish_date": "2024年1月3日", "author": "A", "content": "plain", "markdown": "# Head\ntext", "source": "site", "metadata": '{"word_count":5}'},
    ]
    out = {r["url"]: r for r in adapt.adapt_crawl(spark.createDataFrame([{f.name: r.get(f.name) for f in CRAWL.fields} for r in rows], CRAWL)).collect()}
    a, b = out["http://a/1"], out["http://a/2"]
    assert (a["news_id"], a["content_text"], a["attachments"], a["tags"]) == ("x1", "body", ["f.pdf"], ["通知"])
    assert str(a["publish_date"]) == "2024-01-02 00:00:00"
    assert (b["title"], b["source_site"], b["content_markdown"], len(b["news_id"])) == ("Head", "site", "# Head\ntext", 16)
    assert '"word_count":"5"' in b["metadata"]


def test_ingest_twice_gives_duplicates(spark, sf_dir):
    stored = articles(spark, sf_dir).drop("doc_id")
    raw = incoming(spark, sf_dir).drop("doc_id")
    first = ingest.ingest(raw, stored.limit(0))
    counts = ingest.ingest_summary(first["statuses"]).first().asDict()
    assert counts["total"] == raw.count() == sum(v for k, v in counts.items() if k != "total")
    again = ingest.ingest(first["articles"].drop("status", "message"), first["table"])
    second = ingest.ingest_summary(again["statuses"]).first()
    assert second["success"] == second["upsert"] == 0
    mixed = ingest.ingest(raw.repartition(7), stored.limit(0))
    assert ingest.ingest_summary(mixed["statuses"]).first().asDict() == counts


def test_upsert_is_idempotent(spark):
    stored = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "news_id string, v int, crawl_version int")
    new = spark.createDataFrame([("b", 3, 1), ("c", 4, 1)], "news_id string, v int, crawl_version int")
    once = dedup.upsert(stored, new)
    assert sorted(once.collect()) == sorted(dedup.upsert(once, new).collect()) == [("a", 1, 1), ("b", 3, 1), ("c", 4, 1)]
    assert sorted(dedup.upsert(stored, new, mode="update", bump=True, from_stored=True).collect()) == [("a", 1, 1), ("b", 3, 2)]
    with pytest.raises(ValueError):
        dedup.upsert(stored, new, mode="x")


def test_safe_filter_refuses_fields(spark, sf_dir):
    with pytest.raises(ValueError):
        adapt.safe_filter(articles(spark, sf_dir), {"text; drop": 1})


def test_incremental_twice_is_empty(spark):
    found = spark.createDataFrame([("l", "u1"), ("l", "u2"), ("l", "u1")], "list_url string, url string")
    new, seen = DI.incremental_urls(found, found.limit(0))
    assert new.count() == 2
    assert DI.incremental_urls(found, seen)[0].count() == 0


def test_vector_identities(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, -1.0, 0.0]


def test_ann_recall(spark, sf_dir):
    exact = {(r["query_id"], r["news_id"]) for r in Q.nearest(spark, sf_dir).collect()}
    near = {(r["query_id"], r["news_id"]) for r in Q.approximate(spark, sf_dir).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_match_tags_limits(spark):
    a = spark.createDataFrame([("n", [1.0, 0.0]), ("w", [1.0]), ("z", None)], "news_id string, content_embedding array<float>")
    t = spark.createDataFrame([(f"t{k}", [1.0, k / 10]) for k in range(8)], "tag_id string, embedding array<float>")
    assert [r["tag_id"] for r in V.match_tags(a, t).orderBy("rank").collect()] == ["t0", "t1", "t2", "t3", "t4"]


def test_reviews(spark):
    subs = spark.createDataFrame([("s1", "l", "title one", "2024-01-01", None, True, "long enough text", ["f"], "u", "", "pending", 1), ("s2", "l", "title", "2024-01-01", None, True, "x", [], "u", "", "pending", 2), ("s3", "l", "t", "d", None, True, "text of it", [], "u", "", "pending", 3)], "submission_id string, label string, title string, date string, detail_url string, is_page boolean, content_text string, attachment_urls array<string>, submitter_id string, review string, status string, seq int")
    dec = spark.createDataFrame([("s1", "rejected", "no", 1), ("s1", "approved", "yes", 2), ("s2", "approved", "yes", 1), ("s3", "odd", "", 1)], "submission_id string, action string, review string, seq int")
    stored = spark.createDataFrame([], "news_id string, url string, title string, publish_date timestamp, content_text string")
    done = reviews.apply_reviews(subs, dec, stored)
    assert {r["submission_id"]: r["status"] for r in done["submissions"].collect()} == {"s1": "approved", "s2": "pending", "s3": "pending"}
    assert [r["id"] for r in done["notices"].collect()] == ["s1"]


def test_admission_with_bound_devices(spark):
    keys = spark.createDataFrame([("k", True, 2, ["old"]), ("off", False, None, None)], "key string, is_active boolean, max_devices int, bound array<string>")
    events = spark.createDataFrame([(1, "k", "a", 1), (2, "k", "b", 2), (3, "k", "old", 3), (4, "off", "a", 1), (5, "no", "a", 1), (6, "k", "a", 4)], "event_id int, key string, device string, ts int")
    out = {r["event_id"]: r["outcome"] for r in A.admission_replay(events, keys).collect()}
    assert out == {1: "accepted", 2: "device_limit", 3: "accepted", 4: "inactive_key", 5: "unknown_key", 6: "accepted"}


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("lost\n[t1] [INFO] [m] [p] - one\nmore\n[t2] [ERROR] [n] [q] - two\n")
    from gazeloom.sources.crawl import read_app_logs

    rows = sorted((r["ts"], r["message"]) for r in A.parse_logs(read_app_logs(spark, str(tmp_path))).collect())
    assert rows == [("t1", "one\nmore"), ("t2", "two")]


def test_budget(spark):
    conv = spark.createDataFrame([(1, n, "u", "x" * 9) for n in range(8)], "conv_id int, turn int, role string, text string")
    assert sorted(r["turn"] for r in C.trim_by_budget(conv, 25).collect()) == [6, 7]
    assert sorted(r["turn"] for r in C.trim_by_budget(conv, 3).collect()) == [7]
    assert sorted(r["turn"] for r in C.trim_by_budget(conv, 0).collect()) == [2, 3, 4, 5, 6, 7]


def test_order_of_rows_does_not_matter(spark, sf_dir):
    raw = incoming(spark, sf_dir)
    rows = lambda df: sorted(map(tuple, dedup.dedup_batch(df).select("seq", "is_duplicate").collect()))
    assert rows(raw) == rows(raw.repartition(9).orderBy(F.rand(3)))
