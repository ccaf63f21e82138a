"""White space, nulls, orders, faults and parameters of the library's operators, on small tables."""

import pytest
from pyspark.sql import functions as F

from gazeloom.functions import text as X
from gazeloom.operators import activity, conversations, ingest, listing, retrieval, vectors
from gazeloom.operators import adapt as A


SPACES = ["\t\n", " \r\n ", " 　", "\x1c", ""]


def test_white_space_of_every_kind(spark):
    rows = [(n, f"{s}x y{s}", s) for n, s in enumerate(SPACES)]
    df = spark.createDataFrame(rows, "n int, text string, blank string")
    for r in df.select("text", "blank", X.strip(F.col("text")).alias("s"), X.blank(F.col("blank")).alias("b"), X.blank(F.col("text")).alias("t"), X.normalize_url(F.concat(F.lit("HTTP://h/a/"), "blank")).alias("u")).collect():
        assert (r["s"], r["b"], r["t"], r["u"]) == (r["text"].strip(), True, False, "http://h/a")
    assert spark.range(1).select(X.blank(F.lit(None).cast("string")).alias("b")).first()["b"] is None


def test_blank_documents_are_not_valid(spark):
    rows = [("a", "\t\n", "http://h/1", "\n" * 20), ("b", "t", "http://h/2", "long enough text"), ("\x1c\n", "t", "http://h/3", "long enough text")]
    found = [list(r["errors"]) for r in A.validate_documents(spark.createDataFrame(rows, "news_id string, title string, url string, content_text string")).orderBy("url").collect()]
    assert found == [["missing:title", "content:blank"], [], ["missing:news_id"]]


def test_null_device_counts_as_a_device(spark):
    events = spark.createDataFrame([(1, "k", None, 1), (2, "k", None, 2), (3, "k", "a", 3), (4, None, "a", 4), (5, None, None, 5)], "event_id long, key string, device string, ts long")
    keys = spark.createDataFrame([("k", True, 1, None)], "key string, is_active boolean, max_devices int, bound array<string>")
    found = {r["event_id"]: r["outcome"] for r in activity.admission_replay(events, keys).collect()}
    assert found == {1: "accepted", 2: "accepted", 3: "device_limit", 4: "unknown_key", 5: "unknown_key"}


def test_logs_over_blocks(spark):
    """Lines before a block's first header belong to the last header of earlier blocks; those before the file's first go."""
    head = lambda n: f"[2024-01-01 00:00:{n:02d}] [INFO] [m] [f:1] - event {n}"
    lines = [(0, 0, "lost"), (0, 1, head(1)), (0, 2, "a"), (100, 3, "b"), (200, 4, "c"), (200, 5, head(2)), (300, 6, "d"), (300, 7, head(3))]
    rows = [("f", (block, n), v) for block, n, v in lines] + [("g", (0, 8), head(9)), ("g", (0, 9), "e"), ("h", (0, 10), "never")]
    df = spark.createDataFrame(rows, "file string, line_no struct<block: long, n: long>, value string").repartition(5)
    found = [(r["file"], r["message"]) for r in activity.newest_logs(activity.parse_logs(df)).collect()]
    assert found == [("g", "event 9\ne"), ("f", "event 3"), ("f", "event 2\nd"), ("f", "event 1\na\nb\nc")]


def test_devices_and_modules_in_order(spark):
    df = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 5, 2), (1, "a", 3, 3), (2, "c", 1, 4)], "user_id long, device string, ts long, event_id long")
    assert [(r["user_id"], r["device"], r["logins"]) for r in activity.latest_devices(df).collect()] == [(1, "b", 1), (1, "a", 2), (2, "c", 1)]
    assert [r["module"] for r in activity.log_modules(spark.createDataFrame([("z",), ("a",), ("z",)], "module string")).collect()] == ["a", "z"]


def test_statistics_name_the_sources(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, None)], "source_site string, publish_date timestamp")
    r = listing.corpus_stats(df).first()
    assert (r["total"], r["sources"], r["distribution"]) == (3, 1, {"a": 2, "未知": 1})
    assert listing.corpus_stats(df.limit(0)).first()["total"] == 0


def test_observations_cost_their_json(spark):
    import json

    rows = [(1, n, "tool", t) for n, t in enumerate(["x" * 30, 'say "y"\n', None, "知道", "/a/b"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    costs = {r["turn"]: r["c"] for r in df.select("turn", conversations.observation_cost("turn", "role", "text").alias("c")).collect()}
    assert costs == {n: len(json.dumps({"turn": n, "role": a, "text": t}, ensure_ascii=False)) for _, n, a, t in rows}
    kept = conversations.trim_by_budget(df, costs[4] + costs[3], conversations.observation_cost("turn", "role", "text"))
    assert sorted(r["turn"] for r in kept.collect()) == [3, 4]


def test_crawl_fields_and_defaults_of_the_caller(spark):
    from gazeloom.schemas import CRAWL

    df = spark.createDataFrame([{"id": "1", "title": "t", "url": "http://h", "content": "body"}], CRAWL).selectExpr("*", "'Head' as headline", "cast(null as string) as site")
    r = A.adapt_crawl(df, mapping={"headline": "title", "site": "source"}, defaults={"author": "nobody", "crawl_version": 7}).first()
    assert (r["title"], r["author"], r["source_site"], r["crawl_version"]) == ("Head", "nobody", "未知来源", 1)


def test_tags_by_name(spark):
    tags = spark.createDataFrame([("1", "sports news"), ("2", "news"), ("3", "weather"), ("4", None)], "tag_id string, name string")
    assert [r["tag_id"] for r in vectors.find_tags(tags, "NEWS today").orderBy("rank").collect()] == ["2", "1"]
    assert vectors.find_tags(tags, "").count() == 0


def test_many_tags(spark):
    """Tags in several blocks, of two widths, with ties: the best of each row are those of all scores."""
    import numpy as np

    r = np.random.default_rng(5)
    tags = [(f"t{n:04d}", [float(x) for x in np.round(r.normal(0, 1, 4), 1)]) for n in range(1500)] + [(f"u{n}", [1.0, 2.0, 2.0, 1.0]) for n in range(20)] + [("w1", [1.0]), ("w2", [2.0]), ("none", None), (None, [1.0] * 4)]
    rows = [(f"n{n}", [float(x) for x in np.round(r.normal(0, 1, 4), 1)]) for n in range(50)] + [("tied", [1.0, 2.0, 2.0, 1.0]), ("one", [3.0]), ("zero", [0.0] * 4), ("null", None)]
    found = vectors.match_tags(spark.createDataFrame(rows, "news_id string, content_embedding array<float>"), spark.createDataFrame(tags, "tag_id string, embedding array<double>"), 0.6, 5)
    want = []
    for name, v in rows:
        u = np.float32(v or []).astype(float)
        near = [(-round(float(u @ np.float32(t).astype(float) / np.linalg.norm(u) / np.linalg.norm(np.float32(t).astype(float))), 9), i) for i, t in tags if t and i and len(t) == len(u) and np.linalg.norm(u) > 0]
        want += [(name, i, k) for k, (s, i) in enumerate(sorted(x for x in near if -x[0] >= 0.6)[:5], 1)]
    assert sorted(tuple(x) for x in found.select("news_id", "tag_id", "rank").collect()) == sorted(want)
    assert vectors.match_tags(spark.createDataFrame(rows, "news_id string, content_embedding array<float>"), spark.createDataFrame([], "tag_id string, embedding array<double>")).count() == 0


def test_failed_batches_are_counted(spark):
    def broken(width):
        def encode(texts):
            raise RuntimeError("no model")

        return encode

    failures = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([("a",), ("b",), (" ",)], "t string")
    assert vectors.embed_columns(df, {"v": ("t", 4)}, broken, failures=failures).where("v[0] = 0").count() in (0, 3)
    vectors.embed_columns(df, {"v": ("t", 4)}, broken, failures=failures).collect()
    assert failures.value >= 2


def test_hits_beyond_the_first(spark):
    """With complete every hit is looked at, not the best 3 * k alone."""
    docs = spark.createDataFrame([(f"d{n:02d}", "", "red " * (30 - n) + ("blue" if n == 29 else "")) for n in range(30)], "news_id string, title string, content_text string")
    asked = spark.createDataFrame([(1, "red blue")], "query_id int, query string")
    only = spark.createDataFrame([(2, "red")], "query_id int, query string")
    found = retrieval.keyword_search(asked, docs, 1, "all", complete=True).collect()
    assert [r["news_id"] for r in found] == ["d29"]
    assert retrieval.keyword_search(only, docs, 100, "all", complete=True).count() == 30


def test_a_writer_that_fails(spark):
    raw = spark.createDataFrame([("a", "t", "http://h/1", None, "long enough text", 1), ("b", " ", "http://h/2", None, "long enough text", 2)], "news_id string, title string, url string, publish_date timestamp, content_text string, seq long")
    raw = raw.selectExpr("*", "content_text as content_markdown", "array('x') as attachments", "1 as crawl_version", "cast(null as string) as metadata", "array('t') as tags", "'s' as source_site")
    stored = raw.drop("seq").limit(0)

    def fails(table):
        raise OSError("disk full")

    done = ingest.ingest(raw, stored, write=fails)
    assert {(r["seq"], r["status"], r["message"]) for r in done["statuses"].collect()} == {(1, "error", "disk full"), (2, "invalid", "missing:title")}
    assert ingest.ingest_summary(done["statuses"]).first()["error"] == 1
    assert {r["status"] for r in ingest.ingest(raw, stored, write=lambda t: t.collect())["statuses"].collect()} == {"success", "invalid"}
    assert {r["status"] for r in ingest.statuses(raw, raw.drop("seq"), dedup=False).collect()} == {"success", "invalid"}


def test_selectors_of_the_caller(spark):
    from gazeloom.operators.discover import page_metadata

    pages = spark.createDataFrame([('<h2 class="my-head big">A  b</h2><i class="when">May</i><title>T</title>',)], "html string")
    r = page_metadata(pages, title=("[class*=head]",), date=(".when",), author=("u",)).first()
    assert (r["title"], r["date"], r["author"]) == ("A b", "May", "")


def test_no_local_folder_on_a_cluster(monkeypatch):
    from gazeloom import staging

    class Empty:
        def isDefined(self):
            return False

    class Fake:
        """A session on a cluster without a shared folder."""

        conf = {}
        master = "spark://host:7077"
        sparkContext = property(lambda self: self)
        _jsc = property(lambda self: self)

        def getConf(self):
            return {}

        def sc(self):
            return self

        def getCheckpointDir(self):
            return Empty()

    with pytest.raises(ValueError, match="checkpoint"):
        staging.shared_dir(Fake())


def test_markdown_repair_by_lines(spark):
    cases = {"a\n\t\nb": "a\n\nb", "a\n\n\n\nb": "a\n\nb", "a\n---\n\n: -\nb": "a\n\nb", "a\nb": "a\n\nb", "x|y\nz": "x|y\n\nz", "a|-\n|b-": "|a|-|\n|b-|", "# h\nt\n- [l](u)\nt": "# h\n\nt\n- [l](u)\n\nt", "![i](u)\nt": "![i](u)\nt", "": ""}
    df = spark.createDataFrame(list(cases.items()), "md string, want string")
    for r in df.select("md", "want", X.repair_markdown(F.col("md")).alias("got")).collect():
        assert r["got"] == r["want"], r["md"]


def test_idle_keys_are_forgotten(spark, tmp_path):
    """A key that is idle for long has its devices free again when its next request comes, and no state of it stays."""
    import time

    from gazeloom.streaming import streams

    def feed(event_id, key, device):
        spark.createDataFrame([(key, event_id, device, event_id, True, 1)], "key string, event_id long, device string, ts long, is_active boolean, max_devices int").write.mode("append").parquet(f"{tmp_path}/in")

    def drain():
        source = spark.readStream.schema("key string, event_id long, device string, ts long, is_active boolean, max_devices int").parquet(f"{tmp_path}/in")
        with streams.keyed_state(spark):
            streams.stream_admission(source, idle_ms=4000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start().awaitTermination(60)
        return {r["event_id"]: r["outcome"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    feed(1, "k", "a")
    drain()
    feed(2, "k", "b")
    first = drain()
    time.sleep(6)
    feed(3, "other", "x")  # a batch in which k's time is up
    drain()
    feed(4, "k", "c")
    assert first == {1: "accepted", 2: "device_limit"} and drain()[4] == "accepted"


def test_keyed_streams_keep_state_over_restarts(spark, tmp_path):
    """Devices freed and bound again, requests without a device, unknown keys and turns without role or text, each batch a start of its own."""
    from gazeloom.streaming import streams

    before = spark.conf.get(streams.STATE_STORE[0], None)
    events = "key string, event_id long, device string, ts long, is_active boolean, max_devices int, unbind boolean"
    turns = "conv_id long, turn long, role string, text string"

    def run(make, schema, name, batches, mode):
        found = []
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            with streams.keyed_state(spark):
                stream = make(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}"))
                stream.writeStream.foreachBatch(lambda b, n: found.append(sorted(map(tuple, b.collect())))).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start().awaitTermination(90)
        return found

    k = lambda n, device, unbind=False, active=True, key="k": (key, n, device, n, active, 2, unbind)
    got = run(streams.stream_admission, events, "events", [[k(1, "a"), k(3, "b"), k(2, None)], [k(4, "a", True), k(5, "b"), k(6, None), k(7, "x", True, key="u")], [k(8, "a"), k(9, "x", active=None, key="u"), k(10, "x", active=False, key="i")]], "append")
    assert [[(r[1], r[3], r[4]) for r in sorted(b, key=lambda r: r[1])] for b in got] == [
        [(1, "accepted", 1), (2, "accepted", 2), (3, "device_limit", 2)],
        [(5, "accepted", 3), (6, "accepted", 4)],
        [(8, "device_limit", 4), (9, "unknown_key", 0), (10, "inactive_key", 0)],
    ]
    got = run(lambda s: streams.stream_recent_turns(s, 2), turns, "turns", [[(1, 2, "user", "b"), (1, 0, "user", "z"), (1, 1, None, "a")], [(1, 3, "user", None), (2, 0, "user", "x")]], "update")
    assert got == [[(1, '[[1, null, "a"], [2, "user", "b"]]')], [(1, '[[2, "user", "b"], [3, "user", null]]'), (2, '[[0, "user", "x"]]')]]
    assert spark.conf.get(streams.STATE_STORE[0], None) == before
