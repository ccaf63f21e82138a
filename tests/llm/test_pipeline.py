import hashlib
import random
import re
from array import array

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gazeloom.llm import sentencepiece_codec as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus with clean, junk, toxic, repeated, near-equal and contaminated documents, and odd rows."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)) for _ in range(n))
    rows = [(k, prose(9)) for k in range(240)]
    labels = [(k, 1, 0) for k in range(240)]
    rows += [(1000 + k, " ".join("#$%*@!"[r.randrange(6)] * 3 for _ in range(90))) for k in range(40)]
    labels += [(1000 + k, 0, 0) for k in range(20)]
    rows += [(2000 + k, prose(6) + " " + r.choice(["zorkum", "zorkel"])) for k in range(60)]
    labels += [(2000 + k, 1, 1) for k in range(50)]
    rows += [(3000 + k, rows[k][1]) for k in range(10)] + [(3100 + k, rows[k][1] + " tail") for k in range(10)]
    item = " ".join(word() for _ in range(20))
    rows += [(4000 + k, prose(3) + ". " + item) for k in range(5)]
    rows += [(5000, None), (5001, ""), (None, prose(5)), (7, rows[7][1]), (6000, prose(400))]
    out = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("score"))
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(f"{out}/benchmark.parquet")
    return out, rows


def ids(df):
    return sorted(x[0] for x in df.select("doc_id").where("doc_id is not null").collect())


def test_stages(spark, folder):
    out, rows = folder
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{out}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stage(stage(spark, docs, out), "test")
        assert now.columns == docs.columns, name
        assert set(ids(now)) <= set(ids(docs)), name
        docs = now
        kept.append(set(ids(now)))
    quality, toxicity, dedup, clean = kept
    assert sorted(quality & {*range(1000, 1040), 5000, 5001}) == []
    assert len(quality & {*range(240)}) >= 230 and 6000 in quality
    assert len(toxicity & {*range(2000, 2060)}) <= 2 and len(toxicity & {*range(240)}) >= 0.98 * len(quality & {*range(240)})
    assert not dedup & {*range(3000, 3010)} and not dedup & {k for k in range(3100, 3110) if k - 3100 in dedup}
    assert dedup >= toxicity & {*range(240), *range(4000, 4005)} and ids(docs).count(7) <= 1
    assert clean == dedup - {*range(4000, 4005)}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, out)
    text = dict(rows)
    tool = P.codec(P.model_path())
    found = last.where("doc_id is not null").collect()
    assert sorted(x["doc_id"] for x in found) == sorted(clean)
    assert all(x["n_tokens"] == len(tool.encode(text[x["doc_id"]])) // 4 for x in found)


def test_rows_without_id(spark, folder):
    """Rows without doc_id are judged as others are: the toxic, contaminated and repeated ones go, a clean one stays once."""
    out, rows = folder
    r = random.Random(77)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    prose = ". ".join(" ".join(word() for _ in range(9)) for _ in range(6))
    item = spark.read.parquet(f"{out}/benchmark.parquet").first()["text"]
    texts = {"clean": prose, "again": prose, "copy": rows[3][1], "toxic": prose[::-1] + " zorkum zorkel zorkum", "bench": item, "junk": "#$%*@! " * 90, "null": None}
    base = spark.read.parquet(f"{out}/documents.parquet")
    more = spark.createDataFrame([(None, t) for t in texts.values()], "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("score"))
    docs = corpus_pipeline.stage(base.where("doc_id is not null").unionByName(more), "test")
    left = lambda d: [x["text"] for x in d.where("doc_id is null").collect()]
    assert texts["junk"] not in left(corpus_pipeline.quality(spark, docs, out)) and None not in left(corpus_pipeline.quality(spark, docs, out))
    assert texts["toxic"] not in left(corpus_pipeline.toxicity(spark, docs, out))
    deduped = left(corpus_pipeline.near_dedup(spark, docs, out))
    assert deduped.count(prose) == 1 and rows[3][1] not in deduped
    assert item not in left(corpus_pipeline.decontamination(spark, docs, out)) and prose in left(corpus_pipeline.decontamination(spark, docs, out))


def plain_run(spark, out, rows):
    """doc_ids that the stages keep by plain rules, from each stage's scores alone: what is rejected goes, of each component of linked texts the smallest stays."""
    from gazeloom.llm.quality import classify_quality
    from gazeloom.llm.toxicity import score_toxicity

    docs = spark.read.parquet(f"{out}/documents.parquet").where("doc_id is not null")
    labels = spark.read.parquet(f"{out}/labels.parquet")
    only = lambda ids: docs.where(F.col("doc_id").isin(sorted(ids)))
    kept = {i for i, _ in rows if i is not None}
    kept -= {x["doc_id"] for x in classify_quality(docs, labels).collect() if not x["accepted"]}
    kept -= {x["doc_id"] for x in score_toxicity(only(kept), labels).collect() if x["score"] >= 0.7}
    sets, top = {}, {}
    for i, text in rows:
        if i in kept and text and text.split():
            w = text.encode().lower().split()
            sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for i in sorted(sets):
        for j in sets:
            if j < i and any(100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    kept = {i for i in kept if root(i) == i}
    item = spark.read.parquet(f"{out}/benchmark.parquet").first()["text"].split()
    windows = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
        if hit and 20 * len(hit) >= len(w):
            kept.discard(i)
    return kept


def test_run_by_plain_rules(spark, folder):
    out, rows = folder
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.model_path())
    found = [x for x in corpus_pipeline.run(spark, out).collect() if x["doc_id"] is not None]
    assert sorted(x["doc_id"] for x in found) == sorted(plain_run(spark, out, rows))
    text = dict(rows)
    for x in found:
        ids = model.encode(text[x["doc_id"]], add_bos=True, add_eos=True)
        assert x["n_tokens"] == len(ids)
        assert x["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_run_is_its_stages(spark, folder):
    out, _ = folder
    once = sorted(map(tuple, corpus_pipeline.run(spark, out).collect()), key=str)
    docs = spark.read.parquet(f"{out}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(stage(spark, docs, out), "test")
    assert once == sorted(map(tuple, docs.collect()), key=str)


def test_no_documents(spark, folder):
    out, _ = folder
    docs = spark.read.parquet(f"{out}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, out)
    assert docs.count() == 0


def test_a_run_leaves_its_result_alone(spark, folder):
    import os

    from gazeloom.staging import shared_dir

    place = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(place))
    assert corpus_pipeline.run(spark, folder[0]).count() > 0
    left = set(os.listdir(place)) - before
    assert [x.startswith("pipeline-sentencepiece") for x in left] == [True]


def test_columns_of_clashing_names(spark, folder):
    """Columns that are named as the pipeline names its own stay as they are."""
    out, _ = folder
    docs = spark.read.parquet(f"{out}/documents.parquet").where("doc_id < 40 or doc_id between 3000 and 3009").withColumns({"_id_": F.lit("mine"), "_ID__": F.lit("too"), "rows": F.lit(3), "first": F.lit(4), "row": F.lit(5)})
    kept = corpus_pipeline.near_dedup(spark, docs, out)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert {(r["_id_"], r["_ID__"], r["rows"], r["first"], r["row"]) for r in found} == {("mine", "too", 3, 4, 5)}
    assert sorted(r["doc_id"] for r in found) == list(range(40))
