"""A similarity at the threshold, or equal to another, is not decided by the rounding of 32-bit vectors."""

import datetime
import hashlib

import numpy as np
from pyspark.sql import functions as F

from gazeloom.operators.ingest import ingest
from gazeloom.operators.vectors import hashing_encoder


def test_a_tag_at_the_threshold_and_tags_of_equal_similarity(spark):
    found: dict[int, str] = {}
    for i in range(2000):
        found.setdefault(int(hashlib.md5(f"word{i}".encode()).hexdigest()[:8], 16) % 64, f"word{i}")
    w = [found[k] for k in sorted(found)]
    encode, text = hashing_encoder(64), " ".join([w[0], w[1], w[1]])
    # (1, 2) against (3, 1, 2, 1, 1, 1, 1, 1, 1): the cosine is 5 / sqrt(5 * 20), a half.
    tags = {f"t{n}": " ".join([*[w[0]] * 3, w[1], w[at], *w[at : at + 7]]) for n, at in enumerate(range(2, 50, 7))}
    vectors = {name: encode([words])[0] for name, words in tags.items()}
    x = encode([text])[0].astype(float)
    scores = [x @ v.astype(float) / np.linalg.norm(x) / np.linalg.norm(v.astype(float)) for v in vectors.values()]
    assert max(scores) < 0.5 and max(abs(s - 0.5) for s in scores) < 1e-6
    row = ("a", "title", "https://h/a", datetime.datetime(2024, 1, 1), text, text, 0)
    raw = spark.createDataFrame([row], "news_id string, title string, url string, publish_date timestamp, content_text string, content_markdown string, seq long")
    for name in ("tags", "attachments"):
        raw = raw.withColumn(name, F.array().cast("array<string>"))
    raw = raw.withColumns({"source_site": F.lit("s"), "author": F.lit("b"), "crawl_version": F.lit(1), "metadata": F.lit(None).cast("string")})
    rows = spark.createDataFrame([(name, [float(a) for a in v]) for name, v in vectors.items()], "tag_id string, embedding array<float>")
    done = ingest(raw, raw.drop("seq").limit(0), vectors={"content_embedding": ("content_text", 64)}, tags=rows, threshold=0.5)
    assert done["articles"].first()["tags"] == ["t0", "t1", "t2", "t3", "t4"]
