"""Operator 9: shards of near-equal bytes by Karmarkar-Karp differencing.

Documents of equal text form a group that stays together. A partial partition is one sum
of bytes for each shard; an item alone is a partial partition with one sum and zeros else.
The two partial partitions with the largest spread are combined, the largest sum of one with the
smallest of the other, and so on, until one is left.

An item is a group of more than 1 / (shards * HEAVY) of all bytes, of which there are fewer than shards * HEAVY, or else a bucket: the groups whose digest has one
remainder by BUCKETS. Spark sums the bytes of groups and of items, and only this table, of bounded size whatever the corpus, is
differenced on the driver; a row finds its shard by its digest or bucket, so no group gathers in a task. A bucket stays together
as a group does, and at BUCKETS near-equal items or more differencing leaves a spread far below one item.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.common import labelled_text, shuffle_partitions, stage, table, tidy

SHARDS = 16
#: Buckets of groups, and how many heavy groups a shard's share of bytes may hold.
BUCKETS, HEAVY = 1 << 16, 256


def difference(items: list[tuple], shards: int) -> list[list]:
    """Combine partial partitions, given as tuples of (sum, content) pairs, one pair a shard; contents are None, leaves or (left, right). Returns the last one's pairs, largest sum first."""
    heap = []
    for n, pairs in enumerate(items):
        pairs = sorted(pairs, key=lambda p: -p[0])
        heap.append((pairs[-1][0] - pairs[0][0], n, pairs))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        b.reverse()
        pairs = [(x + y, s if t is None else t if s is None else (s, t)) for (x, s), (y, t) in zip(a, b, strict=True)]
        pairs.sort(key=lambda p: -p[0])
        heapq.heapreplace(heap, (pairs[-1][0] - pairs[0][0], n, pairs))
        n += 1
    return heap[0][2] if heap else [(0, None)] * shards


def leaves(content) -> list:
    """The leaves of a content."""
    todo, out = [content], []
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += x
        elif x is not None:
            out.append(x)
    return out


@tidy
def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deal documents into shards of near-equal bytes, documents of equal text together.

    Returns doc_id, size (UTF-8 bytes plus 1; null counts as empty text), text_crc32, law, shard, slot, grown_shard (null under this
    law). Slots run from 0 without gaps in each shard, in doc_id order, null doc_ids first and rows of one doc_id by their text's digest. Null and empty
    texts are one group; repeated rows belong to one group and have a slot each. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stage(
        labelled_text(docs).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")),
        "sizes",
    )
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).cast("int"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = F.col("bytes") * (shards * HEAVY) > total
    groups = rows.groupBy("digest", "bucket").agg(F.sum("size").alias("bytes"))
    items = groups.groupBy(F.when(heavy, F.col("digest")).alias("digest"), F.when(~heavy, F.col("bucket")).alias("bucket")).agg(F.sum("bytes").alias("bytes"))
    items = sorted(items.collect(), key=lambda r: (-1 if r["bucket"] is None else r["bucket"], r["digest"] or b""))  # at most BUCKETS + shards * HEAVY rows
    empty = [(0, None)] * (shards - 1)
    names = []
    for shard, (_, content) in enumerate(difference([[(r["bytes"], n), *empty] for n, r in enumerate(items)], shards)):
        names += [(items[n]["digest"], items[n]["bucket"], shard) for n in leaves(content)]
    placed = docs.sparkSession.createDataFrame(names, "digest binary, bucket int, shard int")
    by_digest, by_bucket = (placed.where(F.col(c).isNotNull()).select(c, F.col("shard").alias(f"by_{c}")) for c in ("digest", "bucket"))
    sharded = rows.join(F.broadcast(by_digest), "digest", "left").join(F.broadcast(by_bucket), "bucket", "left")
    sharded = sharded.select("doc_id", "size", "text_crc32", "digest", F.coalesce("by_digest", "by_bucket").alias("shard"))

    # Numbering: rows in ranges of doc_id; a row's slot is its number in its range and shard plus the rows of that shard in earlier ranges.
    # A doc_id that fills several ranges is split among them by its text's digest.
    ranged = stage(
        sharded.repartitionByRange(shuffle_partitions(docs.sparkSession), F.asc_nulls_first("doc_id"), "digest")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "digest")
        .drop("digest")
        .mapInArrow(lambda batches: numbered(batches, shards), "doc_id long, size long, text_crc32 long, shard int, range int, place long"),
        "numbered",
    )
    counts: dict[int, int] = {}
    before = []
    for part, shard, n in ranged.groupBy("range", "shard").count().orderBy("range", "shard").collect():  # at most `shards` rows a range
        before.append((part, shard, counts.get(shard, 0)))
        counts[shard] = counts.get(shard, 0) + n
    offsets = docs.sparkSession.createDataFrame(before, "range int, shard int, before long")
    return ranged.join(F.broadcast(offsets), ["range", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def numbered(batches, shards: int):
    """Number the rows of this range within each shard."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        place = np.zeros(len(shard), np.int64)
        for k in np.unique(shard):
            own = shard == k
            n = int(own.sum())
            place[own] = seen[k] + np.arange(n)
            seen[k] += n
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "shard")), pa.array(np.full(len(shard), part), pa.int32()), pa.array(place, pa.int64())],
            ["doc_id", "size", "text_crc32", "shard", "range", "place"],
        )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
