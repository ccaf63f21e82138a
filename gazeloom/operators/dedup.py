"""Duplicates within a batch, near-duplicates by SimHash, and incoming rows against stored ones."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeloom.functions import text as X
from gazeloom.staging import broadcast_if_small, stage, tidy


#: Rows of stored ids, URLs and dates (about 100 bytes each) up to which they are broadcast.
SMALL_TABLE = 200_000


def dedup_batch(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds is_duplicate: false for the first row, by seq, of each URL hash. A URL that many rows share is ranked from one row per task, so it does not gather in one task."""
    hashed = df.withColumn("url_hash", X.url_hash(F.col("url")))
    first = hashed.groupBy("url_hash").agg(F.min(seq).alias("first_seq"))
    return hashed.join(first, "url_hash").withColumn("is_duplicate", F.col(seq) > F.col("first_seq")).drop("first_seq")


#: Fingerprints of one key from which on they are compared in blocks, and how many a block has.
HOT_KEY, HOT_BLOCK = 1024, 2048


def near_pairs(first: DataFrame, threshold: int, hot: int = HOT_KEY, block: int = HOT_BLOCK) -> DataFrame:
    """Pairs (a, b) of seq, a the smaller, of fingerprints (simhash, seq; each simhash once) that differ in no more than threshold bits.

    Of threshold + 3 blocks of the bits at least three are equal in a near pair, so each choice of three blocks is
    a key of about half of the bits. Fingerprints of a key meet in a join; those of a key that more than `hot` share are dealt into blocks, and each pair of blocks is compared once, in
    arrays, wherever Spark puts it: no task holds more than two blocks, and no candidate pair is a row.
    """
    cuts = [64 * k // (threshold + 3) for k in range(threshold + 4)]
    parts = [F.shiftrightunsigned("simhash", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = F.array(*[F.xxhash64(F.lit(n), *[parts[k] for k in three]) for n, three in enumerate(combinations(range(threshold + 3), 3))])
    keyed = first.select("simhash", "seq", F.explode(keys).alias("key"))
    crowded = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "crowded-keys")
    near = X.hamming(F.col("x.simhash"), F.col("y.simhash")) <= threshold
    none = crowded.isEmpty()
    few = keyed if none else keyed.join(broadcast_if_small(crowded), "key", "left_anti")
    # By a sort: twenty keys a row stand in the plan as the few bytes of one row, for which Spark would broadcast them all.
    met = few.alias("x").hint("merge").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.seq") < F.col("y.seq")) & near).select(F.col("x.seq").alias("a"), F.col("y.seq").alias("b"))
    if none:
        return stage(met.distinct(), "near-pairs")
    many = keyed.join(broadcast_if_small(crowded), "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("simhash", "key"), F.col("blocks")).cast("int"))
    # In order of the fingerprints, so that equal runs of a block stand the same however often it is made.
    held = stage(many.groupBy("key", "blocks", "block").agg(F.array_sort(F.collect_list(F.struct("simhash", "seq"))).alias("rows")).select("key", "blocks", "block", F.col("rows.simhash").alias("x"), F.col("rows.seq").alias("x_seq")), "crowded-blocks")
    others = F.expr("transform(sequence(0, blocks div 2), d -> cast(pmod(block + d, blocks) as int))")
    # Half way round the circle of blocks; the block opposite is met from one side.
    pairs = held.withColumn("other", F.explode(others)).where("blocks % 2 = 1 OR block < blocks / 2 OR pmod(other - block, blocks) < blocks / 2")
    pairs = pairs.join(held.select("key", F.col("block").alias("other"), F.col("x").alias("y"), F.col("x_seq").alias("y_seq")), ["key", "other"])
    kind = dict(first.dtypes)["seq"]

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                x, y, x_seq, y_seq = (np.asarray(row.column(c)[0].values) for c in ("x", "y", "x_seq", "y_seq"))
                x, y = x.astype(np.int64).view(np.uint64), y.astype(np.int64).view(np.uint64)  # the sign is a bit like any other
                for begin in range(0, len(x), 256):
                    i, j = np.nonzero(np.bitwise_count(x[begin : begin + 256, None] ^ y[None, :]) <= threshold)
                    a, b = x_seq[begin + i], y_seq[j]
                    if row.column("block")[0] == row.column("other")[0]:
                        a, b = a[a < b], b[a < b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    size = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = pairs.select("key", "block", "other", "x", "y", "x_seq", "y_seq").repartition(size, "key", "block", "other").mapInArrow(compare, f"a {kind}, b {kind}")
    return stage(met.union(wide).distinct(), "near-pairs")


def near_duplicates(df: DataFrame, threshold: int = 3, text: str = "content_text", seq: str = "seq") -> DataFrame:
    """Adds simhash and is_near_duplicate: within threshold bits of a row kept earlier, in order of seq (which is unique).

    Texts are looked at once, for their fingerprints; what is compared and staged is seq, fingerprint and a flag, which meet the rows again by seq.
    """
    return df.join(near_flags(df, threshold, text, seq), seq).select(*df.columns, "simhash", "is_near_duplicate")


@tidy
def near_flags(df: DataFrame, threshold: int, text: str, seq: str) -> DataFrame:
    """seq, simhash, is_near_duplicate of each row.

    Rows without content are never compared. Rows of one fingerprint are decided by their first. Pairs of different fingerprints are found
    by near_pairs(). A row is kept once no earlier near row is kept; rounds go on until all rows are decided.
    """
    marked = stage(df.select(F.col(seq), X.simhash(F.col(text)).alias("simhash"), F.coalesce(~X.blank(F.col(text)), F.lit(False)).alias("full")), "simhash")
    full = marked.where("full")
    first = stage(full.groupBy("simhash").agg(F.min(seq).alias("seq")), "fingerprints")
    edges = near_pairs(first, threshold)
    dropped = None
    while not edges.isEmpty():
        later = edges.select(F.col("b").alias("a")).distinct()
        sure = edges.select("a").distinct().join(later, "a", "left_anti")  # no earlier near row is undecided
        gone = stage(edges.join(sure, "a", "left_semi").select("b").distinct(), "near-dropped")
        dropped = gone if dropped is None else dropped.union(gone)
        edges = stage(edges.join(sure, "a", "left_anti").join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti"), "near-pairs")
    lost = first.join(dropped.withColumnRenamed("b", "seq"), "seq", "left_semi") if dropped is not None else first.limit(0)
    decided = first.select("simhash", F.col("seq").alias("first_seq")).join(lost.select("simhash", F.lit(True).alias("lost")), "simhash", "left")
    joined = marked.join(decided, "simhash", "left")
    return joined.select(seq, "simhash", F.coalesce(F.col("full") & (F.col("lost") | (F.col(seq) > F.col("first_seq"))), F.lit(False)).alias("is_near_duplicate"))


def classify_incoming(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds status new, upsert or duplicate: by id, normalised URL and date. Stored ids are unique."""
    known = broadcast_if_small(stored.select(F.col("news_id").alias("_id"), X.normalize_url(F.col("url")).alias("_url"), F.col("publish_date").alias("_date")), SMALL_TABLE)
    joined = incoming.join(known, incoming["news_id"] == known["_id"], "left")
    status = F.when(F.col("_id").isNull() | (X.normalize_url(F.col("url")) != F.col("_url")), "new").when(F.col("publish_date").eqNullSafe(F.col("_date")), "duplicate").otherwise("upsert")
    return joined.withColumn("status", status).drop("_id", "_url", "_date")


def existing_urls(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose normalised URL is stored."""
    known = stored.select(X.normalize_url(F.col("url")).alias("_url")).where("_url <> ''").distinct()
    return df.withColumn("_url", X.normalize_url(F.col("url"))).join(known, "_url", "left_semi").drop("_url")


def upsert(stored: DataFrame, updates: DataFrame, key: str | list[str] = "news_id", mode: str = "upsert", order: str | None = None, bump: bool = False, from_stored: bool = False) -> DataFrame:
    """Stored rows with updates by key; mode 'update' leaves out updates whose key is not stored. Of several updates of a key the last by order wins.

    bump raises crawl_version of the rows written: of the incoming row, or with from_stored of the stored one.
    """
    if mode not in ("update", "upsert"):
        raise ValueError("mode is 'update' or 'upsert'")
    keys = [key] if isinstance(key, str) else list(key)
    if order:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        updates = updates.withColumn("_n", last).where("_n = 1").drop("_n")
    written = updates.join(stored.select(*keys), keys, "left_semi") if mode == "update" else updates
    if bump and from_stored:
        old = stored.select(*keys, F.col("crawl_version").alias("_v"))
        written = written.join(old, keys, "left").withColumn("crawl_version", F.coalesce("_v", F.col("crawl_version") - 0) + 1).drop("_v")
    elif bump:
        written = written.withColumn("crawl_version", F.coalesce("crawl_version", F.lit(1)) + 1)
    return stored.join(broadcast_if_small(updates.select(*keys), SMALL_TABLE), keys, "left_anti").select(stored.columns).unionByName(written.select(stored.columns))


def partial_update(stored: DataFrame, updates: DataFrame, key: str = "news_id", stamp=None) -> DataFrame:
    """Stored rows with the non-null values of updates (one row a key) in the columns that updates has; stamp sets last_updated of matched rows."""
    columns = [c for c in updates.columns if c != key]
    new = updates.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = stored.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns})
    if stamp is not None and "last_updated" in stored.columns:
        joined = joined.withColumn("last_updated", F.when(F.col("_hit"), stamp).otherwise(F.col("last_updated")))
    return joined.select(stored.columns)


def delete_ids(stored: DataFrame, ids: DataFrame, key: str = "news_id") -> DataFrame:
    return stored.join(broadcast_if_small(ids.select(key).distinct()), key, "left_anti").select(stored.columns)


def fetch_by_ids(df: DataFrame, ids: DataFrame, key: str = "news_id", position: str = "position") -> DataFrame:
    """Rows for an ordered list of ids (key, position): in that order, missing ids left out, repeated ones repeated."""
    return df.join(broadcast_if_small(ids.select(key, position)), key).orderBy(position).select(position, *df.columns)
