"""A table in hash buckets, of which a batch writes only those that hold its keys.

    <table>/data/batch=N/bucket=B/*.parquet    a segment of bucket B: the rows of it that batch N wrote
    <table>/gone/batch=N/bucket=B/*.parquet    keys whose rows in older segments of bucket B don't stand any more
    <table>/manifest/batch=N/*.parquet         bucket and batch: the segments of each bucket after batch N

A batch either writes whole buckets anew (write_buckets(), upsert_buckets()), or rows beside the older ones (append_buckets()), until a bucket has SEGMENTS of these and is written as one.
A batch is committed when its manifest is whole (Spark writes _SUCCESS last). Readers take the newest manifest, and from it the folders of each bucket. A batch that
runs again starts from the manifest before it and writes its own folders anew. Folders that no manifest still kept names are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom.operators.dedup import upsert
from gazeloom.staging import broadcast_if_small, delete

BUCKETS = 64
#: Segments that a bucket has before it is written as one.
SEGMENTS = 8
MANIFEST = "bucket int, batch long"


def bucket_of(key: str | list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(buckets)).cast("int")


def found_paths(spark: SparkSession, pattern: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [f.getPath() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []]


def committed(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the batches that are committed."""
    return sorted(int(p.getParent().getName().split("=")[1]) for p in found_paths(spark, f"{table}/manifest/batch=*/_SUCCESS"))


def manifest(spark: SparkSession, table: str, before: int | None = None) -> dict[int, list[int]]:
    """The buckets of the newest manifest (before a batch), of which the caller set the number, with the batches of their segments in order."""
    numbers = [n for n in committed(spark, table) if before is None or n < before]
    stands: dict[int, list[int]] = {}
    for bucket, batch in sorted(spark.read.schema(MANIFEST).parquet(f"{table}/manifest/batch={numbers[-1]}").collect() if numbers else []):
        stands.setdefault(bucket, []).append(batch)
    return stands


def _place(path) -> tuple[int, int]:
    """Batch and bucket of a folder."""
    return int(path.getParent().getName().split("=")[1]), int(path.getName().split("=")[1])


def read_buckets(spark: SparkSession, table: str, schema: T.StructType, only: set[int] | None = None, before: int | None = None, key: str | list[str] = "news_id") -> DataFrame:
    """The rows of a table, or of some of its buckets."""
    named = sorted((b, n) for b, of in manifest(spark, table, before).items() if only is None or b in only for n in of)
    if not named:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{table}/data/batch={n}/bucket={b}" for b, n in named])
    gone = [str(p) for p in found_paths(spark, f"{table}/gone/batch=*/bucket=*") if _place(p)[::-1] in set(named)]
    if not gone:
        return rows
    keys, batch = [key] if isinstance(key, str) else key, F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/bucket=", 1).cast("long")
    dead = spark.read.schema(T.StructType([schema[k] for k in keys])).parquet(*gone).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(batch).alias("_until"))
    stands = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_batch") < F.col("_until")]
    return rows.withColumn("_batch", batch).join(broadcast_if_small(dead), stands, "left_anti").drop("_batch")


def touched(keys: DataFrame, key: str | list[str], buckets: int) -> set[int]:
    """The buckets that rows fall into: numbers below `buckets`, counted before they are fetched."""
    return {r[0] for r in keys.select(bucket_of(key, buckets).alias("b")).distinct().collect()}


def write_buckets(rows: DataFrame, table: str, number: int, which: set[int], key: str | list[str] = "news_id", buckets: int = BUCKETS, keep: int = 3) -> None:
    """Commit batch `number`: rows are all rows of the buckets `which`; the others stand as they were."""
    spark = rows.sparkSession
    _deal(rows, table, number, which, key, buckets)
    here = _written(spark, table, number)
    _commit(spark, table, number, {b: of for b, of in manifest(spark, table, number).items() if b not in which} | {b: [number] for b in here}, keep)


def append_buckets(rows: DataFrame, table: str, number: int, schema: T.StructType, which: set[int], key: str | list[str] = "news_id", buckets: int = BUCKETS, keep: int = 3, segments: int = SEGMENTS) -> None:
    """Commit batch `number`: rows, one a key, of buckets among `which`, take the place of the stored rows of their keys. Stored rows are neither moved nor written, but for those of buckets that have `segments` segments."""
    spark, keys = rows.sparkSession, [key] if isinstance(key, str) else key
    stands = manifest(spark, table, number)
    full = {b for b in which if len(stands.get(b, [])) >= segments}
    if full:
        rows = upsert(read_buckets(spark, table, schema, full, number, key), rows.select(*schema.names), key)
    _deal(rows, table, number, which, key, buckets)
    here = _written(spark, table, number)
    delete(spark, [f"{table}/gone/batch={number}"])
    grown = (here & stands.keys()) - full
    if grown:
        only = T.StructType([schema[k] for k in keys])
        new = spark.read.schema(only).parquet(*[f"{table}/data/batch={number}/bucket={b}" for b in sorted(grown)])
        gone = read_buckets(spark, table, only, grown, number, key).join(broadcast_if_small(new), keys, "left_semi")
        gone.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{table}/gone/batch={number}")
    _commit(spark, table, number, stands | {b: [*(stands[b] if b in grown else []), number] for b in here}, keep)


def _deal(rows: DataFrame, table: str, number: int, which: set[int], key: str | list[str], buckets: int) -> None:
    """Write rows as segments of a batch. A bucket is dealt to as many tasks as Spark has room for, so no task holds a share of the table; small ones are joined by Spark."""
    slices = max(1, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, len(which)))
    target = rows.withColumns({"bucket": bucket_of(key, buckets), "slice": F.pmod(F.xxhash64(F.lit(1), *([key] if isinstance(key, str) else key)), F.lit(slices))}).repartition("bucket", "slice").drop("slice")
    target.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/batch={number}")


def _written(spark: SparkSession, table: str, number: int) -> set[int]:
    return {_place(p)[1] for p in found_paths(spark, f"{table}/data/batch={number}/bucket=*")}


def _commit(spark: SparkSession, table: str, number: int, stands: dict[int, list[int]], keep: int) -> None:
    spark.createDataFrame(sorted((b, n) for b, of in stands.items() for n in of), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/batch={number}")
    _forget(spark, table, max(1, keep))


def _forget(spark: SparkSession, table: str, keep: int) -> None:
    """Delete manifests but the last `keep`, and the folders of buckets that none of those names."""
    numbers = committed(spark, table)
    kept, gone = numbers[-keep:], numbers[:-keep]
    if not gone:
        return
    named = {(r["batch"], r["bucket"]) for n in kept for r in spark.read.schema(MANIFEST).parquet(f"{table}/manifest/batch={n}").collect()}
    for kind in ("data", "gone"):
        old = [p for p in found_paths(spark, f"{table}/{kind}/batch=*/bucket=*") if _place(p)[0] <= kept[-1]]
        delete(spark, [str(p) for p in old if _place(p) not in named])
    delete(spark, [f"{table}/manifest/batch={n}" for n in gone])
    for kind in ("data", "gone"):
        full = {str(p.getParent()) for p in found_paths(spark, f"{table}/{kind}/batch=*/bucket=*")}
        delete(spark, [str(p) for p in found_paths(spark, f"{table}/{kind}/batch=*") if str(p) not in full and int(p.getName().split("=")[1]) < kept[-1]])


def upsert_buckets(updates: DataFrame, table: str, number: int, schema: T.StructType, key: str | list[str] = "news_id", buckets: int = BUCKETS, keep: int = 3, **options) -> None:
    """Merge updates into a table of buckets as batch `number`: only the buckets of their keys are read and written. options are those of upsert(). The same batch may run again."""
    which = touched(updates, key, buckets)
    stored = read_buckets(updates.sparkSession, table, schema, which, number, key)
    write_buckets(upsert(stored, updates, key, **options), table, number, which, key, buckets, keep)
