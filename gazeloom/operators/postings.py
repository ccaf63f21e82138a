"""Keyword search by a stored table of postings, which grows by batches.

    <table>/batch=N/bucket=B/*.parquet

Documents are dealt into segments of SEGMENT_ROWS as they are scanned. For each term of a segment there is a row: the places of its documents in the segment, and how often each holds the term.
The row of the empty term has the segment's keys and lengths. Rows lie in hash buckets of their terms, so a search reads the buckets of its terms alone; several tasks share a bucket.
A batch is there once it is whole (Spark writes _SUCCESS last); one that is written again replaces itself.

A search deals the rows of its terms by segment, once, however many queries ask for a term. A task turns each segment back into documents, of the asked terms alone, and ranks them as fulltext_search() does: it gives the
best k of some thousand documents for each query, so no pair of query and posting is a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.operators.retrieval import best_hits, tokens, top
from gazeloom.staging import broadcast_if_small, stage, tidy

SEGMENT_ROWS, BUCKETS = 1024, 64


def _schema(kind: str) -> str:
    return f"segment long, term string, n int, places array<int>, counts array<int>, lengths array<int>, keys array<{kind}>"


def add_postings(documents: DataFrame, table: str, number: int, fields: tuple[str, ...] = ("title", "content_text"), key: str = "news_id", buckets: int = BUCKETS, segment_rows: int = SEGMENT_ROWS) -> None:
    """Write documents as batch `number` of a table of postings; all batches of a table have the same number of buckets. Their keys are not in other batches; rows with a null key are left out; null and empty texts count as documents without words."""
    kind = dict(documents.dtypes)[key]

    def run(batches):
        from collections import Counter

        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def out():
            nonlocal n
            segment = (number << 44) | (part << 20) | n
            n += 1
            lengths = [len(words) for _, words in held]
            rows: dict[str, tuple[list, list]] = {}
            for place, (_, words) in enumerate(held):
                for term, count in Counter(words).items():
                    own = rows.setdefault(term, ([], []))
                    own[0].append(place)
                    own[1].append(count)
            found = [(segment, "", len(held), None, None, lengths, [name for name, _ in held])]
            for term, (places, counts) in rows.items():
                found.append((segment, term, len(places), places, counts, None, None))
            held.clear()
            names = ["segment", "term", "n", "places", "counts", "lengths", "keys"]
            kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.int32())] * 3, pa.list_(key_type)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for batch in batches:
            key_type = batch.column(key).type
            for row in zip(batch.column(key).to_pylist(), batch.column("words").to_pylist(), strict=True):
                held.append(row)
                if len(held) == segment_rows:
                    yield out()
        if held:
            yield out()

    cut = documents.where(F.col(key).isNotNull()).select(key, tokens(F.concat_ws(" ", *fields)).alias("words"))
    rows = cut.mapInArrow(run, _schema(kind)).withColumn("bucket", F.when(F.col("term") == "", -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int"))
    slices = max(1, 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) // (buckets + 1))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("segment", "term"), F.lit(slices))).repartition("bucket", "slice").drop("slice")
    dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={number}")


def read_postings(spark: SparkSession, table: str, kind: str) -> DataFrame | None:
    """All rows of the batches that are whole; None where there is none. kind: the type of keys."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    paths = sorted(str(f.getPath().getParent()) for f in found)
    return spark.read.schema(f"{_schema(kind)}, batch int, bucket int").option("basePath", table).parquet(*paths) if paths else None


def documents_of(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """Rows of postings (segment, number of a term, places, counts; the segment's lengths and keys under the number -1) dealt by segment, as documents: key, length, terms, counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(parts):
            part = pa.Table.from_batches(parts).combine_chunks()
            number, (places, counts) = np.asarray(part.column("number")), (part.column(c).combine_chunks() for c in ("places", "counts"))
            own = int(np.flatnonzero(number == -1)[0])
            lengths, keys = (part.column(c).combine_chunks()[own].values for c in ("lengths", "keys"))
            place, terms = np.asarray(places.flatten()), np.repeat(number, np.asarray(places.value_lengths().fill_null(0)))
            order = np.argsort(place, kind="stable")
            edges = pa.array(np.searchsorted(place[order], np.arange(len(keys) + 1)).astype(np.int32))
            return pa.RecordBatch.from_arrays([keys, lengths, *(pa.ListArray.from_arrays(edges, pa.array(x[order])) for x in (terms, np.asarray(counts.flatten())))], [key, "length", "terms", "counts"])

        held, last = [], None
        for batch in batches:
            segment = np.asarray(batch.column("segment"))
            edges = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                if held and segment[begin] != last:
                    yield out(held)
                    held = []
                held.append(batch.slice(begin, end - begin))
                last = segment[begin]
        if held:
            yield out(held)

    return rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, f"{key} {kind}, length int, terms array<long>, counts array<int>")


@tidy
def search_postings(queries: DataFrame, table: str, k: int, key: str = "news_id", kind: str = "string", buckets: int = BUCKETS) -> DataFrame:
    """BM25 as fulltext_search() gives it over all documents of the table: query_id, key, score, rank. queries: query_id, query."""
    spark = queries.sparkSession
    rows = read_postings(spark, table, kind)
    asked = stage(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")), "query-terms")
    if rows is None:
        return asked.limit(0).select("query_id", F.lit(None).cast(kind).alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    terms = stage(asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "asked-terms")
    # The buckets of the queries' terms: numbers below `buckets`.
    own = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]
    documents, rows = rows.where("bucket = -1"), rows.where(F.col("bucket").isin(own)).join(broadcast_if_small(terms), "term")
    # The number of documents and their mean length: one row.
    docs, mean = documents.agg(F.sum("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)) / F.sum("n")).first()
    df = rows.groupBy("number").agg(F.sum("n").alias("df"))
    idf = df.select("number", F.log(1 + ((docs or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    wanted = asked.join(terms, "term").join(idf, "number").groupBy("query_id").agg(F.collect_list("number").alias("terms"), F.collect_list("idf").alias("idfs"))
    lists = [F.lit(None).cast(f"array<{x}>").alias(c) for c, x in (("lengths", "int"), ("keys", kind))]
    needed = rows.select("segment", "number", "places", "counts", *lists).unionByName(documents.select("segment", F.lit(-1).cast("long").alias("number"), "places", "counts", "lengths", "keys"))
    return top(best_hits(documents_of(needed, key, kind), stage(wanted, "asked-numbers"), mean or 1.0, key, k), k, key)
