"""The links that a stream has had, in two tiers: streaming state for those of late, a stored set in hash parts for all, behind Bloom filters.

    <table>/links/span=F-L/part=P/*.parquet    list_url, url: links first seen in batches F to L
    <table>/filters                            Bloom filters of each part, a table in hash buckets

State forgets a link some time after it came. Whatever passes the state is held against the filters of its part: a link that they don't know is new, and a link that they know is looked up in the stored set itself, of
which only its part is read. So no link is given twice and none is lost, while the state stays as small as the links of its span.

A batch adds its new links as a span of its own. When SPANS spans of a level are full, the next batch first joins them to one, so a link is written again once a level. A batch that runs again starts from the spans before it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gazeloom.staging import delete, scope, stage
from gazeloom.streaming.buckets import found_paths, read_buckets, touched, write_buckets

LINK = ["list_url", "url"]
LINKS = T.StructType([T.StructField(c, T.StringType()) for c in LINK])
FILTERS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())])
#: Parts of the stored set, and spans of a level that are joined to one of the next.
PARTS, SPANS = 64, 8
#: Links that the first filter of a part holds; each further one holds twice as many. Bits a link, and bits that a link sets.
FILTER_LINKS, FILTER_BITS, HASHES = 65_536, 10, 7


def _whole(spark: SparkSession, table: str, before: int | None) -> list[tuple[int, int]]:
    found = [tuple(int(x) for x in p.getParent().getName().split("=")[1].split("-")) for p in found_paths(spark, f"{table}/links/span=*/_SUCCESS")]
    return sorted((x for x in found if before is None or x[1] < before), key=lambda x: (x[0], -x[1]))


def spans(spark: SparkSession, table: str, before: int | None = None) -> list[tuple[int, int]]:
    """Spans that cover all batches (before one), each once: the longest that are whole."""
    cover: list[tuple[int, int]] = []
    for first, last in _whole(spark, table, before):
        if not cover or first > cover[-1][1]:
            cover.append((first, last))
    return cover


def _read(spark: SparkSession, table: str, which: list[tuple[int, int]]) -> DataFrame:
    """list_url, url and part of some spans: of all levels, they are SPANS times the logarithm of the batches."""
    schema = T.StructType([*LINKS.fields, T.StructField("part", T.IntegerType())])
    rows = spark.createDataFrame([], schema)
    for first, last in which:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{table}/links/span={first}-{last}"))
    return rows


def seen_links(spark: SparkSession, table: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """list_url, url: all links that the batches (before one) have had, each once; or those of some parts."""
    rows = _read(spark, table, spans(spark, table, before))
    return (rows if parts is None else rows.where(F.col("part").isin(parts))).select(*LINK)


def _join_spans(spark: SparkSession, table: str, number: int) -> None:
    """Before batch `number`: join full levels of the spans before it, and delete what a longer span covers."""
    length = 1
    while number and number % (length * SPANS) == 0:
        length *= SPANS
    first, last = number - length, number - 1
    if length > 1 and (first, last) not in _whole(spark, table, number):
        _write(_read(spark, table, [x for x in spans(spark, table, number) if x[0] >= first]), f"{table}/links/span={first}-{last}")
    cover = set(spans(spark, table, number))
    delete(spark, [f"{table}/links/span={a}-{b}" for a, b in _whole(spark, table, number) if (a, b) not in cover])


def _write(rows: DataFrame, path: str) -> None:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(path)


def _size(level: int) -> int:
    return (FILTER_LINKS << level) * FILTER_BITS


def _places(a, b, size: int):
    """The bits of links, a row of HASHES each, by two hashes of 64 bits."""
    import numpy as np

    return (a[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * (b[:, None] | np.uint64(1))) % np.uint64(size)


def known(links: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Links of a part with column maybe: whether a filter of the part knows them."""
    import numpy as np

    a, b = (links[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "g"))
    maybe = np.zeros(len(links), bool)
    for level, data in zip(filters.level, filters.bits, strict=True):
        at, bits = _places(a, b, _size(int(level))), np.frombuffer(data, np.uint8)
        maybe |= ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
    return links.assign(maybe=maybe)


def added(key: tuple, links: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The filters of a part with new links in them: the last takes as many as it holds, the rest go to further ones."""
    import numpy as np

    a, b = (links[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "g"))
    rows = [[int(x), int(n), np.frombuffer(d, np.uint8).copy()] for x, n, d in sorted(zip(filters.level, filters.n, filters.bits, strict=True), key=lambda r: r[0])]
    at = 0
    while at < len(a):
        if not rows or rows[-1][1] >= FILTER_LINKS << rows[-1][0]:
            rows.append([len(rows), 0, np.zeros(_size(len(rows)) // 8, np.uint8)])
        level, n, bits = rows[-1]
        stop = min(len(a), at + (FILTER_LINKS << level) - n)
        places = _places(a[at:stop], b[at:stop], _size(level)).ravel()
        np.bitwise_or.at(bits, places >> np.uint64(3), np.left_shift(np.uint8(1), (places & np.uint64(7)).astype(np.uint8)))
        rows[-1][1] += stop - at
        at = stop
    return pd.DataFrame({"part": np.int32(key[0]), "level": [r[0] for r in rows], "n": [r[1] for r in rows], "bits": [r[2].tobytes() for r in rows]})


def _keyed(links: DataFrame, parts: int) -> DataFrame:
    """Links with the two hashes of the filters, and their part."""
    return links.withColumns({"h": F.xxhash64(*LINK), "g": F.xxhash64("url", "list_url", F.lit(7)), "part": F.pmod(F.xxhash64(F.lit(1), *LINK), F.lit(parts)).cast("int")})


def add_links(links: DataFrame, table: str, number: int, parts: int = PARTS) -> DataFrame:
    """Batch `number` of links: those that no batch before had are stored, and returned. The same batch may run again.

    Null list_url or url are values like others. Links of a batch come once, whatever copies it has; a batch without links writes nothing. parts is set when the table begins: a task holds a batch's links of one part, and its filters.
    """
    spark = links.sparkSession
    made: list[str] = []
    try:
        with scope(made):
            _join_spans(spark, table, number)
            keyed = stage(_keyed(links.select(*LINK).distinct(), parts), "batch-links")
            if keyed.isEmpty():
                return spark.createDataFrame([], LINKS)
            filters = read_buckets(spark, f"{table}/filters", FILTERS, touched(keyed, "part", parts), number)
            told = stage(keyed.groupBy("part").cogroup(filters.groupBy("part")).applyInPandas(known, T.StructType([*keyed.schema.fields, T.StructField("maybe", T.BooleanType())])), "told-links")
            maybe, fresh = told.where("maybe"), told
            doubtful = [r[0] for r in maybe.select("part").distinct().collect()]  # numbers below parts
            if doubtful:
                old, new = seen_links(spark, table, number, doubtful).alias("old"), maybe.alias("new")
                same = F.col("new.list_url").eqNullSafe(F.col("old.list_url")) & F.col("new.url").eqNullSafe(F.col("old.url"))
                fresh = told.where("not maybe").unionByName(new.join(old, same, "left_anti"))
            _write(fresh.select(*LINK, "part"), f"{table}/links/span={number}-{number}")
            fresh = _keyed(_read(spark, table, [(number, number)]).select(*LINK), parts)
            which = touched(fresh, "part", parts)
            filters = read_buckets(spark, f"{table}/filters", FILTERS, which, number)
            write_buckets(fresh.groupBy("part").cogroup(filters.groupBy("part")).applyInPandas(added, FILTERS), f"{table}/filters", number, which, "part", parts)
    finally:
        delete(spark, made)
    return fresh.select(*LINK)


def stream_seen_urls(links: DataFrame, table: str, checkpoint: str, within: str = "1 hour", sink: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None, parts: int = PARTS) -> StreamingQuery:
    """Store the links (list_url, url) of a stream, each once, whenever it comes again; seen_links() reads them, and sink gets the new ones of each batch with its number.

    State drops what comes again `within` a time of its arrival, so that busy links never meet the stored set; arrival is the time of the batch, so no link is late. A sink may get a batch again after a failure.
    """

    def commit(batch: DataFrame, number: int) -> None:
        fresh = add_links(batch, table, number, parts)
        if sink:
            sink(fresh, number)

    came = links.select(*LINK).withColumn("came", F.current_timestamp()).withWatermark("came", within).dropDuplicatesWithinWatermark(LINK)
    return came.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
