"""Embeddings by a pluggable encoder, similarities, exact nearest rows and tags by similarity."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom.staging import new_path, stage, staged_batches

STRICT, RELAXED, MAX_TAGS = 0.75, 0.5, 5


def hashing_encoder(width: int) -> Callable:
    """The default encoder: signed hashes of words, normalised. Deterministic and without a model. A word's first 32 bits of MD5 give its place (modulo the width) and, by the highest, its sign."""
    known: dict[str, int] = {}

    def encode(texts: list[str]):
        import hashlib

        import numpy as np

        out = np.zeros((len(texts), width), np.float32)
        for row, text in enumerate(texts):
            hashes = []
            for word in text.lower().split():
                h = known.get(word)
                if h is None:
                    if len(known) > 100_000:
                        known.clear()
                    h = known[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
                hashes.append(h)
            h = np.array(hashes, np.int64)
            np.add.at(out[row], h % width, np.where(h >> 31, 1, -1))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return encode


#: Encoders of this Python worker by the function that makes them and their width, so that a model is loaded once for each worker, not for each task.
_encoders: dict[tuple, Callable] = {}
MOST_ENCODERS = 8
#: What is put before a query, and only there, for encoders that were trained so (fixed value).
QUERY_PREFIX = "为这个句子生成表示以用于检索相关文章："


def worker_encoder(make: Callable[[int], Callable], width: int) -> Callable:
    """make(width), made once in this worker. A function arrives in each task as a new object, so it is known by what it is sent as."""
    from pyspark import cloudpickle

    key = (cloudpickle.dumps(make), width)
    if key not in _encoders:
        while len(_encoders) >= MOST_ENCODERS:
            _encoders.pop(next(iter(_encoders)))
        _encoders[key] = make(width)
    return _encoders[key]


#: Rows that a worker embeds and gives back at once: their vectors, as Arrow makes them of single arrays, are what it holds.
EMBED_ROWS = 1024


def embed_columns(df: DataFrame, columns: dict[str, tuple[str, int]], encoder: Callable[[int], Callable] = hashing_encoder, normalise: bool = True, batch: int = 32, failures=None, prefix: str = "") -> DataFrame:
    """Adds vectors: columns maps a new column to (text column, width); encoder(width) gives a function of a list of texts.

    Blank texts, and batches for which the encoder fails, give zero vectors; vectors are cut or filled with zeros to their width. failures, an accumulator of
    the caller (SparkContext.accumulator(0)), counts the texts whose batch failed, so that a dead encoder shows. prefix is put before each text that isn't blank.
    A worker makes each encoder once and keeps it.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.ArrayType(T.FloatType())) for name in columns]])

    def run(frames):
        import numpy as np

        tools = {width: worker_encoder(encoder, width) for _, width in columns.values()}
        for frame in (whole.iloc[at : at + EMBED_ROWS].copy() for whole in frames for at in range(0, len(whole), EMBED_ROWS)):
            for name, (text, width) in columns.items():
                out = np.zeros((len(frame), width), np.float32)
                full = [k for k, x in enumerate(frame[text]) if isinstance(x, str) and x.strip()]
                for at in range(0, len(full), batch):
                    part = full[at : at + batch]
                    try:
                        found = np.asarray(tools[width]([prefix + frame[text].iloc[k] for k in part]), np.float32)
                    except Exception:  # noqa: BLE001  the encoder is the caller's
                        if failures is not None:
                            failures.add(len(part))
                        continue
                    out[part, : min(width, found.shape[1])] = found[:, :width]
                if normalise:
                    norm = np.linalg.norm(out, axis=1, keepdims=True)
                    out = out / np.where(norm == 0, 1, norm)
                frame[name] = list(out)
            yield frame

    return df.mapInPandas(run, schema)


def embed_queries(queries: DataFrame, width: int, encoder: Callable[[int], Callable] = hashing_encoder, prefix: str = "", text: str = "query") -> DataFrame:
    """queries with column vector: the embedding of each query, with a prefix before it that articles don't have. QUERY_PREFIX is for encoders that were trained with it; the default encoder takes queries as it takes texts."""
    return embed_columns(queries, {"vector": (text, width)}, encoder, prefix=prefix)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where a vector is zero, null where one is null."""
    size = norm(a) * norm(b)
    return F.when(size.isNull(), None).when(size == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def euclidean_similarity(a: Column, b: Column) -> Column:
    far = euclidean(a, b)
    return F.when(far.isNotNull(), 1 - F.least(far / math.sqrt(2), F.lit(1.0)))


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def weighted_sum(a: Column, b: Column, wa: float, wb: float) -> Column:
    """wa * a + wb * b; an error where widths differ."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different width"))).otherwise(F.zip_with(a, b, lambda x, y: x.cast("double") * wa + y.cast("double") * wb))


#: Queries of a block whose scores are divided, or looked through, at once.
STRETCH = 32


def scores(asked, sizes, rows, similarity: str):
    """Similarities of query vectors (with their lengths) to rows, as a matrix."""
    import numpy as np

    product = asked @ rows.T
    if similarity == "cosine":
        lengths = np.linalg.norm(rows, axis=1)
        for at in range(0, len(product), STRETCH):  # in place, so that there is one such matrix
            part, scale = product[at : at + STRETCH], np.outer(sizes[at : at + STRETCH], lengths)
            np.divide(part, scale, out=part, where=scale != 0)
            np.clip(part, -1, 1, out=part)
            part[scale == 0] = 0.0
        return product
    far = np.sqrt(np.maximum(0, sizes[:, None] ** 2 + (rows * rows).sum(1)[None, :] - 2 * product))
    return 1 - np.minimum(far / math.sqrt(2), 1)


#: Queries in a block, and rows that are held against a block at once.
QUERY_BLOCK, ROW_BLOCK = 512, 8192


def rows_of(column, width: int):
    """The vectors of one width in an Arrow column of arrays, as a matrix of doubles, and their places."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    places = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == width)
    part = column.take(places)
    return np.asarray(part.flatten(), np.float64).reshape(len(places), width), places


def query_blocks(queries: DataFrame) -> DataFrame:
    """Queries (query_id, vector) as a staged table of blocks, a row for each block and width: width, ids, and the vectors as 64-bit numbers. Rows without a vector are left out."""
    name = dict(queries.dtypes)["query_id"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lengths = batch.column("vector").value_lengths()
            for width in sorted(set(lengths.to_pylist())):
                m, places = rows_of(batch.column("vector"), width)
                for at in range(0, len(places), QUERY_BLOCK):
                    ids = batch.column("query_id").take(places[at : at + QUERY_BLOCK])
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.ListArray.from_arrays(np.array([0, len(ids)], np.int32), ids), pa.array([m[at : at + QUERY_BLOCK].tobytes()], pa.binary())], ["width", "ids", "data"])

    return stage(queries.where(F.col("vector").isNotNull()).select("query_id", "vector").mapInArrow(run, f"width int, ids array<{name}>, data binary"), "query-blocks")


def best_places(score, want: int):
    """Rows and columns of the `want` highest scores of each row (all that are over -inf, if fewer), equal ones by column."""
    import numpy as np

    if score.shape[1] > want:
        # The last score that counts, and all that reach it: few more than want, unless scores tie.
        kth = np.concatenate([np.empty(0), *(np.partition(score[at : at + STRETCH], score.shape[1] - want, axis=1)[:, score.shape[1] - want].copy() for at in range(0, len(score), STRETCH))])
        q, c = np.nonzero((score >= kth[:, None]) & (score > -np.inf))
    else:
        q, c = np.nonzero(score > -np.inf)
    order = np.lexsort((c, -score[q, c], q))
    q, c = q[order], c[order]
    firsts = np.flatnonzero(np.diff(q, prepend=-1))
    kept = np.arange(len(q)) - np.repeat(firsts, np.diff(np.append(firsts, len(q)))) < want
    return q[kept], c[kept]


def equal_keys(a, b):
    """Pairs of places at which two Arrow arrays hold the same."""
    import numpy as np
    import pyarrow as pa

    codes = pa.chunked_array([a, b.cast(a.type)]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    left, right = codes[: len(a)], codes[len(a) :]
    order = np.argsort(right, kind="stable")
    low, high = np.searchsorted(right[order], left, "left"), np.searchsorted(right[order], left, "right")
    places = np.repeat(np.arange(len(a)), high - low)
    return places, order[np.repeat(low, high - low) + np.arange(len(places)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]


def vector_search(queries: DataFrame, corpus: DataFrame, k: int, vector: str = "content_embedding", key: str = "news_id", similarity: str = "cosine", exclude_self: bool = False, offset: int = 0) -> DataFrame:
    """query_id, key, score, rank of the k nearest corpus rows of each query; ties to the smaller key.

    queries: query_id, vector. Queries are a staged table of blocks, which tasks read from the shared folder: one scan of the corpus serves all of them, and none passes through the driver. A task holds
    ROW_BLOCK rows and one block at a time and gives the best k + offset of these for each query; before the shuffle a task's own ones are ranked once more.
    Rows without a vector of the query's width never match.
    """
    want = k + offset
    kinds = dict(corpus.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    path = query_blocks(queries)._staged_at

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def search(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.take(pc.sort_indices(rows, [(key, "ascending")]))  # so that equal scores stand by key
            keys, found = rows.column(key).combine_chunks(), {}
            for part in staged_batches(path, ["width", "ids", "data"], 1):
                width = part.column("width")[0].as_py()
                ids = part.column("ids")[0].values
                if width not in found:
                    m, places = rows_of(rows.column(vector), width)
                    found[width] = m, keys.take(places)
                m, own = found[width]
                if not len(own):
                    continue
                asked = np.frombuffer(part.column("data")[0].as_py(), np.float64).reshape(len(ids), width)
                score = scores(asked, np.linalg.norm(asked, axis=1), m, similarity)
                if exclude_self:
                    score[equal_keys(ids, own)] = -np.inf
                q, c = best_places(score, want)
                yield pa.RecordBatch.from_arrays([ids.take(q), own.take(c), pa.array(score[q, c])], ["query_id", key, "score"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROW_BLOCK:
                yield from search(held)
                held, n = [], 0
        if n:
            yield from search(held)

    found = corpus.select(key, vector).where(F.col(vector).isNotNull() & F.col(key).isNotNull()).mapInArrow(run, f"query_id {kinds['query_id']}, {key} {kinds[key]}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= want)
    return ranked.where(F.col("rank") > offset).withColumn("rank", F.col("rank") - offset) if offset else ranked


def nearest_neighbours(corpus: DataFrame, k: int, vector: str = "content_embedding", key: str = "news_id", similarity: str = "cosine", block_rows: int = ROW_BLOCK) -> DataFrame:
    """query_id, key, score, rank: for every row with a vector its k nearest other rows; ties to the smaller key.

    A blocked self-join: rows are dealt into blocks by a hash of the key, and each pair of blocks meets once, in one matrix product from which both sides take their best. Block i meets the blocks behind it, half way round the circle of
    blocks, so every block carries the same load. Keys are unique; rows without a vector, or with a null key, take no part; vectors of different width never meet.
    """
    kind = dict(corpus.dtypes)[key]
    given = corpus.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where("key is not null and vector is not null")
    n = max(1, math.ceil(given.count() / block_rows))
    placed = given.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).withColumn("width", F.size("vector"))
    packed = placed.repartition(min(n, 4 * int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block").groupBy("block", "width").agg(F.array_sort(F.collect_list(F.struct("key", "vector"))).alias("rows"))
    blocks = stage(packed.select("block", "width", F.col("rows.key").alias("keys"), F.flatten("rows.vector").alias("data")), "vector-blocks")  # about block_rows rows each, by the hash
    met = blocks.withColumn("other", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda d: F.pmod(F.col("block") + d, F.lit(n)))))
    if n % 2 == 0:  # the block opposite is met from one side
        met = met.where((F.col("block") < n // 2) | (F.pmod(F.col("other") - F.col("block"), F.lit(n)) < n // 2))
    pairs = met.join(blocks.select(F.col("block").alias("other"), "width", F.col("keys").alias("other_keys"), F.col("data").alias("other_data")), ["other", "width"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                width = row.column("width")[0].as_py()
                (a, x), (b, y) = ((row.column(names)[0].values, np.asarray(row.column(data)[0].values).reshape(len(row.column(names)[0].values), width)) for names, data in (("keys", "data"), ("other_keys", "other_data")))
                same = row.column("block")[0] == row.column("other")[0]
                # Stretches of one side, so that no matrix has more than ROW_BLOCK * QUERY_BLOCK scores.
                for begin in range(0, len(a), QUERY_BLOCK):
                    own, part = a[begin : begin + QUERY_BLOCK], x[begin : begin + QUERY_BLOCK]
                    score = scores(part, np.linalg.norm(part, axis=1), y, similarity)
                    if same:
                        score[np.arange(len(own)), begin + np.arange(len(own))] = -np.inf
                    q, c = best_places(score, k)
                    yield pa.RecordBatch.from_arrays([own.take(q), b.take(c), pa.array(score[q, c])], ["query_id", "key", "score"])
                    if not same:
                        q, c = best_places(np.ascontiguousarray(score.T), k)
                        yield pa.RecordBatch.from_arrays([b.take(q), own.take(c), pa.array(score.T[q, c])], ["query_id", "key", "score"])

    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pairs.repartition(parts, "block", "other").mapInArrow(run, f"query_id {kind}, key {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "score", "rank")


def embed_tags(tags: DataFrame, manual: DataFrame | None = None, encoder: Callable[[int], Callable] = hashing_encoder, width: int = 1024) -> DataFrame:
    """Tag definitions (tag_id, name, description, category), automatic and manual ones, with an embedding of 'name: description'."""
    both = tags.unionByName(manual) if manual is not None else tags
    both = both.where("tag_id is not null and name is not null").withColumn("category", F.coalesce("category", F.lit("general")))
    text = F.concat(F.col("name"), F.lit(": "), F.coalesce("description", F.lit("")))
    return embed_columns(both.withColumn("_text", text), {"embedding": ("_text", width)}, encoder).drop("_text")


#: Scores of articles and tags that a task holds at once, and rows of a result that it holds before it cuts them to the best of each article.
TAG_SCORES, TAG_MATCHES = 4_000_000, 1_000_000
#: Tags from which the cells are fitted (they change the work, not the result), the most cells, and tags of a cell below that number.
TAG_SAMPLE, TAG_CELLS, CELL_TAGS = 4096, 256, 64


def tag_blocks(tags: DataFrame, similarity: str) -> str:
    """Where tags (query_id, vector) are staged in blocks of tags of one width that lie near each other: width, ids, data, and the block's centre and radius, an angle for cosine, else a distance."""
    import numpy as np

    from gazeloom.operators.ann import fit_means, nearest, unit

    spark, name = tags.sparkSession, dict(tags.dtypes)["query_id"]
    n = tags.count()
    cells = min(TAG_CELLS, math.ceil(n / CELL_TAGS))
    made: dict[int, list] = {}
    for row in tags.orderBy(F.xxhash64("query_id")).limit(TAG_SAMPLE).select("vector").toLocalIterator() if cells > 1 else []:
        made.setdefault(len(row["vector"]), []).append(row["vector"])
    shaped = (lambda m: unit(m)) if similarity == "cosine" else (lambda m: m)
    centres = {width: fit_means(np.nan_to_num(shaped(np.asarray(rows, np.float64))), cells) for width, rows in made.items() if width}

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for width, middle in centres.items():
                m, places = rows_of(batch.column("vector"), width)
                cell[places] = nearest(np.nan_to_num(shaped(m)), middle)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vector"), pa.array(cell), batch.column("vector").value_lengths()], ["query_id", "vector", "cell", "width"])

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            kind = np.stack([np.asarray(batch.column("width")), np.asarray(batch.column("cell"))])
            edges = [0, *(np.flatnonzero((np.diff(kind) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:], strict=False):
                width = int(kind[0, begin]) if end > begin else 0
                for at in range(begin, end, QUERY_BLOCK):
                    own = batch.slice(at, min(QUERY_BLOCK, end - at))
                    ids, part = own.column("query_id"), rows_of(own.column("vector"), width)[0]
                    shape = shaped(part)
                    middle = shape.mean(axis=0)
                    if similarity == "cosine":  # a vector of no length or direction is near everything
                        radius = np.arccos(np.clip(shape @ unit(middle[None])[0], -1, 1)).max() if np.isfinite(part).all() and (part != 0).any(axis=1).all() and middle.any() else math.pi
                    else:
                        radius = np.linalg.norm(shape - middle, axis=1).max() if np.isfinite(part).all() else math.inf
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.ListArray.from_arrays(np.array([0, len(ids)], np.int32), ids), pa.array([part.tobytes()], pa.binary()), pa.array([middle.tobytes()], pa.binary()), pa.array([float(radius)])], ["width", "ids", "data", "centre", "radius"])

    path = new_path(spark, "tag-blocks")
    placed = tags.mapInArrow(place, f"query_id {name}, vector array<float>, cell int, width int").orderBy("width", "cell", "query_id")
    # A block is a row group, so that a task reads the blocks that its rows can reach.
    placed.mapInArrow(pack, f"width int, ids array<{name}>, data binary, centre binary, radius double").write.option("parquet.block.size", 1 << 18).option("parquet.block.size.row.check.min", 1).option("parquet.block.size.row.check.max", 1).parquet(path)
    return path


def highest_scores(rows, centre, radius: float, similarity: str):
    """For each row the score that no vector of a block exceeds."""
    import numpy as np

    if not math.isfinite(radius) or not np.isfinite(centre).all():
        return np.full(len(rows), np.inf)
    if similarity == "cosine":
        size = np.linalg.norm(rows, axis=1) * np.linalg.norm(centre)
        angle = np.arccos(np.clip(rows @ centre / np.where(size == 0, 1, size), -1, 1))
        most = np.where(size == 0, 1.0, np.cos(np.maximum(0, angle - radius)))
    else:
        most = 1 - np.minimum(np.maximum(0, np.linalg.norm(rows - centre, axis=1) - radius) / math.sqrt(2), 1)
    return np.where(np.isnan(most), np.inf, most + 1e-6)  # room for rounding


def match_tags(articles: DataFrame, tags: DataFrame, threshold: float = STRICT, max_tags: int = MAX_TAGS, similarity: str = "cosine", vector: str = "content_embedding", key: str = "news_id", digits: int | None = None) -> DataFrame:
    """key, tag_id, score, rank: the tags of each article that are similar enough, best first; ties to the smaller tag_id. Tags (tag_id, embedding) of another width than the article's are ignored.
    With digits, scores are rounded to so many before they meet the threshold and each other, so that neither it nor ties hang on the rounding of the vectors.

    Tags are a staged table of blocks of tags near each other, which tasks read from the shared folder one at a time; an article meets the blocks whose centre and radius leave room for the threshold, and the others aren't
    read. So the number of tags has no bound; of them a sample of TAG_SAMPLE passes through the driver.
    """
    given = tags.where(F.col("embedding").isNotNull() & F.col("tag_id").isNotNull()).select(F.col("tag_id").alias("query_id"), F.col("embedding").cast("array<float>").alias("vector"))
    path = tag_blocks(given, similarity)
    kinds = dict(articles.dtypes)[key], dict(tags.dtypes)["tag_id"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        def best(q, score, names):
            """The best of each article: places, scores, tags and ranks."""
            tag = np.unique(names, return_inverse=True)[1]
            order = np.lexsort((tag, -score, q))
            q, score, names = q[order], score[order], names[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
            kept = rank <= max_tags
            return q[kept], score[kept], names[kept], rank[kept]

        def match(rows):
            by_width: dict[int, tuple] = {}
            q, score, names = np.empty(0, np.int64), np.empty(0), np.empty(0, object)
            for at in files:
                with store.open_input_file(at) as source:
                    blocks = pq.ParquetFile(source)
                    for group in range(blocks.num_row_groups):
                        heads = blocks.read_row_group(group, ["width", "centre", "radius"]).to_pylist()
                        near = []
                        for head in heads:
                            if head["width"] not in by_width:
                                by_width[head["width"]] = rows_of(rows.column(vector), head["width"])
                            near.append(np.flatnonzero(highest_scores(by_width[head["width"]][0], np.frombuffer(head["centre"], np.float64), head["radius"], similarity) >= threshold))
                        if not any(map(len, near)):
                            continue
                        held = blocks.read_row_group(group, ["ids", "data"])
                        for n, (head, some) in enumerate(zip(heads, near, strict=True)):
                            if not len(some):
                                continue
                            m, places = by_width[head["width"]]
                            ids = np.array(held.column("ids")[n].as_py(), dtype=object)
                            asked = np.frombuffer(held.column("data")[n].as_py(), np.float64).reshape(len(ids), head["width"])
                            found = scores(asked, np.linalg.norm(asked, axis=1), m[some], similarity).T
                            if digits is not None:
                                found = np.round(found, digits)
                            a, c = np.nonzero(found >= threshold)
                            q, score, names = np.concatenate([q, places[some[a]]]), np.concatenate([score, found[a, c]]), np.concatenate([names, ids[c]])
                            if len(q) > TAG_MATCHES:
                                q, score, names, _ = best(q, score, names)
            q, score, names, rank = best(q, score, names)
            yield pa.RecordBatch.from_arrays([rows.column(key).take(pa.array(q)), pa.array(names.tolist(), tag_type), pa.array(score), pa.array(rank.astype(np.int32))], [key, "tag_id", "score", "rank"])

        store, root = fs.FileSystem.from_uri(path)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
        tag_type = next((part.column("ids").type.value_type for part in staged_batches(path, ["ids"], 1)), None)
        for batch in batches:
            if tag_type is None:
                return
            for at in range(0, batch.num_rows, TAG_SCORES // QUERY_BLOCK):
                yield from match(batch.slice(at, TAG_SCORES // QUERY_BLOCK))

    return articles.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"{key} {kinds[0]}, tag_id {kinds[1]}, score double, rank int")


def find_tags(tags: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Tags whose name holds words of the query, by BM25 over names: the k best, with score and rank."""
    from gazeloom.operators.retrieval import fulltext_search

    asked = tags.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    hits = fulltext_search(asked, tags, k, ("name",), "tag_id").drop("query_id")
    return tags.join(F.broadcast(hits), "tag_id")  # at most k rows


def merge_tags(articles: DataFrame, matches: DataFrame, key: str = "news_id") -> DataFrame:
    """Articles with matched tags behind their own ones, best first, each once."""
    found = matches.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag_id"))), lambda x: x["tag_id"]).alias("_found"))
    empty = F.array().cast("array<string>")
    joined = articles.join(found, key, "left").withColumn("tags", F.array_distinct(F.concat(F.coalesce("tags", empty), F.coalesce("_found", empty))))
    return joined.select(articles.columns)


def similar_tags(vectors: DataFrame, tags: DataFrame, k: int, threshold: float = 0.0, key: str = "news_id", vector: str = "content_embedding") -> DataFrame:
    """The k most similar tags of each vector that reach the threshold."""
    return match_tags(vectors, tags, threshold, k, "cosine", vector, key)
