"""Approximate nearest rows: cells, codes of what a vector differs from its cell's centre by, and an exact ranking of a short list.

An index has two staged tables. `codes` holds, for each cell, blobs of codes: the unit vector less its centre is cut into parts, and each part is stored as the number of
the nearest of up to 256 codewords, a byte. `rows` holds the vectors, in order of cell and key, so that Parquet's statistics lead to the cells that are asked for.
A query looks into its nearest cells. A table of the products of its parts with all codewords gives the score of a code by one look-up a part; the best codes are the
short list, and only rows on it are read and scored exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeloom.operators.vectors import best_places, cosine, rows_of, vector_search
from gazeloom.staging import broadcast_if_small, stage, staged_batches, tidy

#: Rows from which an index is built, and the least number of cells (fixed values).
INDEX_ROWS, LEAST_CELLS = 256, 4
#: Rows, by smallest hash of the key about so many, from which centres and codewords are fitted, in one task; cells are not more than a sixteenth of them.
SAMPLE = 50_000
CODEWORDS = 256
#: Rows of a cell, and queries of a cell, that meet at once.
CODE_ROWS, PROBE_ROWS = 4096, 256
#: Closenesses of rows to centres that are held at once, and entries of short lists that a task holds before it gives them.
CLOSE, LISTED = 1 << 20, 1 << 20
#: Share of the nearest ten rows of a sampled vector whose cells are to be looked into.
COVERED = 0.97


@dataclass
class VectorIndex:
    """Staged tables of an index, its width, and how many cells a query looks into."""

    model: str
    codes: DataFrame
    rows: DataFrame
    width: int
    n: int
    cells: int
    nprobe: int
    key: str


def unit(m):
    import numpy as np

    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def fit_means(x, k: int, rounds: int = 10, seed: int = 1):
    """k-means: at most k centres. Begins with vectors drawn at random."""
    import numpy as np

    r = np.random.default_rng(seed)
    centres = x[np.sort(r.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def closeness(x, centres):
    """Falls with the distance of rows from centres."""
    out = x @ centres.T
    out -= (centres * centres).sum(1) / 2
    return out


def nearest(x, centres):
    import numpy as np

    rows = max(1, min(8192, CLOSE // len(centres)))
    return np.concatenate([np.empty(0, np.int64), *(closeness(x[at : at + rows], centres).argmax(1) for at in range(0, len(x), rows))])


def parts_of(width: int) -> int:
    """Parts of a vector: of four components where that goes out evenly, else the most even ones."""
    return next(n for n in (width // 4, width // 5, width // 3, width // 2, width) if n and width % n == 0) if width > 1 else 1


def fit(sample, cells: int, covered: float):
    """Centres, codewords of each part, and the number of cells that hold `covered` of the nearest rows of sampled vectors."""
    import numpy as np

    sample = unit(sample.astype(np.float64))
    centres = fit_means(sample, cells)
    centres = centres[np.unique(nearest(sample, centres))]  # no empty cells
    own = nearest(sample, centres)
    rest = (sample - centres[own]).reshape(len(sample), parts_of(sample.shape[1]), -1)
    few = rest[np.linspace(0, len(rest) - 1, min(len(rest), 64 * CODEWORDS)).astype(int)]
    words = [fit_means(few[:, p], CODEWORDS, 6) for p in range(rest.shape[1])]
    size = max(len(w) for w in words)
    words = np.stack([np.pad(w, ((0, size - len(w)), (0, 0)), mode="edge") for w in words])
    asked = np.linspace(0, len(sample) - 1, min(len(sample), 256)).astype(int)
    places = []
    for some in np.array_split(asked, max(1, len(asked) * len(sample) // CLOSE)):
        score = sample[some] @ sample.T
        score[np.arange(len(some)), some] = -np.inf
        q, c = best_places(score, 10)
        places.append(np.argsort(np.argsort(-closeness(sample[some], centres), axis=1), axis=1)[q, own[c]])
    return centres, words, int(np.quantile(np.concatenate(places), covered, method="higher")) + 1


def read_model(path: str):
    import numpy as np

    row = next(staged_batches(path, ["width", "centres", "words", "parts"], 1)).to_pylist()[0]
    centres = np.frombuffer(row["centres"], np.float64).reshape(-1, row["width"])
    return centres, np.frombuffer(row["words"], np.float64).reshape(row["parts"], -1, row["width"] // row["parts"])


def build_index(corpus: DataFrame, vector: str = "content_embedding", key: str = "news_id", sample: int = SAMPLE, nprobe: int | None = None, cells: int | None = None) -> VectorIndex:
    """An index over the vectors of the most frequent width; others, and rows without vector or key, are left out. Cells follow 2 * sqrt(n), nprobe what a sample shows (see COVERED); both can be given."""
    given = corpus.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
    first = given.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    width, n = (first["width"], first["n"]) if first else (0, 0)
    kind = dict(given.dtypes)["key"]
    given = given.where(F.size("v") == width)
    cells = min(max(1, n), cells or max(LEAST_CELLS, min(int(2 * math.sqrt(n)), sample // 16)))
    few = given.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n))) < sample).limit(2 * sample)

    def train(batches):
        import numpy as np
        import pyarrow as pa

        held = [rows_of(batch.column("v"), width)[0] for batch in batches]
        if sum(map(len, held)):
            centres, words, probes = fit(np.concatenate(held), cells, COVERED)
            yield pa.RecordBatch.from_pylist([{"width": width, "centres": centres.tobytes(), "words": words.tobytes(), "parts": len(words), "probes": probes, "cells": len(centres)}])

    model = stage(few.coalesce(1).mapInArrow(train, "width long, centres binary, words binary, parts long, probes long, cells long"), "ann-model")
    path, fitted = model._staged_at, model.select("probes", "cells").first()

    def place(batches):
        import pyarrow as pa

        centres, _ = read_model(path)
        for batch in batches:
            own = nearest(unit(rows_of(batch.column("v"), width)[0]), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype("i4"))], ["key", "v", "cell"])

    parts = max(1, min(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // CODE_ROWS))
    if fitted is None:
        rows = stage(given.select("key", "v", F.lit(0).alias("cell")), "ann-rows")
        return VectorIndex(path, stage(rows.select("cell", F.array("key").alias("keys"), F.lit(b"").alias("codes")), "ann-codes"), rows, width, 0, 0, 0, key)
    # A cell of many rows lies in several partitions.
    rows = stage(given.mapInArrow(place, f"key {kind}, v array<double>, cell int").repartitionByRange(parts, "cell", "key").sortWithinPartitions("cell", "key"), "ann-rows")

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        centres, words = read_model(path)
        for batch in batches:
            x, own = unit(rows_of(batch.column("v"), width)[0]), np.asarray(batch.column("cell"))
            rest = (x - centres[own]).reshape(len(x), len(words), -1)
            codes = np.stack([nearest(rest[:, p], words[p]) for p in range(len(words))], 1).astype(np.uint8)
            edges = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))  # rows of a cell stand together
            for begin, end in zip(edges, edges[1:], strict=False):
                for at in range(begin, end, CODE_ROWS):
                    keys = batch.column("key").slice(at, min(CODE_ROWS, end - at))
                    yield pa.RecordBatch.from_arrays([pa.array([own[at]], pa.int32()), pa.ListArray.from_arrays(np.array([0, len(keys)], np.int32), pa.concat_arrays([keys])), pa.array([codes[at : at + len(keys)].tobytes()], pa.binary())], ["cell", "keys", "codes"])

    codes = stage(rows.mapInArrow(encode, f"cell int, keys array<{kind}>, codes binary"), "ann-codes")
    return VectorIndex(path, codes, rows, width, n, fitted["cells"], min(fitted["cells"], nprobe or fitted["probes"]), key)


def search_index(index: VectorIndex, queries: DataFrame, k: int, nprobe: int | None = None, short: int | None = None) -> DataFrame:
    """query_id, key, score (exact cosine), rank of about the k nearest rows of each query (query_id, vector). short: rows that are scored exactly for each query, by default ten times k, but no more than a tenth of
    the rows and no less than k. Queries of another width, or without a vector, find nothing."""
    asked = queries.where(F.col("query_id").isNotNull() & (F.size("vector") == index.width)).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    kinds = dict(asked.dtypes)["query_id"], dict(index.rows.dtypes)["key"]
    nprobe, path, width = min(index.cells, nprobe or index.nprobe), index.model, index.width
    short = short or max(k, min(10 * k, index.n // 10))

    def probe(batches):
        import numpy as np
        import pyarrow as pa

        centres, _ = read_model(path)
        # As many queries at once as leave room for their places among all cells; a block of queries is no smaller for it.
        rows = max(PROBE_ROWS, CLOSE // len(centres))
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            x = unit(rows_of(batch.column("vector"), width)[0])
            q, c = best_places(closeness(x, centres), nprobe)
            for cell in np.unique(c):
                own = q[c == cell]
                for at in range(0, len(own), PROBE_ROWS):
                    some = own[at : at + PROBE_ROWS]
                    ids = batch.column("query_id").take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.ListArray.from_arrays(np.array([0, len(ids)], np.int32), ids), pa.array([x[some].tobytes()], pa.binary())], ["cell", "ids", "asked"])

    probes = asked.mapInArrow(probe, f"cell int, ids array<{kinds[0]}>, asked binary")

    def look_up(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names, held, n = ["query_id", "key", "cell", "near"], [], 0
        least: dict = {}  # what a query's row must reach, once this task has found enough for it: a number a query

        def best():
            """What is held, but for each query only its best so far."""
            rows = pa.Table.from_batches(held)
            rows = rows.take(pc.sort_indices(rows, [("query_id", "ascending"), ("near", "descending"), ("key", "ascending")])).combine_chunks()
            ids = rows.column("query_id").combine_chunks()
            firsts = np.concatenate([[0], np.flatnonzero(np.asarray(pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True))) + 1])
            sizes = np.diff(np.append(firsts, len(ids)))
            enough = firsts[sizes >= short] + short - 1
            least.update(zip(ids.take(pa.array(enough)).to_pylist(), np.asarray(rows.column("near"))[enough].tolist(), strict=True))
            kept = np.arange(len(ids)) - np.repeat(firsts, sizes) < short
            return rows.filter(pa.array(kept)).combine_chunks().to_batches()

        centres, words = read_model(path)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                ids, keys, cell = row.column("ids")[0].values, row.column("keys")[0].values, row.column("cell")[0].as_py()
                x = np.frombuffer(row.column("asked")[0].as_py(), np.float64).reshape(len(ids), width)
                codes = np.frombuffer(row.column("codes")[0].as_py(), np.uint8).reshape(len(keys), len(words))
                products = np.einsum("qpd,pwd->pqw", x.reshape(len(ids), len(words), -1), words)
                score = np.repeat((x @ centres[cell])[:, None], len(keys), axis=1)
                for p in range(len(words)):
                    score += products[p][:, codes[:, p]]
                own = ids.to_pylist()
                score[score < np.array([least.get(i, -np.inf) for i in own])[:, None]] = -np.inf
                q, c = best_places(score, short)
                for i in np.flatnonzero(np.bincount(q, minlength=len(own)) == short):
                    least[own[i]] = score[i, c[np.searchsorted(q, i, "right") - 1]]
                held.append(pa.RecordBatch.from_arrays([ids.take(pa.array(q)), keys.take(pa.array(c)), pa.array(np.full(len(q), cell, np.int32)), pa.array(score[q, c])], names))
                n += len(q)
                if n >= LISTED:
                    held = best()
                    n = sum(part.num_rows for part in held)
                    if n > LISTED // 2:  # many queries: what they have so far goes on to Spark
                        yield from held
                        held, n = [], 0
        if n:
            yield from best()

    seen = probes.join(index.codes, "cell").mapInArrow(look_up, f"query_id {kinds[0]}, key {kinds[1]}, cell int, near double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "key"))
    listed = stage(seen.withColumn("place", place).where(F.col("place") <= short).select("query_id", "key", "cell"), "ann-short-list")
    held = index.rows.join(broadcast_if_small(listed), ["cell", "key"])
    found = held.join(broadcast_if_small(asked), "query_id").select("query_id", F.col("key").alias(index.key), cosine(F.col("vector"), F.col("v")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), index.key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


@tidy
def ann_search(queries: DataFrame, corpus: DataFrame, k: int, nprobe: int | None = None, vector: str = "content_embedding", key: str = "news_id", sample: int = SAMPLE, short: int | None = None) -> DataFrame:
    """Approximate vector_search: an index of the corpus, used once. Below INDEX_ROWS rows the search is exact. To search an index again, keep what build_index() gives."""
    if corpus.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).limit(INDEX_ROWS).count() < INDEX_ROWS:
        return vector_search(queries, corpus, k, vector, key)
    return search_index(build_index(corpus, vector, key, sample, nprobe), queries, k, short=short)
