"""Operator 7: exact top-k by inner product with block-at-a-time pruning.

Vectors are dealt into ranges. Within a range, a tree of cuts along the widest
component lays similar vectors side by side, and the range is cut into blocks. A block
keeps its forward index (the vectors themselves) and, for each component, its largest
and smallest value. For a query, the sum over components of the better of
component * largest and component * smallest bounds every score in the block.

A first pass gives each query a k-th score to start from: that among PILOT_ROWS vectors of one range, which is a mixture of all rows. A final
k-th score is never below it, so it holds in every range. Bounds are taken on two levels: of supers, each some
neighbouring blocks, then of the blocks in those supers that a query still needs. Blocks are visited in order of their bounds, and a query's visit ends when the
bound falls below its k-th score so far. Queries are taken together: one block is scored for all queries that still need it by one matrix product.

Every range is visited for every block of queries; each gives its best k per query that reach the first pass's score, and a ranking keeps the best k of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeloom.llm.common import stage, staged_batches, table, tidy
from gazeloom.llm.vector_tables import LARGEST, LEAST, exact_dtype, fitting, met, packed, quantise, ranges_of, vectors_of

BLOCK = 64
SUPER = 16
RANGE_ROWS = 8192
QUERY_ROWS = 1024
PILOT_ROWS = 512
#: Widths of vectors that get a pilot; others start from nothing.
PILOT_WIDTHS = 16
SCALE = 64


def cut(matrix, rows, size: int) -> list:
    """Row numbers in blocks of at most `size`, by halving at the median of the widest component."""
    import numpy as np

    todo, out = [rows], []
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(part)
            continue
        own = matrix[part]
        spread = own.max(0) - own.min(0)
        order = np.argsort(own[:, int(spread.argmax())], kind="stable")
        half = len(part) // 2
        todo += [part[order[half:]], part[order[:half]]]
    return out


def bounds(asked, top, low):
    """Upper bounds of each query's scores in each box of components from low to top."""
    import numpy as np

    return np.maximum(asked, 0) @ top.T + np.minimum(asked, 0) @ low.T


def search_range(ids, matrix, query_ids, queries, k: int, block: int = BLOCK, start=None):
    """Each query's best k among these rows, its own id left out; ties to the smaller id. start: for each query a score that its final k-th is not below.

    Returns query numbers, ids, scores, and the number of blocks visited, over all queries, with the number there are. Rows below start are left out.
    """
    import numpy as np

    kind = exact_dtype(matrix, queries)
    blocks = cut(matrix.astype(np.float64), np.arange(len(ids)), block)
    data, asked = matrix.astype(kind), queries.astype(kind)
    top = np.stack([data[b].max(0) for b in blocks])
    low = np.stack([data[b].min(0) for b in blocks])
    none = np.iinfo(np.int64).min
    start = np.full(len(asked), none, np.int64) if start is None else np.asarray(start, np.int64)
    # Blocks lie in the order of the tree, so neighbours are alike and their supers are narrow.
    edges = np.arange(0, len(blocks), SUPER)
    rough = bounds(asked, np.maximum.reduceat(top, edges, axis=0), np.minimum.reduceat(low, edges, axis=0))
    wanted = np.repeat(rough >= start[:, None], np.diff(np.append(edges, len(blocks))), axis=1)
    bound = np.full((len(asked), len(blocks)), -np.inf if kind is np.float64 else none, dtype=kind)
    needed = np.flatnonzero(wanted.any(0))
    if len(needed):
        bound[:, needed] = bounds(asked, top[needed], low[needed])
    wanted &= bound >= start[:, None]
    todo = wanted.sum(1)
    order = np.argsort(np.where(wanted, 0, 1) if kind is object else np.where(wanted, -bound, np.inf if kind is np.float64 else LARGEST), axis=1, kind="stable")
    if kind is object:  # numpy has no order of masked Python integers
        order = np.array([[*sorted(np.flatnonzero(w), key=lambda c, row=b: -row[c]), *np.flatnonzero(~w)] for w, b in zip(wanted, bound, strict=True)])
    best_score = np.full((len(asked), 0), 0, np.int64)
    best_id = np.full((len(asked), 0), 0, np.int64)
    valid = np.zeros((len(asked), 0), bool)
    open_ = np.ones(len(asked), bool)
    visited = 0
    for step in range(len(blocks)):
        open_ &= todo > step
        rows = np.flatnonzero(open_)
        if valid.shape[1] >= k:
            kth = np.where(valid[rows].sum(1) >= k, np.where(valid[rows], best_score[rows], LARGEST).min(1), none)
            ended = (bound[rows, order[rows, step]] < kth).astype(bool)
            open_[rows[ended]] = False
            rows = rows[~ended]
        if not len(rows):
            break
        visited += len(rows)
        found_score = np.zeros((len(asked), block), np.int64)
        found_id = np.zeros((len(asked), block), np.int64)
        found = np.zeros((len(asked), block), bool)
        for b in np.unique(order[rows, step]):
            own = rows[order[rows, step] == b]
            members = blocks[b]
            score = fitting(asked[own] @ data[members].T)
            found_score[own, : len(members)] = score
            found_id[own, : len(members)] = ids[members]
            found[own, : len(members)] = (ids[members][None, :] != query_ids[own][:, None]) & (score >= start[own][:, None])
        score = np.concatenate([best_score, found_score], 1)[rows]
        name = np.concatenate([best_id, found_id], 1)[rows]
        ok = np.concatenate([valid, found], 1)[rows]
        keep = np.lexsort((name, np.where(ok, -score, LARGEST), ~ok), axis=1)[:, :k]
        width = keep.shape[1]
        if best_score.shape[1] < width:
            more = width - best_score.shape[1]
            best_score, best_id, valid = (np.pad(x, ((0, 0), (0, more))) for x in (best_score, best_id, valid))
        best_score[rows, :width], best_id[rows, :width], valid[rows, :width] = (np.take_along_axis(x, keep, 1) for x in (score, name, ok))
    q, place = np.nonzero(valid)
    return q, best_id[q, place], best_score[q, place], (visited, len(asked) * len(blocks))


def starting(batches, pilot_path: str, rows: int, k: int):
    """Blocks of queries with starts: each query's k-th score among the first rows of the pilot's range of its width, or the least integer where there are fewer others."""
    import numpy as np
    import pyarrow as pa

    pilots: dict[int, dict] = {}
    for part in staged_batches(pilot_path, ["no", "dim", "ids", "data"], 1):
        row = part.to_pylist()[0]
        if row["dim"] not in pilots or row["no"] < pilots[row["dim"]]["no"]:
            pilots[row["dim"]] = row
    for batch in batches:
        for at in range(batch.num_rows):
            part = batch.slice(at, 1)
            row = part.to_pylist()[0]
            names, asked = vectors_of(row)
            starts = np.full(len(names), LEAST, "<i8")
            if row["dim"] in pilots:
                ids, data = vectors_of(pilots[row["dim"]])
                q, _, score, _ = search_range(ids[:rows], data[:rows], names, asked, k)
                lowest = np.full(len(names), LARGEST, "<i8")
                np.minimum.at(lowest, q, score)
                full = np.bincount(q, minlength=len(names)) >= k
                starts[full] = lowest[full]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([starts.tobytes()], pa.binary())], [*part.schema.names, "starts"])


@tidy
def block_topk(candidates: DataFrame, queries: DataFrame, k: int = 20, range_rows: int = RANGE_ROWS, query_rows: int = QUERY_ROWS, scale: int = SCALE, pilot_rows: int = PILOT_ROWS) -> DataFrame:
    """The k candidates of highest integer inner product for each query row.

    Both frames have vec_id and embedding; further columns are not read. Components x become floor(scale * x). Returns query_id,
    rank (from 1), vec_id, score; ties go to the smaller vec_id; a candidate with the query's own vec_id is left
    out; a query with fewer candidates returns all of them. Vectors that are null, empty, or hold a null or non-finite component, and null
    vec_ids, take no part; vectors of different width never meet. Repeated candidate rows count each, repeated query rows once.
    A score or component beyond 63 bits is an error. Candidates are dealt into ranges of range_rows and queries into blocks of query_rows, so that
    a task holds one range and one block at a time. Where there are several ranges, pilot_rows vectors of one of them give each query a score to start from; they change no result.
    """
    vectors = quantise(candidates, scale).where(F.size("v") > 0)
    ranges = ranges_of(vectors, candidates.count(), range_rows)
    asked = quantise(queries, scale).where(F.size("v") > 0).dropDuplicates(["vec_id"])
    blocks = stage(packed(asked, query_rows), "query-blocks")
    # A pilot of all rows would be the search itself.
    if ranges.count() > 1:
        first = ranges.groupBy("dim").agg(F.min("no").alias("no"))
        pilot = stage(ranges.join(F.broadcast(first) if first.count() <= PILOT_WIDTHS else first, ["dim", "no"]).limit(PILOT_WIDTHS), "pilot")._staged_at
        blocks = stage(blocks.mapInArrow(lambda batches: starting(batches, pilot, pilot_rows, k), "no long, dim long, ids binary, data binary, starts binary"), "started")

    def search(row, queries_of):
        import numpy as np
        import pyarrow as pa

        ids, data = vectors_of(row)
        for block in queries_of:
            names, asked = vectors_of(block)
            q, found, score, _ = search_range(ids, data, names, asked, k, start=np.frombuffer(block["starts"], "<i8") if "starts" in block else None)
            yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    found = met(ranges, blocks, "query_id long, vec_id long, score long", search)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every 20th."""
    vectors = table(spark, sf_dir, "embeddings")
    return block_topk(vectors, vectors.where(F.col("vec_id") % 20 == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
