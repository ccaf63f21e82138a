"""Whole-number vectors in staged blobs, as operators 7 and 12 hold them: ranges of candidates and blocks of queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeloom.llm.common import shuffle_partitions, stage, staged_batches

EXACT = 1 << 53
LARGEST = (1 << 63) - 1
LEAST = -(1 << 63)


def exact_dtype(a, b):
    """float64 while every sum of products stays a whole number in it, int64 while it fits, else Python's integers."""
    import numpy as np

    most = max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) * max(abs(int(b.max(initial=0))), abs(int(b.min(initial=0)))) * max(1, a.shape[1])
    return np.float64 if most < EXACT else np.int64 if most <= LARGEST else object


def fitting(score):
    """Scores as int64; an error where one does not fit."""
    import numpy as np

    if score.dtype == object and score.size and max(abs(int(score.max())), abs(int(score.min()))) > LARGEST:
        raise OverflowError("a score does not fit 64 bits")
    return score.astype(np.int64)


def quantise(vectors: DataFrame, scale: int, *keep: str) -> DataFrame:
    """vec_id, floor(scale * component) as an array of longs, and the columns to keep; vectors that are null, or hold a null or non-finite component, and null vec_ids are left out. A component that doesn't fit is an error."""
    x = F.col("embedding").cast("array<double>")
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    components = F.transform(x, lambda c: F.when(F.abs(c * scale) < 2.0**63, F.floor(c * scale).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit 64 bits")).cast("long")))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), components.alias("v"), *keep)


def packed(rows: DataFrame, size: int, keys: tuple[str, ...] = (), values: tuple[str, ...] = ()) -> DataFrame:
    """Rows of vec_id and v as blobs of at most `size` vectors of one width and equal keys: no, dim, the keys, ids, data, and a blob for each of the values.

    Keys and values are longs; the number is one of its own for each blob. A task holds a blob for each width and key that it meets.
    """
    blobs = ("ids", "data", *values)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: dict[tuple, list] = {}
        kinds = pa.schema([("no", pa.int64()), ("dim", pa.int64()), *((k, pa.int64()) for k in keys), *((b, pa.binary()) for b in blobs)])

        def out(key, *columns):
            nonlocal n
            n += 1
            return pa.RecordBatch.from_pylist([dict(zip(("no", "dim", *keys, *blobs), ((part << 32) + n, *key, *(x.astype("<i8").tobytes() for x in columns)), strict=True))], kinds)

        for batch in batches:
            vectors = batch.column("v")
            starts = np.asarray(vectors.offsets)
            flat = np.asarray(vectors.values)
            names = np.column_stack([np.diff(starts), *(np.asarray(batch.column(k)) for k in keys)])
            own = [np.asarray(batch.column(c)) for c in ("vec_id", *values)]
            for key in np.unique(names, axis=0):
                rows = np.flatnonzero((names == key).all(1))
                add = [own[0][rows], flat[starts[rows][:, None] + np.arange(key[0])], *(x[rows] for x in own[1:])]
                key = tuple(key.tolist())
                found = [np.concatenate(x) for x in zip(held[key], add, strict=True)] if key in held else add
                while len(found[0]) >= size:
                    yield out(key, *(x[:size] for x in found))
                    found = [x[size:] for x in found]
                held[key] = found
        for key, found in held.items():
            if len(found[0]):
                yield out(key, *found)

    return rows.select("vec_id", "v", *keys, *values).mapInArrow(run, ", ".join(["no long", "dim long", *(f"{k} long" for k in keys), *(f"{b} binary" for b in blobs)]))


def vectors_of(row: dict):
    """ids and vectors of a blob."""
    import numpy as np

    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["data"], "<i8").reshape(len(ids), row["dim"])


def ranges_of(vectors: DataFrame, n: int, rows: int, values: tuple[str, ...] = ()) -> DataFrame:
    """Candidates, of which there are about n, as a staged table of ranges. They are dealt out in turn, to no more partitions than a few for each shuffle partition, so that equal and repeated rows lie apart and every range is a mixture."""
    parts = max(1, min(math.ceil(n / rows), 4 * shuffle_partitions(vectors.sparkSession)))
    return stage(packed(vectors.repartition(parts), rows, values=values), "ranges")


def met(ranges: DataFrame, blocks: DataFrame, result: str, search) -> DataFrame:
    """Every range meets every block of queries of its width. search(range, blocks) yields Arrow batches for one range; both sides are rows as dicts.

    Ranges are dealt to tasks; a task holds one of them and reads the staged blocks, one at a time, from the shared folder, so no list of ranges or blocks and no copy of either goes
    through driver or shuffle. Where there are fewer ranges than shuffle partitions, each is taken up by several tasks with a part of the blocks.
    """
    spark = ranges.sparkSession
    slices = max(1, math.ceil(shuffle_partitions(spark) / max(1, ranges.count())))
    path, columns = blocks._staged_at, blocks.columns

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                yield from search(row, (b for part in staged_batches(path, columns, 1) for b in part.to_pylist() if b["dim"] == row["dim"] and ((b["no"] >> 32) + b["no"]) % slices == row["slice"]))

    dealt = ranges.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return dealt.repartition(shuffle_partitions(spark), "no", "slice").mapInArrow(run, result)
