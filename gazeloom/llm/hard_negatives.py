"""Operator 12: hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction, and blocks are cut of the anchors of a cluster. A block has a centre and an angle: that of
the member farthest from the centre. For a candidate at an angle t from the centre, no member is nearer to it than t less the
block's angle, so its score with a member u is at most |u| times |candidate| * cos(max(0, t - angle)). In each range of candidates
these are sorted by that bound once for the block; every member walks this list from the top and ends, with certainty, where the bound falls below what it
still needs. Members walk together: a stretch of the list is scored for all that still need it by one matrix product.

Two walks are made. The first finds each anchor's best rows of its own label, its positives. In the second, each anchor and positive asks for the best rows
of other labels whose score lies between two shares of the positive's: the lower share bounds the walk from its beginning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeloom.llm.common import shuffle_partitions, stage, staged_batches, table, tidy
from gazeloom.llm.vector_tables import LARGEST, LEAST, exact_dtype, fitting, met, packed, quantise, ranges_of, vectors_of

RANGE_ROWS = 8192
#: Anchors of one cluster that walk together; a larger cluster has several blocks.
BLOCK_ROWS = 256
#: Anchors, by smallest hash about so many, from which centres are fitted; the result doesn't depend on them.
SAMPLE_ROWS = 4096
CLUSTERS = 64
#: Candidates that are scored at once.
STRETCH = 512
SCALE = 256


def directions(vectors):
    """Vectors of length 1; null vectors stay null. Also the lengths."""
    import numpy as np

    x = vectors.astype(np.float64)
    top = np.abs(x).max(1, initial=0)
    x = x / np.where(top == 0, 1, top)[:, None]
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size == 0, 1, size)[:, None], size * top


def fit_centres(vectors, clusters: int, rounds: int = 8):
    """Spherical k-means: centres of length 1. Begins with vectors evenly spaced in the sample."""
    import numpy as np

    unit, _ = directions(vectors)
    centres = unit[np.linspace(0, len(unit) - 1, min(clusters, len(unit))).astype(int)]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size == 0, 1, size), centres)
    return centres


def shared_list(data, anchors):
    """The order in which a block's members walk candidates: their numbers, and for each a bound that, times a member's length, no score of the two exceeds. Also the lengths of the members, and the greatest of the candidates."""
    import numpy as np

    units, lengths = directions(anchors)
    centre = units.sum(0)
    size = np.linalg.norm(centre)
    centre = centre / size if size > 0 else centre
    angle = np.arccos(np.clip(units @ centre, -1, 1)).max()
    theirs, sizes = directions(data)
    apart = np.arccos(np.clip(theirs @ centre, -1, 1))
    # Angles are uncertain by the root of a float's precision; so much is granted.
    bound = sizes * np.cos(np.maximum(0, apart - angle - 1e-7))
    order = np.argsort(-bound, kind="stable")
    return order, bound[order], lengths, sizes.max(initial=0)


def keep_best(rows, names, scores, k: int):
    """Of entries (row, id, score), the k of highest score of each row, ties to the smaller id; in order of rows and ranks. Also the rank from 0 of each."""
    import numpy as np

    order = np.lexsort((names, -scores, rows))  # scores never are the least integer
    rows, names, scores = rows[order], names[order], scores[order]
    firsts = np.flatnonzero(np.diff(rows, prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(firsts, np.diff(np.append(firsts, len(rows))))
    kept = rank < k
    return rows[kept], names[kept], scores[kept], rank[kept]


def walk(ids, labels, data, anchor_ids, anchor_labels, anchors, same: bool, low, high, k: int, stretch: int = STRETCH):
    """For each member of a block and each of its asks, the k best candidates of the same label (or of others) with a score from low to high.

    low and high have a row for each member and a column for each ask. Returns numbers of members and asks, ids, scores, and how many
    scores were computed of all that there are.
    """
    import numpy as np

    kind = exact_dtype(data, anchors)
    order, bound, lengths, longest = shared_list(data, anchors)
    ids, labels, data, asked = ids[order], labels[order], data[order].astype(kind), anchors.astype(kind)
    slots = low.shape[1]
    need = low.copy()  # the least score that still matters to an ask: the lower end of its scores, later its k-th best if that is more
    closed = low > high
    granted = 1e-6 * (1 + longest * lengths)
    rows, names, scores = (np.empty(0, np.int64) for _ in range(3))
    scored = 0
    for at in range(0, len(ids), stretch):
        open_ = ((bound[at] * lengths + granted)[:, None] >= need) & ~closed
        members = np.flatnonzero(open_.any(1))
        if not len(members):
            break
        part = slice(at, at + stretch)
        score = fitting(asked[members] @ data[part].T)
        scored += score.size
        fits = ((labels[part][None, :] == anchor_labels[members][:, None]) == same) & (ids[part][None, :] != anchor_ids[members][:, None])
        found = [(rows, names, scores)]
        for slot in range(slots):
            m, c = np.nonzero(fits & open_[members, slot][:, None] & (score >= need[members, slot][:, None]) & (score <= high[members, slot][:, None]))
            found.append((members[m] * slots + slot, ids[part][c], score[m, c]))
        rows, names, scores, rank = keep_best(*map(np.concatenate, zip(*found, strict=True)), k)
        last = rank == k - 1
        need.reshape(-1)[rows[last]] = scores[last]
    return rows // slots, rows % slots, names, scores, (scored, len(anchors) * len(ids))


def centres_of(anchors: DataFrame, n: int, clusters: int, sample: int) -> str:
    """Path of a staged table of centres, a blob for each width, fitted in one task from about `sample` anchors."""
    few = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n))) < sample).limit(2 * sample).coalesce(1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                centres = fit_centres(vectors_of(row)[1], clusters)
                yield pa.RecordBatch.from_pylist([{"dim": row["dim"], "centres": centres.astype("<f8").tobytes()}], pa.schema([("dim", pa.int64()), ("centres", pa.binary())]))

    return stage(packed(few, 2 * sample).mapInArrow(run, "dim long, centres binary"), "centres")._staged_at


def clustered(anchors: DataFrame, path: str) -> DataFrame:
    """Anchors with the number of the nearest centre of their width; 0 where no centre has it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        centres = {row["dim"]: np.frombuffer(row["centres"], "<f8").reshape(-1, row["dim"]) for part in staged_batches(path, ["dim", "centres"], 64) for row in part.to_pylist() if row["dim"]}
        for batch in batches:
            vectors = batch.column("v")
            starts, flat = np.asarray(vectors.offsets), np.asarray(vectors.values)
            own, widths = np.zeros(batch.num_rows, np.int64), np.diff(starts)
            for dim in np.unique(widths).tolist():
                if dim in centres:
                    rows = np.flatnonzero(widths == dim)
                    own[rows] = (directions(flat[starts[rows][:, None] + np.arange(dim)])[0] @ centres[dim].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "cluster"])

    return anchors.mapInArrow(run, "vec_id long, v array<long>, label long, cluster long")


@tidy
def mine_hard_negatives(candidates: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS, clusters: int = CLUSTERS) -> DataFrame:
    """For each anchor and each of its positives, rows of other labels that score nearly as high as the positive.

    Both frames have vec_id, embedding and label (a whole number); further columns are not read. Components x become floor(scale * x), a score is the
    inner product. An anchor's positives are its n_positives best other rows of the same label; for each, the n_negatives best rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score, fewer where there are no more. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score; ties go to the smaller vec_id. Rows with a null vec_id, label or vector, or a null or non-finite component, take no part; vectors of different width never meet, and
    a row never meets an anchor of its own vec_id. Repeated candidate rows count each; of rows that repeat an anchor's vec_id the first by label and components is the anchor.
    Anchors without positives, and positives without such negatives, have no rows. A score or component beyond 63 bits is an error.
    """
    if not 0 <= low <= high:
        raise ValueError("low and high are shares in percent, with 0 <= low <= high")
    spark = candidates.sparkSession
    with_label = [x.where(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("long")) for x in (candidates, anchors)]
    ranges = ranges_of(quantise(with_label[0], scale, "label"), candidates.count(), range_rows, ("label",))
    first = quantise(with_label[1], scale, "label").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    own = stage(first.select("vec_id", "a.v", "a.label"), "anchors")
    n = own.count()
    near = stage(clustered(own, centres_of(own, n, clusters, SAMPLE_ROWS)), "clustered")
    # Cut by cluster and id, a cluster of many anchors lies in several partitions, and its blocks hold neighbours.
    parts = max(1, min(shuffle_partitions(spark), n // block_rows))
    blocks = stage(packed(near.repartitionByRange(parts, "cluster", "vec_id"), block_rows, ("cluster",), ("label",)), "blocks")

    def positives(row, blocks_of):
        import numpy as np
        import pyarrow as pa

        (ids, data), labels = vectors_of(row), np.frombuffer(row["label"], "<i8")
        for block in blocks_of:
            (names, asked), own = vectors_of(block), np.frombuffer(block["label"], "<i8")
            none = np.full((len(names), 1), LEAST + 1)
            m, _, found, score, _ = walk(ids, labels, data, names, own, asked, True, none, -none, n_positives)
            yield pa.RecordBatch.from_arrays([pa.array(names[m]), pa.array(found), pa.array(score)], ["anchor_id", "positive_id", "positive_score"])

    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = met(ranges, blocks, "anchor_id long, positive_id long, positive_score long", positives)
    pairs = stage(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_positives), "positives")
    # An anchor's positives are few, so each anchor takes them along: numbers and scores, in order, the unused places with a score that asks for nothing.
    along = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("positive_id", "positive_score")))).alias("p"))
    at = [F.col("p").getItem(k + 1) for k in range(n_positives)]
    asks = near.join(along, "vec_id").select(
        "vec_id", "v", "cluster", "label",
        *[F.coalesce(x["positive_id"], F.lit(0)).alias(f"id{k}") for k, x in enumerate(at)],
        *[F.coalesce(x["positive_score"], F.lit(LEAST)).alias(f"score{k}") for k, x in enumerate(at)],
    )
    values = ("label", *[f"id{k}" for k in range(n_positives)], *[f"score{k}" for k in range(n_positives)])
    asking = stage(packed(asks.repartitionByRange(parts, "cluster", "vec_id"), block_rows, ("cluster",), values), "asks")

    def negatives(row, blocks_of):
        import numpy as np
        import pyarrow as pa

        (ids, data), labels = vectors_of(row), np.frombuffer(row["label"], "<i8")
        for block in blocks_of:
            (names, asked), own = vectors_of(block), np.frombuffer(block["label"], "<i8")
            positive, score = (np.stack([np.frombuffer(block[f"{x}{k}"], "<i8") for k in range(n_positives)], 1) for x in ("id", "score"))
            # Shares of whole numbers, rounded inwards; in Python's integers, which don't overflow. A positive below 0 has no scores between two shares.
            whole = score.astype(object)
            lower, upper = (np.clip(x, LEAST + 1, LARGEST).astype(np.int64) for x in (-(-low * whole // 100), high * whole // 100))
            lower[score == LEAST], upper[score == LEAST] = 1, 0
            m, slot, found, got, _ = walk(ids, labels, data, names, own, asked, False, lower, upper, n_negatives)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[m], slot, positive[m, slot], found, score[m, slot], got)], ["anchor_id", "slot", "positive_id", "negative_id", "positive_score", "negative_score"])

    best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id")
    found = met(ranges, asking, "anchor_id long, slot long, positive_id long, negative_id long, positive_score long, negative_score long", negatives)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th of embeddings, among all of them, after the labels of every 7th were moved on by one."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(moved, moved.where(F.col("vec_id") % 100 == 0))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
