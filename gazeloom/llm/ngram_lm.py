"""Interpolated modified Kneser-Ney models over characters, counted and looked up as sharded Spark tables.

Tokens are UTF-16 code units, so four of them fill a 64-bit key and every n-gram is
held exactly; order 4 is the highest. A text is padded with three begin marks and one
end mark. The work takes two passes over the texts and moves no text:

1. Texts are staged once, in chunks: stretches of rows of one file. A task counts the distinct n-grams of each chunk, for
   each model's training texts and for all texts.
2. Counts are summed by n-gram. Lower orders count distinct left extensions. Joins by n-gram, by context and by
   suffix give the log probability of every n-gram that occurs. Models are columns: all of them go through the same joins.
3. These go back to the chunks that hold the n-gram, as a table in the shared folder: as many files as shuffle partitions, each
   sorted by chunk in small row groups, whose statistics are the index by which a task reads its chunk's rows alone. The second pass sums them by document.

A chunk's table is bounded by the chunk's text; nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom.llm.common import new_path, release, shuffle_partitions, stage

ORDER = 4
CHUNK_BYTES = 24 << 20
#: Bytes of a row group of the table that goes back to the chunks.
GROUP_BYTES = 4 << 20
#: Characters that a task turns into n-grams at once; a longer text goes alone.
STEP_CHARS = 1_000_000
#: The code unit of the end mark; begin marks are zeros. Texts have neither: they are replaced by their neighbours.
END = 0xFFFF


def grams(texts: list[str]):
    """Keys of all order-4 n-grams of these texts, and the number of each text's n-grams (its code units and the end mark)."""
    import numpy as np

    joined = "".join(["\0\0\0" + t.replace("\0", "\1").replace("￿", "￾") + "￿" for t in texts])
    units = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    ends = np.flatnonzero(units == END)
    sizes = np.diff(ends, prepend=-1) - 3
    keys = units[:-3] << np.uint64(48)
    keys |= units[1:-2] << np.uint64(32)
    keys |= units[2:-1] << np.uint64(16)
    keys |= units[3:]
    whole = np.ones(len(keys), bool)
    for k in range(3):
        inner = ends[:-1] - k
        whole[inner] = False
    return keys[whole], sizes


def merge_counts(parts: list):
    """Sum (keys, counts by column) parts by key."""
    import numpy as np

    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint64(1)) != 0) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, axis=0) if len(first) else counts[:0]


def chunked(rows: DataFrame, name: str) -> DataFrame:
    """Stage doc_id, text, model and further columns, and give each row the number of its chunk."""
    spark = rows.sparkSession
    staged = stage(rows, name)
    path = staged._staged_at
    size = staged.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    per_chunk = max(64, int(CHUNK_BYTES / max(1.0, (size[1] or 0) / max(1, size[0]))))
    return (
        spark.read.schema(rows.schema)
        .parquet(path)
        .select("*", F.xxhash64(F.col("_metadata.file_path"), F.expr(f"_metadata.row_index div {per_chunk}")).alias("chunk"))
    )


def runs(batch):
    """Slices of a batch, of at most 1000 rows, that belong to one chunk."""
    import numpy as np

    chunk = batch.column("chunk").to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
    for a, b in zip(edges, edges[1:], strict=False):
        for at in range(a, b, 1000):
            yield int(chunk[a]), batch.slice(at, min(1000, b - at))


def count_grams(docs: DataFrame, models: int) -> DataFrame:
    """chunk, gram and n0, n1, ...: how often each chunk's n-grams occur in the texts of each model. Column model of docs is a model's number or null."""
    names = [f"n{k}" for k in range(models)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        release()
        def out():
            keys, counts = merge_counts(held)
            for k in range(0, len(keys), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys[part]), at), pa.int64()), pa.array(keys[part].view(np.int64), pa.int64()), *(pa.array(counts[part, m], pa.int64()) for m in range(models))], ["chunk", "gram", *names]
                )

        held, at = [], None
        for batch in batches:
            for chunk, rows in runs(batch):
                if held and chunk != at:
                    yield from out()
                    held = []
                at = chunk
                texts, owners = rows.column("text").to_pylist(), rows.column("model").to_pylist()
                for model in {*owners}:
                    own = [t for t, o in zip(texts, owners, strict=True) if o == model and t]
                    while own:
                        n = size = 0
                        while n < len(own) and size < STEP_CHARS:
                            size += len(own[n])
                            n += 1
                        keys, counts = np.unique(grams(own[:n])[0], return_counts=True)
                        wide = np.zeros((len(keys), models), np.int64)
                        if model is not None:
                            wide[:, model] = counts
                        held.append((keys, wide))
                        own = own[n:]
                if len(held) > 24:
                    held = [merge_counts(held)]
        if held:
            yield from out()

    return docs.select("chunk", "text", "model").mapInArrow(run, "chunk long, gram long" + "".join(f", {n} long" for n in names))


def suffix(gram: Column, n: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 16 * n) - 1))


def context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


@dataclass
class Order:
    """Counts of one order, for all models at once: grams (gram, a0, a1, ...), contexts (context, s0, gamma0, ...), and each model's discounts of counts 1, 2 and 3 or more."""

    grams: DataFrame
    contexts: DataFrame
    discounts: list[tuple[float, float, float]]


def discounts(grams: DataFrame, models: int) -> list[tuple[float, float, float]]:
    """Each model's discounts from the numbers of n-grams that were counted once to four times; 0.5, 1 and 1.5 where these don't give any."""
    seen = grams.agg(*[F.count(F.when(F.col(f"a{m}") == k, 1)) for m in range(models) for k in (1, 2, 3, 4)]).first()
    return [_discounts(*(x or 0 for x in seen[4 * m : 4 * m + 4])) for m in range(models)]


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    found = []
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    for k, low, high in ((1, n1, n2), (2, n2, n3), (3, n3, n4)):
        d = k - (k + 1) * y * high / low if low and y else 0.5 * k
        found.append(min(max(d, 0.05 * k), 0.95 * k))
    return tuple(found)  # type: ignore[return-value]


def discount(a: Column, d: tuple[float, float, float]) -> Column:
    return F.when(a == 0, 0.0).when(a == 1, d[0]).when(a == 2, d[1]).otherwise(d[2])


def train(counts: DataFrame, models: int = 1) -> list[Order]:
    """Orders 1 to 4 of all models from the counts (gram, a0, a1, ...) of order 4, 0 where a model has not seen the gram."""
    orders, level = [], counts
    each = range(models)
    for n in range(ORDER, 0, -1):
        level = stage(level, f"order-{n}")
        d = discounts(level, models)
        sums = [c for m in each for c in (F.sum(f"a{m}").cast("double").alias(f"s{m}"), F.sum(discount(F.col(f"a{m}"), d[m])).alias(f"held{m}"))]
        contexts = level.groupBy(context(F.col("gram")).alias("context")).agg(*sums)
        contexts = contexts.select("context", *[c for m in each for c in (f"s{m}", F.when(F.col(f"s{m}") > 0, F.col(f"held{m}") / F.col(f"s{m}")).alias(f"gamma{m}"))])
        orders.append(Order(level, contexts, d))
        level = level.select(suffix(F.col("gram"), n - 1).alias("gram"), *[f"a{m}" for m in each]).groupBy("gram").agg(*[F.count_if(F.col(f"a{m}") > 0).alias(f"a{m}") for m in each])
    return orders[::-1]


def log_probabilities(wanted: DataFrame, orders: list[Order], vocabulary: int) -> DataFrame:
    """gram and logp0, logp1, ..., the natural logarithm of the last unit's probability after the first three under each model, for distinct grams."""
    below = None
    each = range(len(orders[0].discounts))
    for n, order in enumerate(orders, 1):
        level = wanted.select(suffix(F.col("gram"), n).alias("gram")).distinct() if n < ORDER else wanted
        level = level.withColumn("context", context(F.col("gram"))).join(order.grams, "gram", "left").join(order.contexts, "context", "left")
        if below is not None:
            level = level.withColumn("shorter", suffix(F.col("gram"), n - 1)).join(below.withColumnRenamed("gram", "shorter"), "shorter")

        def p(m: int, order=order, first=below is None) -> Column:
            a = F.col(f"a{m}")
            seen = F.when(a > 0, (a - discount(a, order.discounts[m])) / F.col(f"s{m}")).otherwise(0.0)
            return seen + F.coalesce(f"gamma{m}", F.lit(1.0)) * (F.lit(1 / vocabulary) if first else F.col(f"q{m}"))

        below = level.select("gram", *[p(m).alias(f"q{m}") for m in each])
    return below.select("gram", *[F.log(f"q{m}").alias(f"logp{m}") for m in each])


def slice_of(store, path: str, chunk: int, columns: list[str]):
    """Tables of a chunk's rows in a file that is sorted by chunk; only row groups that may hold the chunk are read."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    with store.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        place = file.schema_arrow.get_field_index("chunk")
        for k in range(file.num_row_groups):
            found = file.metadata.row_group(k).column(place).statistics
            if found is None or not found.has_min_max or found.min <= chunk <= found.max:
                rows = file.read_row_group(k, ["chunk", *columns], use_threads=False)
                yield rows.filter(pc.equal(rows.column("chunk"), chunk)).select(columns)


def cross_entropies(docs: DataFrame, models: int, keep: list[str], name: str) -> DataFrame:
    """n_tokens (code units and the end mark; 0 without text) and loss0, loss1, ... of each document, with doc_id and the columns to keep.

    docs: doc_id, text, model (the model that the text trains, or null), and the columns to keep. A loss is the sum of a text's
    negative natural log probabilities under a model; the models share one vocabulary, the units of all training texts and one for the rest.
    """
    placed = chunked(docs.select("doc_id", "text", F.col("model").cast("int").alias("model"), *keep), name)
    spark = docs.sparkSession
    counted = stage(count_grams(placed, models), f"{name}-grams")
    columns = [f"n{k}" for k in range(models)]
    sums = stage(counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in columns]), f"{name}-sums")
    seen = " OR ".join(f"{c} > 0" for c in columns)
    orders = train(sums.where(seen).select("gram", *[F.col(c).alias(f"a{m}") for m, c in enumerate(columns)]), models)
    vocabulary = orders[0].grams.count() + 1
    known = log_probabilities(sums.select("gram"), orders, vocabulary)
    folder = new_path(spark, f"{name}-slices")
    logs = [f"logp{k}" for k in range(models)]
    shards = shuffle_partitions(spark)
    # A chunk's grams may come from two tasks; a gram then stands twice in its slice, with one value.
    (
        counted.select("chunk", "gram")
        .join(known, "gram")
        .select("chunk", "gram", *[F.col(c).cast("float").alias(c) for c in logs], F.pmod("chunk", F.lit(shards)).cast("int").alias("shard"))
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "chunk", "gram")
        .write.partitionBy("shard")
        .option("parquet.block.size", GROUP_BYTES)
        .parquet(folder)
    )

    def score(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        release()
        store, root = fs.FileSystem.from_uri(folder)
        at, keys, values = None, None, None
        for batch in batches:
            for chunk, rows in runs(batch):
                if chunk != at:
                    at, keys, values = chunk, np.zeros(0, np.int64), np.zeros((0, models))
                    info = store.get_file_info(fs.FileSelector(f"{root}/shard={chunk % shards}", allow_not_found=True))
                    parts = [p for x in info if x.path.endswith(".parquet") for p in slice_of(store, x.path, chunk, ["gram", *logs])]
                    if parts:
                        keys = np.concatenate([p.column("gram").to_numpy() for p in parts])
                        values = np.concatenate([np.stack([p.column(c).to_numpy() for c in logs], 1) for p in parts]).astype(np.float64)
                        order = np.argsort(keys, kind="stable")
                        keys, values = keys[order], values[order]
                texts = rows.column("text").to_pylist()
                sizes, losses = np.zeros(len(texts), np.int64), np.zeros((len(texts), models))
                filled = [k for k, t in enumerate(texts) if t]
                while filled:
                    n = size = 0
                    while n < len(filled) and size < STEP_CHARS:
                        size += len(texts[filled[n]])
                        n += 1
                    now, filled = filled[:n], filled[n:]
                    found, counts = grams([texts[k] for k in now])
                    place = np.searchsorted(keys, found.view(np.int64))
                    starts = np.cumsum(counts) - counts
                    sizes[now] = counts
                    for m in range(models):
                        losses[now, m] = -np.add.reduceat(values[place, m], starts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *(rows.column(c) for c in keep), pa.array(sizes, pa.int64()), *(pa.array(losses[:, m], pa.float64()) for m in range(models))],
                    ["doc_id", *keep, "n_tokens", *(f"loss{m}" for m in range(models))],
                )

    kinds = dict(docs.dtypes)
    return placed.select("chunk", "doc_id", "text", *keep).mapInArrow(score, ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in keep), "n_tokens long", *(f"loss{m} double" for m in range(models))]))
