"""Operator 2: near-duplicate documents by MinHash with tensored banding.

A document is the set of its five-word shingles. Two collections of COLLECTION keys, each of HALF
minhashes, are computed for it; the table keys are all pairs of a key of the first collection with a key of
the second, so COLLECTION * COLLECTION tables of 2 * HALF minhashes cost 2 * COLLECTION * HALF minhashes. With 16 keys of 3, a
pair of similarity 0.75 meets in a table with probability 0.9997, one of 0.85 with 1 - 4e-7.

1. Texts of equal sets form a class, and only its smallest doc_id goes on, as the class's rep. A doc_id of several texts can be the
   rep of several classes; it is one node, which has all of their sets.
2. Keys that no other class has are dropped before pairs are formed; this loses no pair.
3. Each rep is compared with the smallest rep that it shares a table key with, on the full sets, and linked reps are
   joined into components, as are the reps of the classes that one doc_id is in.
4. Where reps of several components still share a table key, they are compared across components within the buckets of the first
   collection: by 32-bit hashes of all their shingles, then, those that join components, on the full sets.
   A set of n shingles can be linked only with sets of 0.75 n to n / 0.75, so a bucket is cut into bands of sizes, of which only neighbours meet, and
   large bands are compared in pairs of parts of about SPLIT members; the largest component of a band is spared comparison with itself. Only links leave
   such a task, not pairs.

So every pair that shares a table key ends up in one component, or is known not to be linked. Keys and pivots are counted from partial sums and
staged; where they are few they go to the members by broadcast, else by a join that Spark may split, so a key with a large share of the members
does not gather them in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.common import labelled_text, release, shuffle_partitions, small, stage, table, tidy
from gazeloom.llm.hashing import WordHashes

SHINGLE = 5
HALF = 3
COLLECTION = 16
HASHES = 2 * COLLECTION * HALF
SPLIT = 256
PERCENT = 75


def constants(n: int, seed: int):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case; words are parted by ASCII white space."""
    return (text or "").encode().lower().split()


def shingle_sets(texts: list[str | None], hashes: WordHashes) -> list:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    import numpy as np

    factors = constants(SHINGLE, 5)
    out = []
    for text in texts:
        w = hashes.array(words(text))
        n = len(w)
        if n >= SHINGLE:
            s = w[: n - SHINGLE + 1] * factors[0]
            for k in range(1, SHINGLE):
                s += w[k : n - SHINGLE + 1 + k] * factors[k]
        elif n:
            s = (w * factors[:n]).sum(keepdims=True) + np.uint64(n)
        else:
            s = w
        out.append(np.unique(mix(s)))
    return out


def minhashes(sets: list):
    """HASHES minhashes of each non-empty set, as rows."""
    import numpy as np

    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    factors, offsets = constants(HASHES, 7), constants(HASHES, 11)
    out = np.empty((len(sets), HASHES), np.uint64)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(flat * factors[k] + offsets[k], starts)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, keys (2 * COLLECTION longs, null without shingles)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        release()
        hashes = WordHashes()
        factors = constants(HALF, 13)
        salts = constants(2 * COLLECTION, 17)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = shingle_sets(part.column("text").to_pylist(), hashes)
                filled = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if filled:
                    mins = minhashes([sets[k] for k in filled])
                    bands = mix((mins.reshape(len(filled), 2 * COLLECTION, HALF) * factors).sum(2, dtype=np.uint64) ^ salts).view(np.int64)
                    for row, k in enumerate(filled):
                        keys[k] = bands[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "digest", "keys"],
                )

    return labelled_text(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of doc_ids, those of which any texts have full sets that are similar enough."""
    wanted = small(stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids"))

    def to_sets(batches):
        import pyarrow as pa

        release()
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text").to_pylist(), hashes)], pa.binary())], ["doc_id", "shingles"])

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        release()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = stage(labelled_text(docs).join(wanted, "doc_id", "left_semi").mapInArrow(to_sets, "doc_id long, shingles binary").where("octet_length(shingles) > 0"), "sets")
    left, right = (sets.select(F.col("doc_id").alias(i), F.col("shingles").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    # Pairs first meet the sets of b, of which each has few; the frequent a's come last, where Spark can split them.
    return stage(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """doc_id and label, the smallest doc_id that the links (a, b) reach from it, for every doc_id that has a link and isn't the smallest itself."""
    edges = links
    labels = None
    while True:
        edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
        # Each node points to its smallest neighbour below it; the pointers are followed to their end.
        parent = stage(edges.groupBy("a").agg(F.min("b").alias("p")), "parents")
        while True:
            above = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = stage(parent.join(above, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents")
            parent = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        new = parent.select(F.col("a").alias("doc_id"), F.col("p").alias("label"))
        if labels is not None:
            moved = labels.join(parent, labels["label"] == parent["a"], "left").select("doc_id", F.coalesce("p", "label").alias("label"))
            new = moved.union(new.join(labels, "doc_id", "left_anti"))
        labels = stage(new, "labels")
        top = lambda c: F.coalesce("p", c)
        first = edges.join(parent, "a", "left").select(top("a").alias("a"), "b")
        edges = first.join(parent.withColumnRenamed("a", "b"), "b", "left").select("a", top("b").alias("b"))
    return labels if labels is not None else links.select(F.col("a").alias("doc_id"), F.col("b").alias("label")).limit(0)


def short_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, size and the first 32 bits of its shingles' hashes, for each distinct set of the given reps."""
    wanted = small(stage(ids.select(F.col("rep").alias("doc_id")).distinct(), "crossing-ids"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        release()
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                full = shingle_sets(part.column("text").to_pylist(), hashes)
                sets = [(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in full]
                marks = np.array([xxh3_64_intdigest(s.tobytes()) for s in full], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks, pa.int64()), pa.array([len(s) for s in full], pa.int64()), pa.array(sets, pa.binary())], ["rep", "mark", "size", "short"])

    rows = labelled_text(docs).join(wanted, "doc_id", "left_semi").mapInArrow(run, "rep long, mark long, size long, short binary")
    return stage(rows.where("size > 0").dropDuplicates(["rep", "mark"]), "short-sets")


def similar_pairs(sets: list):
    """Matrix of the pairs whose sets, given as sorted arrays, may be similar enough: counts of common elements come from products of membership matrices.

    An array repeats what differs in the full hashes only. Common elements may be among its repeats, so a pair's count is raised by as many as both can hold: too much passes, never too little.
    """
    import numpy as np

    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    repeats = np.array([np.count_nonzero(x[1:] == x[:-1]) for x in sets], np.int64)
    both = np.zeros((n, n), np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1  # elements of one set alone count for nothing
    number = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(shared.sum())
    for at in range(0, total, 4096):
        here = slice(*np.searchsorted(column, [at, at + 4096]))
        x = np.zeros((n, min(4096, total - at)), np.float32)
        x[owner[here], column[here] - at] = 1
        both += x @ x.T
    both = both.astype(np.int64) + np.minimum(repeats[:, None], repeats[None, :])
    return 100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both)


def crossing(tables: DataFrame, halves: DataFrame, labels: DataFrame, docs: DataFrame, every: bool = False) -> DataFrame:
    """Pairs (a, b) that are similar enough by short hashes and join different components.

    tables: key, rep of the table keys; halves: key, rep of the first collection's keys. Reps whose table keys lie in several
    components are compared within the buckets of the first collection, which hold every pair that shares a table key. Of a block's pairs, those that join its
    components are returned, or with `every` all between components.
    """
    spark = tables.sparkSession
    label = F.coalesce("label", "rep")
    by_rep = labels.withColumnRenamed("doc_id", "rep")
    placed = stage(tables.join(by_rep, "rep", "left").withColumn("label", label), "placed")
    mixed = stage(placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"), "mixed")
    ids = stage(placed.join(small(mixed), "key", "left_semi").select("rep", "label").distinct(), "crossing-reps")
    if ids.isEmpty():
        return ids.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    sets = short_sets(docs, ids)
    # A set is at home in the band of its size, and a guest in the band below: linked sets lie at most one band apart.
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / PERCENT) + 1e-9).cast("int")
    members = halves.join(small(ids), "rep").join(small(stage(sets.select("rep", "mark", band.alias("home")), "bands")), "rep")
    members = members.withColumn("band", F.explode(F.array("home", F.col("home") - 1))).withColumn("at_home", F.col("home") == F.col("band"))
    members = stage(members, "crossing-members")
    # The largest component of a bucket is not compared with itself: its parts meet those of the other members, numbered first, and these meet each other.
    sizes = members.groupBy("key", "band", "label").agg(F.count(F.lit(1)).alias("n"), F.max("at_home").alias("any_home"))
    split = sizes.groupBy("key", "band").agg(F.max(F.struct("n", "label")).alias("large"), F.sum("n").alias("n"), F.max("any_home").alias("any_home")).where("any_home and large.n < n")
    parts = lambda n: F.ceil(n / SPLIT).cast("int")
    split = split.select("key", "band", F.col("large.label").alias("large"), parts(F.col("n") - F.col("large.n")).alias("rest"), parts(F.col("large.n")).alias("parts"))
    is_large = F.col("label") == F.col("large")
    number = lambda n: F.pmod(F.xxhash64("rep", "mark"), n).cast("int")
    members = members.join(small(stage(split, "crossing-split")), ["key", "band"]).withColumn("own", F.when(is_large, F.col("rest") + number(F.col("parts"))).otherwise(number(F.col("rest"))))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_large, F.col("rest")).otherwise(F.col("rest") + F.col("parts")) - 1)))
    members = members.select("key", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "rep", "label", "at_home", "mark").join(sets.select("rep", "mark", "short"), ["rep", "mark"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        release()

        def compare(rows, one_part):
            names = [r[0] for r in rows]
            marks, owns, home = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
            apart = (marks[:, None] != marks[None, :]) & (home[:, None] | home[None, :])  # guests meet in their own band
            if not one_part:  # members of one part meet in its own block
                apart &= owns[:, None] != owns[None, :]
            out: set[tuple[int, int]] = set()
            if not apart.any():
                return out
            top: dict[int, int] = {}

            def root(x):
                while top.get(x, x) != x:
                    x = top[x]
                return x

            for i, j in zip(*np.nonzero(np.triu(similar_pairs([r[4] for r in rows]) & apart)), strict=True):
                x, y = root(int(marks[i])), root(int(marks[j]))
                if every or x != y:
                    top[max(x, y)] = min(x, y)
                    out.add((max(names[i], names[j]), min(names[i], names[j])))
            return out

        def links(rows, at):
            pairs = sorted(compare(rows, at[2] == at[3])) if len(rows) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])

        at, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "band", "p", "q", "rep", "label", "own", "at_home")]
            for key, level, p, q, rep, mark, own, home, short in zip(*columns, batch.column("short"), strict=True):
                if (key, level, p, q) != at:
                    yield from links(rows, at)
                    at, rows = (key, level, p, q), []
                rows.append((rep, mark, own, home, np.frombuffer(short.as_buffer(), np.uint32)))
        yield from links(rows, at)

    block = ["key", "band", "p", "q"]
    return members.repartition(shuffle_partitions(spark), *block).sortWithinPartitions(*block).mapInArrow(run, "a long, b long").distinct()


@tidy
def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of near-duplicate documents.

    Returns doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included) and kept (doc_id = component_id) for every row.
    Two documents are linked if 100 * intersection >= 75 * union of their shingle sets. A null, empty or blank text has no shingles and no link and is kept. doc_id is the
    key: rows that repeat a doc_id are one document, which has the links of all its texts, and each row gets its result (n_shingles is the row's own), whatever
    the order of rows; rows with a null doc_id have a null component_id and are not kept.
    Whole texts are read; other columns are not. An empty table gives no rows.
    """
    signed = stage(signatures(docs), "signatures")
    known = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stage(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    rows = stage(signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").drop("digest"), "rows")
    reps = known.select("doc_id", "keys", "digest").join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").withColumn("mark", F.xxhash64("digest"))
    reps = stage(reps.dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("rep"), "mark", "keys"), "reps")

    # The classes that one doc_id is in.
    several = stage(rows.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high"), "several")
    same = several.select(F.col("high").alias("a"), F.col("low").alias("b"))
    if not several.isEmpty():
        same = stage(rows.join(small(several), "doc_id").where("low < rep").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct(), "same-document")

    # Keys that more than one class has, then pairs of such keys of both collections.
    single = reps.select("rep", "mark", F.posexplode("keys").alias("slot", "key")).withColumn("slot", (F.col("slot") >= COLLECTION).cast("byte"))
    shared = small(stage(single.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared-keys"))
    halves = single.join(shared, "key").groupBy("rep", "mark").agg(*[F.collect_list(F.when(F.col("slot") == k, F.col("key"))).alias(f"keys{k}") for k in (0, 1)])
    tables = halves.select("rep", F.explode("keys0").alias("k0"), "keys1").select("rep", "k0", F.explode("keys1").alias("k1")).select(F.xxhash64("k0", "k1").alias("key"), "rep")
    tables = stage(tables, "tables")
    pivots = stage(tables.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("key", "pivot"), "pivots")
    tables = stage(tables.join(small(pivots), "key"), "buckets")

    nearest = tables.where("pivot < rep").groupBy("rep").agg(F.min("pivot").alias("b")).select(F.col("rep").alias("a"), "b")
    links = linked(nearest, docs).union(same)
    labels = components(links)
    halves = single.where("slot = 0").join(shared, "key").select("key", "rep").distinct()
    rest = stage(crossing(tables.select("key", "rep"), halves, labels, docs), "crossing")
    if not rest.isEmpty():
        more = linked(rest, docs)
        if more.count() < rest.count():  # short hashes that met by chance may have stood for a link: take all pairs
            more = linked(stage(crossing(tables.select("key", "rep"), halves, labels, docs, every=True), "crossing"), docs)
        links = links.union(more)
        labels = components(links)
    return (
        rows.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
