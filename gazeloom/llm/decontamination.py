"""Operator 5: benchmark decontamination by a distributed positional inverted index.

The index is a table of blocks in the shared folder. A block covers a stretch of documents whose words are
numbered one after the other, with a gap between documents, and holds for each of its terms (a 64-bit hash of the word) the ascending
places of the term. To find a phrase, the places of its terms, each less the term's offset in the phrase,
are intersected, beginning with the rarest term; what is left are the places where the phrase begins.
A block answers for its own documents, so building and searching move no postings.

Phrases are the benchmark's windows, staged as a table. A task that searches a block reads them from the shared folder in batches of bounded size, so neither
the driver nor a task holds all of them, and the index is read once however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.common import labelled_text, release, stage, staged_batches, table, tidy
from gazeloom.llm.hashing import WordHashes

WINDOW = 13
#: Words in a block of the index; a longer document is a block of its own.
BLOCK_WORDS = 1_000_000
#: Windows that a task holds at once (13 hashes of 8 bytes each).
BATCH_WINDOWS = 100_000
#: Every byte that no word has becomes a space; A-Z become a-z. Bytes of other characters stay.
FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
INDEX = "docs array<long>, lengths array<int>, terms binary, counts binary, places binary"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Block:
    """One block of the index, unpacked."""

    def __init__(self, row: dict) -> None:
        import numpy as np
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        self.docs = row["docs"]
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.size = int((self.lengths + 1).sum())
        self.terms = np.frombuffer(unpack(row["terms"]), "<u8")
        counts = np.frombuffer(unpack(row["counts"]), "<u4").astype(np.int64)
        self.ends = np.cumsum(counts)
        steps = np.frombuffer(unpack(row["places"]), "<i4")
        self.places = np.cumsum(steps, dtype=np.int64)  # the steps run on from term to term

    def find(self, terms) -> tuple:
        """Begin and end of each term's places; equal where the block has none."""
        import numpy as np

        k = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        there = self.terms[k] == terms if len(self.terms) else np.zeros(len(terms), bool)
        end = np.where(there, self.ends[k] if len(self.ends) else 0, 0)
        return np.where(there & (k > 0), self.ends[k - 1] if len(self.ends) else 0, 0), end

    def phrase(self, begins, ends):
        """Places where a phrase begins, from its terms' places; rarest term first."""
        import numpy as np

        order = np.argsort(ends - begins, kind="stable")
        found = self.places[begins[order[0]] : ends[order[0]]] - order[0]
        for k in order[1:]:
            own = self.places[begins[k] : ends[k]]
            at = np.minimum(np.searchsorted(own, found + k), len(own) - 1)
            found = found[own[at] == found + k]
            if not len(found):
                break
        return found

    def doc_of(self, places):
        import numpy as np

        return np.searchsorted(self.starts, places, "right") - 1


def build_index(docs: DataFrame, name: str = "positions") -> DataFrame:
    """Staged blocks of the positional index of whole texts; every row of docs is in one block. Null texts have no words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        release()
        hashes, pack = WordHashes(), zstandard.ZstdCompressor(level=1).compress

        def out():
            lengths = np.array([len(h) for h in held], np.int64)
            all_terms = np.concatenate(held)
            place = np.arange(len(all_terms)) + np.repeat(np.arange(len(held)), lengths)
            order = np.argsort(all_terms, kind="stable")
            terms, counts = np.unique(all_terms[order], return_counts=True)
            row = {
                "docs": ids,
                "lengths": lengths.tolist(),
                "terms": pack(terms.astype("<u8").tobytes()),
                "counts": pack(counts.astype("<u4").tobytes()),
                "places": pack(np.diff(place[order], prepend=0).astype("<i4").tobytes()),
            }
            return pa.RecordBatch.from_pylist([row], pa.schema([("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())]))

        ids, held, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc_id)
                held.append(hashes.array(words(text.as_py())))
                size += len(held[-1])
                if size >= BLOCK_WORDS:
                    yield out()
                    ids, held, size = [], [], 0
        if ids:
            yield out()

    return stage(labelled_text(docs).mapInArrow(run, INDEX), name)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id (string; null as the empty one) and terms of each distinct window of each item."""

    def run(batches):
        import pyarrow as pa

        release()
        hashes = WordHashes()
        for batch in batches:
            names, found = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                terms = hashes.array(words(text)).astype("<u8")
                for k in range(max(1, len(terms) - size + 1) if len(terms) else 0):
                    names.append(item or "")
                    found.append(terms[k : k + size].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], ["item_id", "terms"])

    plain = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "item_id string, terms binary").distinct()


def search_block(block: Block, batch: list[tuple[str, bytes]]):
    """Places hit by any of these windows (as a mark for each place of the block), and the items found in each document."""
    import numpy as np

    marks = np.zeros(block.size + 1, np.int32)
    items: dict[int, set[str]] = {}
    by_length: dict[int, list[int]] = {}
    for k, (_, terms) in enumerate(batch):
        by_length.setdefault(len(terms) // 8, []).append(k)
    for length, members in by_length.items():
        asked = np.frombuffer(b"".join(batch[k][1] for k in members), "<u8").reshape(len(members), length)
        names, inverse = np.unique(asked, return_inverse=True)
        begins, ends = block.find(names)
        begins, ends = begins[inverse.reshape(asked.shape)], ends[inverse.reshape(asked.shape)]
        for k in np.flatnonzero((ends > begins).all(1)):
            found = block.phrase(begins[k], ends[k])
            if len(found):
                np.add.at(marks, found, 1)
                np.add.at(marks, found + length, -1)
                for doc in np.unique(block.doc_of(found)).tolist():
                    items.setdefault(doc, set()).add(batch[members[k]][0])
    return np.cumsum(marks[:-1]) > 0, items


def find_phrases(index: DataFrame, phrases: DataFrame, batch_size: int = BATCH_WINDOWS) -> DataFrame:
    """For each document of the index: doc_id, n_words, spans (start and end in words, merged, of all hits) and items (sorted as strings).

    phrases: item_id, terms, as windows() gives them.
    """
    path = stage(phrases, "windows")._staged_at

    def parts():
        held: list = []
        for found in staged_batches(path, ["item_id", "terms"], batch_size):
            held += zip(found.column("item_id").to_pylist(), found.column("terms").to_pylist(), strict=True)
            if len(held) >= batch_size:
                yield held
                held = []
        if held:
            yield held

    def run(rows):
        import numpy as np
        import pyarrow as pa

        release()
        only: list | None = None  # all windows, where they are one batch
        for record in rows:
            for at in range(record.num_rows):  # one block unpacked at a time
                row = record.slice(at, 1).to_pylist()[0]
                block = Block(row)
                marks, items, n = np.zeros(block.size, bool), {}, 0
                for batch in [only] if only is not None else parts():
                    hit, own = search_block(block, batch)
                    marks |= hit
                    for doc, names in own.items():
                        items.setdefault(doc, set()).update(names)
                    n += 1
                if n == 1:
                    only = batch
                elif n == 0:
                    only = []
                spans: list[list] = [[] for _ in block.docs]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
                owners = block.doc_of(edges[::2]).tolist()
                for doc, a, b in zip(owners, edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    spans[doc].append({"start": a - int(block.starts[doc]), "end": b - int(block.starts[doc])})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.docs, pa.int64()),
                        pa.array(block.lengths, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array([sorted(items.get(k, ())) for k in range(len(block.docs))], pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(run, "doc_id long, n_words long, spans array<struct<start: int, end: int>>, items array<string>")


def proximity_matches(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """doc_id, start and end (in words) of each smallest stretch of at most `within` words that holds all of these words, in any order."""
    asked = sorted({w for t in terms for w in words(t)})

    def run(rows):
        import numpy as np
        import pyarrow as pa

        release()
        wanted = WordHashes().array(asked)
        for record in rows:
            out: tuple[list, list, list] = ([], [], [])
            for at in range(record.num_rows):
                row = record.slice(at, 1).to_pylist()[0]
                block = Block(row)
                begins, ends = block.find(wanted)
                if not len(wanted) or (ends == begins).any():
                    continue
                places = np.concatenate([block.places[a:b] for a, b in zip(begins, ends, strict=True)])
                which = np.repeat(np.arange(len(wanted)), ends - begins)
                order = np.argsort(places)
                last = [-1] * len(wanted)
                found = []
                for place, k in zip(places[order].tolist(), which[order].tolist(), strict=True):
                    last[k] = place
                    start = min(last)
                    if start >= 0 and place - start < within:
                        if found and found[-1][0] == start:
                            continue
                        found.append((start, place + 1))
                for (a, b), doc, until in zip(found, block.doc_of(np.array([a for a, _ in found], np.int64)).tolist(), block.doc_of(np.array([b - 1 for _, b in found], np.int64)).tolist(), strict=True):
                    if doc == until:
                        for column, x in zip(out, (block.docs[doc], a - int(block.starts[doc]), b - int(block.starts[doc])), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["doc_id", "start", "end"])

    return index.mapInArrow(run, "doc_id long, start int, end int")


@tidy
def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Benchmark windows found in each document.

    A window is `size` consecutive words of an item, or all words of a shorter one. Returns doc_id, n_words, n_hit (words inside any
    window's occurrence), items (ids with occurring windows, sorted as strings), spans (start and end of hits, in words), contaminated
    (n_hit > 0 and 20 * n_hit >= n_words). Whole texts are read. A null or empty text has no words and is not contaminated; items without words have no
    windows; a null item_id counts as the empty string; repeated rows are each a row of the result; other columns are not read; an empty benchmark hits nothing.
    """
    found = find_phrases(build_index(docs), windows(benchmark, size))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).select("doc_id", "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
