"""Operator 4: token ids in packed binary files.

A file holds the ids of a range of documents in ascending doc_id order:

    magic "GZLTOK1\\n", bits (uint8), 7 zero bytes, ids in a block (uint64)
    blocks: each packs its ids, most significant bit first, into the fewest bits that
        hold the vocabulary, and begins at a whole byte
    block offsets in the file (uint64 each, one more than blocks)
    doc_ids (int64), 1 where a doc_id is present (uint8), first id of each document in the file (uint64, one more)
    footer: documents, ids, blocks, place of the offsets (uint64 each)

All integers are little-endian. A block is unpacked with numpy at once, and any id is
found by reading its block alone. `write_token_files` returns the manifest: a row for
each file, with the number of ids in all files before it.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.common import labelled_text, new_path, release, shuffle_partitions, small_batches, table, texts
from gazeloom.llm.words import WordCache

MAGIC = b"GZLTOK1\n"
HEAD = struct.Struct("<8sB7xQ")
FOOT = struct.Struct("<QQQQ")
BLOCK = 1 << 16
END_ID = 2
MANIFEST = "file_no int, path string, n_docs long, n_ids long, n_bytes long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(ids, bits: int) -> bytes:
    """Ids in so many bits each, most significant first; the last byte is filled with zeros."""
    import numpy as np

    ids = np.asarray(ids, dtype=np.uint32)
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    return np.packbits(np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]).tobytes()


def unpack(data: bytes, bits: int, n: int):
    """The first n ids, as uint32."""
    import numpy as np

    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f">u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").reshape(n).astype(np.uint32)


def open_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class TokenFileWriter:
    """Writes one file. Holds one block of ids and the documents' starts. The file takes its name when it is whole."""

    def __init__(self, path: str, bits: int) -> None:
        self.store, self.path = open_store(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.store.open_output_stream(self.part)
        self.bits, self.n_ids, self.at = bits, 0, HEAD.size
        self.out.write(HEAD.pack(MAGIC, bits, BLOCK))
        self.offsets, self.docs, self.starts = [self.at], [], []
        self.held, self.n_held = [], 0

    def add(self, doc_id: int | None, ids) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self.flush()

    def flush(self, all_of_it: bool = False) -> None:
        import numpy as np

        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            data = pack(ids[k : min(k + BLOCK, whole)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes of the file."""
        import numpy as np

        self.flush(all_of_it=True)
        tail = [
            np.array(self.offsets, "<u8").tobytes(),
            np.array([x or 0 for x in self.docs], "<i8").tobytes(),
            np.array([x is not None for x in self.docs], "u1").tobytes(),
            np.array([*self.starts, self.n_ids], "<u8").tobytes(),
            FOOT.pack(len(self.docs), self.n_ids, len(self.offsets) - 1, self.at),
        ]
        for x in tail:
            self.out.write(x)
        self.out.close()
        self.store.move(self.part, self.path)
        return len(self.docs), self.n_ids, self.at + sum(map(len, tail))


class TokenFile:
    """Reads a file: any stretch of its ids, or document by document."""

    def __init__(self, path: str) -> None:
        import numpy as np

        store, inner = open_store(path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        magic, self.bits, self.block = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.n_docs, self.n_ids, n_blocks, at = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        tail = self.file.read_at(size - FOOT.size - at, at)
        self.offsets = np.frombuffer(tail, "<u8", n_blocks + 1)
        tail = tail[8 * (n_blocks + 1) :]
        doc_ids, present = np.frombuffer(tail, "<i8", self.n_docs), np.frombuffer(tail, "u1", self.n_docs, 8 * self.n_docs)
        self.doc_ids = [x if y else None for x, y in zip(doc_ids.tolist(), present.tolist(), strict=True)]
        self.starts = np.frombuffer(tail, "<u8", self.n_docs + 1, 9 * self.n_docs).astype(np.int64)

    def ids(self, start: int, stop: int):
        """Ids from start up to stop, from the blocks that hold them."""
        import numpy as np

        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        out = []
        for k in range(first, last + 1):
            at = int(self.offsets[k] - self.offsets[first])
            out.append(unpack(data[at : int(self.offsets[k + 1] - self.offsets[first])], self.bits, min(self.block, self.n_ids - k * self.block)))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def documents(self, step: int = 16) -> Iterator[tuple[int | None, int, object]]:
        """doc_id, place of the first id in the file, and ids; reads so many blocks at once."""
        k, base, ids = 0, 0, self.ids(0, 0)
        while k < self.n_docs:
            a, b = int(self.starts[k]), int(self.starts[k + 1])
            if b > base + len(ids):
                base, ids = a, self.ids(a, max(b, min(self.n_ids, a + step * self.block)))
            yield self.doc_ids[k], a, ids[a - base : b - base]
            k += 1

    def close(self) -> None:
        self.file.close()


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes stand for themselves, the others follow from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(others)}


class OddSpaceError(ValueError):
    """A text has white space other than single spaces between words."""


class WordEncoder:
    """Ids of a text by the tokenizers library, the same as `Tokenizer.encode(text, add_special_tokens=False)` gives.

    Where the tokenizer is a byte-level BPE whose pattern begins a new word at each space before other text, such words are encoded apart and frequent
    ones once. Words of letters, with or without ASCII marks behind them, are one or two words of the pattern and go to the library's BPE model at once; any
    other goes through the whole tokenizer, as does a text with white space that isn't a single space between words, or with the string of an added
    token. Under a tokenizer of any other form each text goes through the whole tokenizer.
    """

    #: Letters, then marks other than the apostrophe.
    MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = special_as_text
        self.vocabulary = self.tool.get_vocab_size()
        self.model = self.tool.model
        added = [t for t in self.tool.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = [t.content for t in added]
        self.by_words = self.has_known_form() and not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added)
        if self.by_words:
            self.model = self.uncached(path)
        self.letters = byte_letters()
        self.tails: dict[str, bytes] = {}
        self.cache = WordCache(self.spaced, 900_000)

    def has_known_form(self) -> bool:
        """Whether words that follow a space may be encoded apart: a byte-level pattern without a prefix, and a plain BPE model."""
        import json

        from tokenizers.models import BPE

        split = json.loads(self.tool.pre_tokenizer.__getstate__()) if self.tool.pre_tokenizer else {}
        level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        model = self.model
        plain = isinstance(model, BPE) and not (model.dropout or model.ignore_merges or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix)
        return bool(level and plain) and self.tool.normalizer is None and self.tool.truncation is None and self.tool.padding is None

    @staticmethod
    def uncached(path: str):
        """The BPE model of the file without the library's own cache: the words that come to it are mostly new, and ours has the others."""
        import json

        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        return BPE(vocab=model["vocab"], merges=[tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], cache_capacity=0)

    def library(self, text: str) -> bytes:
        return array("I", self.tool.encode(text, add_special_tokens=False).ids).tobytes()

    def one(self, word: str) -> bytes:
        """Ids of one word of the pattern."""
        written = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def spaced(self, word: str) -> bytes:
        """Ids of a word with a space before it. What isn't a word comes here each time, since only words are kept."""
        if not word or word[0].isspace():
            raise OddSpaceError
        if word.isalpha():
            return self.one(" " + word)
        marked = self.MARKED.fullmatch(word)
        if marked and marked[1].isalpha():
            tail = self.tails.get(marked[2])
            if tail is None:
                tail = self.one(marked[2])
                if len(self.tails) < 10_000:
                    self.tails[marked[2]] = tail
            return self.cache[marked[1]] + tail
        return self.library(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        head, *words = text.split(" ")
        if not self.by_words or not head or head[0].isspace() or any(a in text for a in self.added):
            return self.library(text)
        try:
            return self.library(head) + b"".join(map(self.cache.__getitem__, words))
        except OddSpaceError:
            return self.library(text)


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    return WordEncoder(path, special_as_text)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, n_files: int | None = None, special_as_text: bool = False) -> DataFrame:
    """Encode every document and write token files to a folder that driver and executors share.

    Returns the manifest: file_no, path, n_docs, n_ids, n_bytes, start (ids in all files before). Files
    follow each other in doc_id order, null doc_ids first; rows that share a doc_id stand side by side,
    ordered by text. A null text counts as empty and gives end_id alone. The range of each file comes from quantiles of
    doc_id; where one doc_id fills several files, its rows are spread over them. An empty table gives no file.
    The string of a special token inside a text becomes that token's id, as the library does it; with special_as_text it is ordinary text.
    Ids are encoded before the shuffle, in 16 or 32 bits. A task that runs again writes the same file under its own
    name first and then puts it in place.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    n = n_files or shuffle_partitions(spark)
    plain = labelled_text(docs)
    if n > 1:
        found = plain.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0]
        bounds = list(found or [])
    else:
        bounds = []

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        release()
        tool = encoder(path, special_as_text)
        narrow = max(tool.vocabulary, end_id + 1) <= 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        edges = np.array(bounds, np.int64)
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            ids = batch.column("doc_id").to_pylist()
            said = texts(batch.column("text"))
            data = [tool.encode(x) + end for x in said]
            if narrow:
                data = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in data]
            tie = np.array([zlib.crc32(x.encode()) for x in said], np.int64)
            keys = np.array([x if x is not None else -(1 << 63) for x in ids], np.int64)
            low, high = np.searchsorted(edges, keys, "left"), np.searchsorted(edges, keys, "right")
            file_no = low + (tie * (high - low + 1) >> 32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(file_no, pa.int32()), pa.array(ids, pa.int64()), pa.array(tie, pa.int64()), pa.array(data, pa.binary())],
                ["file_no", "doc_id", "tie", "data"],
            )

    def write(batches):
        import numpy as np
        import pyarrow as pa

        release()
        tool = encoder(path, special_as_text)
        size = max(tool.vocabulary, end_id + 1)
        out, kind = None, "<u2" if size <= 1 << 16 else "<u4"
        for batch in batches:
            numbers = batch.column("file_no").to_pylist()
            for no, doc_id, data in zip(numbers, batch.column("doc_id").to_pylist(), batch.column("data"), strict=True):
                if out is None:
                    file_no, name = no, f"{folder}/ids-{no:08d}.bin"
                    out = TokenFileWriter(name, max(1, (size - 1).bit_length()))
                out.add(doc_id, np.frombuffer(data.as_buffer(), kind).astype(np.uint32))
        if out is not None:
            n_docs, n_ids, n_bytes = out.close()
            yield pa.RecordBatch.from_pylist([{"file_no": file_no, "path": name, "n_docs": n_docs, "n_ids": n_ids, "n_bytes": n_bytes}], pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    made = (
        plain.mapInArrow(encode, "file_no int, doc_id long, tie long, data binary")
        .repartitionById(n, F.col("file_no"))
        .sortWithinPartitions("file_no", "doc_id", "tie")
        .mapInArrow(write, MANIFEST)
    )
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    files, start = [], 0
    with small_batches(spark):
        rows = sorted(made.collect())  # a row for each file: as many as shuffle partitions
    for row in rows:
        files.append((*row, start))
        start += row["n_ids"]
    manifest = spark.createDataFrame(files, MANIFEST + ", start long")
    return manifest.repartitionById(max(1, len(files)), F.expr("cast(file_no as int)")) if len(files) > 1 else manifest


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned 32-bit), read from the files."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["path"])
                rows: tuple[list, list, list, list] = ([], [], [], [])
                for doc_id, at, ids in file.documents():
                    for column, x in zip(rows, (doc_id, row["start"] + at, len(ids), ids.astype("<u4").tobytes()), strict=True):
                        column.append(x)
                    if len(rows[0]) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])
                        rows = ([], [], [], [])
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])
                file.close()

    return manifest.select("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), new_path(spark, "token-files"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
