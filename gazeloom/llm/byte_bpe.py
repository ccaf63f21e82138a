"""Operator 13: byte-level BPE by a table of prefixes, which can be appended to and edited.

A pattern cuts a text into pieces, and each piece is encoded alone. Among the tokens that end a
prefix of a piece, exactly one may be the last of its encoding: the one that fits behind the last
token of the prefix before it, that is, merging the bytes of the two again gives these two. So one
pass from left to right gives each prefix its last token, and the encoding is read from the end.
The last tokens of a prefix never depend on what follows it: appending goes on where the table ends.

The table of a text has one entry a byte: the last token of the prefix of its piece that ends
there, and a flag where a piece ends. `encode_documents(prefixes=True)` keeps it, and
`edit_documents` takes it up: pieces before an edit are taken over, the piece that holds the edit
keeps the entries before it, and behind the edit everything is taken over from where an old
and a new piece end at the same place.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.common import labelled_text, release, table, texts, tidy
from gazeloom.llm.words import WordCache

#: Marks in a table the last byte of a piece; token ids are smaller.
PIECE_END = 1 << 31
#: Bytes of three characters: the pattern looks at no more than two characters behind a piece to end it there.
LOOK_AHEAD = 12
#: Words in one of the two generations of a worker's cache.
CACHED_WORDS = 300_000
#: No rank is so high.
NEVER = 1 << 62
#: Stands for the token before the first.
START = -1  # the last of PrefixCodec.follow


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class PrefixCodec:
    """Encoder and decoder by the ranks of a file: each line a token in base64 and its rank, which is its id."""

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import ahocorasick
        import regex

        with open(path, "rb") as source:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in source if line.strip())}
        self.bytes_of = {i: token for token, i in self.rank.items()}
        self.size = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        self.surface = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        # White space is Unicode's; the regex module's own \s may hold more.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.blank_edge = regex.compile(r"\A\p{White_Space}|\p{White_Space}\Z|\A\Z")
        #: The two tokens that are merged last to make each token. A token that merging its own bytes doesn't give has none; it can only stand for a whole piece.
        self.halves = {token: found for token in self.rank if len(token) > 1 and (found := self.halved(token))}
        self.whole = [token for token in self.rank if len(token) == 1 or token in self.halves]
        if any(self.rank[token] <= self.rank[part] for token, parts in self.halves.items() for part in parts if len(part) > 1):
            raise ValueError("a token has a lower rank than its parts; merges don't come in order of rank")
        self.matcher = ahocorasick.Automaton()
        for token in self.whole:
            self.matcher.add_word(token.decode("latin-1"), (self.rank[token], len(token)))
        self.matcher.make_automaton()
        self.longest = max(map(len, self.whole))
        #: What each token may be followed by, as far as it was asked; a piece may begin with any token.
        self.follow: list[dict[int, bool]] = [{} for _ in self.size] + [{self.rank[token]: True for token in self.whole}]
        self.edges: tuple[dict, dict] = ({}, {})
        self.cache = WordCache(self.encode_chunk, CACHED_WORDS)

    def halved(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The last two parts of a token when its bytes are merged, lowest rank first and then leftmost; None if they end as other tokens."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
            k = ranks.index(min(ranks))
            if ranks[k] == NEVER:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts[0], parts[1]

    def grown(self, token: bytes, side: int) -> list[int]:
        """What stands at one edge of a token while it is merged, from its outermost byte to itself: tokens, each made from the one before it. side: 0 for its left edge, 1 for its right."""
        out = []
        while len(token) > 1:
            out.append(self.rank[token])
            token = self.halves[token][side]
        return [self.rank[token], *out[::-1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a within a piece: whether merging the bytes of both, lowest rank first and then leftmost, never joins what stands at the right edge of a with what stands at the left edge of b."""
        left, right = self.edge(a, 1), self.edge(b, 0)
        x = y = 0
        ok = True
        while ok:
            # A token has a higher rank than its parts, so merges come in order of rank: these are the next ones to the left and to the right.
            next_x = left[x + 1] if x + 1 < len(left) else NEVER
            next_y = right[y + 1] if y + 1 < len(right) else NEVER
            across = self.rank.get(self.bytes_of[left[x]] + self.bytes_of[right[y]], NEVER)
            if across < next_x and across <= next_y and across != NEVER:
                ok = False
            elif next_x == next_y == NEVER:
                break
            elif next_x <= next_y:
                x += 1
            else:
                y += 1
        self.follow[a][b] = ok
        return ok

    def edge(self, i: int, side: int) -> list[int]:
        found = self.edges[side].get(i)
        if found is None:
            found = self.edges[side][i] = self.grown(self.bytes_of[i], side)
        return found

    def last_tokens(self, piece: bytes, known: list[int] | tuple = ()) -> list[int]:
        """The last token of each prefix of a piece, from one byte to all, and START behind them. known: those of its first prefixes, from the table of a piece that began alike."""
        n, done = len(piece), len(known)
        # The entry behind the last one is that of no byte: its place is -1.
        last = [*known, *[-1] * (n - done), START]
        follow, fits = self.follow, self.fits
        # No token is longer than the longest, so matches that end behind the known prefixes start at most so far before.
        skip = max(0, done - self.longest + 1)
        if skip:
            matches = ((end + skip, match) for end, match in self.matcher.iter(piece[skip:].decode("latin-1")))
        else:
            matches = self.matcher.iter(piece.decode("latin-1"))
        for end, (i, length) in matches:
            if last[end] < 0:
                before = last[end - length]
                ok = follow[before].get(i)
                if ok or (ok is None and fits(before, i)):
                    last[end] = i
        if last[n - 1] < 0:
            raise ValueError(f"no tokens for {piece[:40]!r}")
        return last

    def ids_of(self, piece: bytes, last: list[int]) -> list[int]:
        """The tokens of a piece, read from its last prefix back."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        out, at, size = [], len(piece), self.size
        while at:
            i = last[at - 1]
            out.append(i)
            at -= size[i]
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        return [whole] if whole is not None else self.ids_of(piece, self.last_tokens(piece))

    def encode_plain(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without cutting the text at spaces first."""
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.encode_piece(piece.encode())
        return packed(ids)

    def encode_chunk(self, word: str) -> bytes | None:
        """Ids of a word with a space before it; None if white space at an edge of it may be one piece with what is beside it."""
        if word.isascii() and word.isalpha():  # one piece
            return packed(self.encode_piece(b" " + word.encode()))
        return None if self.blank_edge.search(word) else self.encode_plain(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids of a text. No piece crosses a single space from the left that has other characters than white space on both sides, so a text is encoded from space to space and frequent words once."""
        head, *words = text.split(" ")
        if self.blank_edge.search(head) and text:
            return self.encode_blanks([head, *words])
        try:
            return self.encode_plain(head) + b"".join(map(self.cache.__getitem__, words))
        except TypeError:  # a word with white space at an edge
            return self.encode_blanks([head, *words])

    def encode_blanks(self, words: list[str]) -> bytes:
        """As encode(), with words that lie at white space encoded together."""
        out, held, open_ = [], [], True
        for k, word in enumerate(words):
            blank = bool(self.blank_edge.search(word))
            if k and not blank and not open_:
                if held:
                    out.append(self.encode_plain(" ".join(held)))
                    held = []
                out.append(self.cache[word])
                continue
            # Held words begin at the text's start, or with the space before the first of them.
            held = held or ([] if k == 0 else [""])
            held.append(word)
            open_ = blank
        if held:
            out.append(self.encode_plain(" ".join(held)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        surface = self.surface
        return b"".join([surface[i] for i in memoryview(ids).cast("I")])

    # Tables of prefixes.

    def prefixes(self, text: str) -> bytes:
        """The table of a text: an unsigned 32-bit integer for each byte, the last token of the prefix of its piece, with PIECE_END at a piece's last byte."""
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.last_tokens(piece.encode())[:-1]
            out[-1] |= PIECE_END
        return packed(out)

    def ids_from(self, data: bytes, prefixes: bytes) -> bytes:
        """Ids of a text from its table alone."""
        import numpy as np

        cells = memoryview(prefixes).cast("I")
        ids: list[int] = []
        start = 0
        for end in (np.flatnonzero(np.frombuffer(prefixes, "<u4") & PIECE_END) + 1).tolist():
            last = cells[start:end].tolist()
            last[-1] ^= PIECE_END
            ids += self.ids_of(data[start:end], last)
            start = end
        return packed(ids)

    def edit(self, data: bytes, prefixes: bytes, at: int, removed: int, inserted: bytes) -> tuple[bytes, bytes, int]:
        """A text's bytes and table after an edit at byte `at`, and how many entries of the table were made anew. All places are those of whole characters."""
        import numpy as np

        new = data[:at] + inserted + data[at + removed :]
        ends = (np.flatnonzero(np.frombuffer(prefixes, "<u4") & PIECE_END) + 1).tolist()
        kept = bisect_right(ends, at - LOOK_AHEAD)
        start = ends[kept - 1] if kept else 0
        old = memoryview(prefixes).cast("I")
        next_end = dict(zip([start, *ends[kept:]], ends[kept:], strict=False))  # where old pieces begin and end, from here on
        out = [prefixes[: 4 * start]]
        shift, behind, made = len(inserted) - removed, at + len(inserted), 0
        for match in self.pattern.finditer(new[start:].decode()):
            piece = match.group().encode()
            # An old piece that began here began alike, up to the edit.
            same = min(next_end.get(start, start), at, start + len(piece)) if start < at else start
            last = self.last_tokens(piece, [x & ~PIECE_END for x in old[start:same].tolist()])
            made += len(piece) - (same - start)
            last[-2] |= PIECE_END
            out.append(packed(last[:-1]))
            start += len(piece)
            if start >= behind and start - shift in next_end:
                out.append(prefixes[4 * (start - shift) :])
                break
        return new, b"".join(out), made


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> PrefixCodec:
    return PrefixCodec(path, pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, prefixes: bool = False) -> DataFrame:
    """Token ids of each document, each match of the pattern encoded separately, without special tokens, and the text decoded from them.

    Returns doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded; with prefixes=True also text (as encoded) and prefixes,
    the table that edit_documents() takes, four bytes a byte of text. A null or empty text has no tokens. Texts are encoded whole; repeated
    rows give repeated results; a null doc_id stays null; other columns are not read. No row is moved.
    """
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches):
        import pyarrow as pa

        release()
        tool = codec(path, pattern)
        for batch in batches:
            own = texts(batch.column("text"))
            tables = [tool.prefixes(text) for text in own] if prefixes else []
            ids = [tool.ids_from(text.encode(), t) for text, t in zip(own, tables, strict=True)] if prefixes else [tool.encode(text) for text in own]
            decoded = [tool.decode(x).decode("utf-8", "replace") for x in ids]
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())}
            if prefixes:
                columns |= {"text": pa.array(own, pa.string()), "prefixes": pa.array(tables, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return labelled_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string" + (", text string, prefixes binary" if prefixes else ""))


def edit_documents(encoded: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encoded documents after edits, re-encoded near the edit alone.

    encoded: as encode_documents(prefixes=True) gives it. edits: doc_id, at, removed, inserted: from character `at` (null, or beyond the end: at the end, which
    appends) so many characters are removed (null: none) and a text is put in (null: none). A negative number counts as 0. Returns a row for each pair of document and edit with
    equal doc_id: doc_id, n_tokens, ids, text, prefixes, and n_made, the number of entries of the table that were made anew. Several edits of
    a document are alternatives, each a row; a null doc_id meets nothing; other columns are not read. Documents meet their edits by an equal key, in a join that Spark may split.
    """
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches):
        import pyarrow as pa

        release()
        tool = codec(path, pattern)
        for batch in batches:
            found = {k: [] for k in ("n_tokens", "ids", "text", "prefixes", "n_made")}
            for row in batch.select(["text", "prefixes", "at", "removed", "inserted"]).to_pylist():
                text, size = row["text"], len(row["text"])
                at = size if row["at"] is None else min(max(row["at"], 0), size)
                removed = min(max(row["removed"] or 0, 0), size - at)
                new, cells, made = tool.edit(text.encode(), row["prefixes"], len(text[:at].encode()), len(text[at : at + removed].encode()), (row["inserted"] or "").encode())
                ids = tool.ids_from(new, cells)
                for k, v in (("n_tokens", len(ids) // 4), ("ids", ids), ("text", new.decode()), ("prefixes", cells), ("n_made", made)):
                    found[k].append(v)
            kinds = {"n_tokens": pa.int64(), "ids": pa.binary(), "text": pa.string(), "prefixes": pa.binary(), "n_made": pa.int64()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[k], kinds[k]) for k in kinds)], ["doc_id", *kinds])

    asked = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("at").cast("long").alias("at"), F.col("removed").cast("long").alias("removed"), F.col("inserted").cast("string").alias("inserted"))
    return encoded.select("doc_id", "text", "prefixes").join(asked, "doc_id").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string, prefixes binary, n_made long")


@tidy
def digest_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encode_documents() with digests in place of ids and text, made in the same task so that the ids don't leave it.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256. A null or empty text has no tokens and the digests of nothing; repeated rows give
    repeated results; a null doc_id stays null; other columns, whatever their names, are not read.
    """
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches):
        import pyarrow as pa

        release()
        tool = codec(path, pattern)
        for batch in batches:
            sizes, ids_digests, text_digests = [], [], []
            for text in texts(batch.column("text")):
                ids = tool.encode(text)
                sizes.append(len(ids) // 4)
                ids_digests.append(hashlib.sha256(ids).hexdigest())
                text_digests.append(hashlib.sha256(tool.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return labelled_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded; digests of both."""
    return digest_documents(table(spark, sf_dir, "documents"))
