"""Operator 10: exact SentencePiece BPE encoding by backtracking, and decoding.

An Aho-Corasick automaton over the vocabulary gives the pieces that match at each
position. The encoder takes the longest, and keeps it if it may follow the piece
before it: merging the text of the two again must give these two pieces. Where no
piece fits, the encoder steps back over the last piece and marks the position it
came from as failed in a bitfield, so no position is tried twice. A row of pieces
whose neighbours are all compatible is the one that merging by score gives.

Pieces hold the word mark at their start only, so texts are encoded word by word and
frequent words once. Runs of word marks all have the same score and are merged from
the left; they are handled apart.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from gazeloom.llm.common import labelled_text, release, table, texts, tidy
from gazeloom.llm.words import WordCache

MARK = "▁"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder for a BPE model with byte fallback; only its vocabulary is read from the model file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids = [self.unk] * 256
        self.surface: list[bytes] = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i):
                self.surface.append(b"")
            elif model.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.surface.append(piece.replace(MARK, " ").encode())
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece holds the word mark after other text; words can't be encoded apart")
        self.text = {i: piece for piece, i in self.ids.items()}
        self.mark = self.ids[MARK]
        self.runs = sorted((len(p) for p in self.ids if not p.strip(MARK)), reverse=True)
        self.letters = {p for p in self.ids if len(p) == 1}
        #: Pieces that merging their own text gives; no other can come out.
        self.whole = {p: i for p, i in self.ids.items() if (p.strip(MARK) or p == MARK) and self.merged(p) == [p]}
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.whole.items():
            self.matcher.add_word(piece, (i, len(piece)))
        self.matcher.make_automaton()
        self.pair: dict[tuple[int, int], bool] = {}
        self.cache = WordCache(lambda word: self.pack(self.encode_word(word)))
        self.bos_bytes, self.eos_bytes = self.pack([self.bos]), self.pack([self.eos])

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged(self, text: str) -> list[str]:
        """Pieces by merging neighbours, best score first and then leftmost. For the text of one or two pieces."""
        parts = list(text)
        score = self.score.get
        none = -float("inf")
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == none:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = score(parts[k] + parts[k + 1], none)
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a."""
        found = self.pair.get((a, b))
        if found is None:
            if len(self.pair) > 500_000:
                self.pair.clear()
            found = self.pair[a, b] = self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return found

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        n = len(text)
        begins: list[list[tuple[int, int]]] = [[] for _ in text]  # the pieces that start at each position, longest last
        for end, match in self.matcher.iter(text):
            begins[end - match[1] + 1].append(match)
        failed = bytearray(n // 8 + 1)
        ids: list[int] = []
        untried: list[int] = []  # for each id, how many shorter pieces its position has
        pair, fits = self.pair, self.fits
        at, last, k = 0, -1, len(begins[0])
        while at < n:
            options = begins[at]
            while k:
                k -= 1
                i, length = options[k]
                end = at + length
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                if last >= 0:
                    ok = pair.get((last, i))
                    if not (fits(last, i) if ok is None else ok):
                        continue
                ids.append(i)
                untried.append(k)
                at, last = end, i
                k = len(begins[at]) if at < n else 0
                break
            else:
                if not ids:
                    raise ValueError(f"no pieces for {text[:40]!r}")
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(self.text[ids.pop()])
                last = ids[-1] if ids else -1
                k = untried.pop()
        return ids

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word with its mark. Characters outside the vocabulary stand as bytes and join with nothing."""
        text = MARK + word
        whole = self.whole.get(text)
        if whole is not None:
            return [whole]
        if self.letters.issuperset(text):
            return self.backtrack(text)
        out: list[int] = []
        start = 0
        for at, c in enumerate(text):
            if c not in self.letters:
                if start < at:
                    out += self.backtrack(text[start:at])
                out += [self.byte_ids[x] for x in c.encode()]
                start = at + 1
        return out + self.backtrack(text[start:]) if start < len(text) else out

    def run(self, n: int) -> bytes:
        """Ids of n word marks that no word takes up."""
        ids = []
        for k in self.runs:
            ids += [self.ids[MARK * k]] * (n // k)
            n %= k
        return self.pack(ids)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers, with those of begin and end."""
        if not text:
            return self.bos_bytes + self.eos_bytes
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return self.bos_bytes + b"".join(map(self.cache.__getitem__, words)) + self.eos_bytes
        out, marks, alone = [self.bos_bytes], 0, self.pack([self.mark])
        for word in words:
            if not word:
                marks += 1
                continue
            ids = self.cache[word]
            if marks:
                if ids[:4] == alone:
                    ids, marks = ids[4:], marks + 1
                out.append(self.run(marks))
                marks = 0
            out.append(ids)
        return b"".join([*out, self.run(marks), self.eos_bytes])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that these ids stand for."""
        pieces = self.surface
        out = b"".join([pieces[i] for i in memoryview(ids).cast("I")])
        return out[1:] if out[:1] == b" " else out


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token ids and the text decoded from them, for each document.

    Returns doc_id, n_tokens (all ids), ids (binary, little-endian unsigned 32-bit), decoded.
    A null text counts as empty and gives begin and end alone. Texts are encoded whole;
    repeated rows give repeated results; other columns are not read. No row is moved.
    """
    path = path or model_path()

    def run(batches):
        import pyarrow as pa

        release()
        tool = codec(path)
        for batch in batches:
            ids = [tool.encode(text) for text in texts(batch.column("text"))]
            decoded = [tool.decode(x).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return labelled_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


@tidy
def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """encode_documents() with digests in place of ids and text, made in the same task so that the ids don't leave it."""
    path = path or model_path()

    def run(batches):
        import pyarrow as pa

        release()
        tool = codec(path)
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


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
