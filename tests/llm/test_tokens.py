import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest

from gazeloom.llm import sentencepiece_codec as P
from gazeloom.llm import token_files as T

PARTS = ["a", "b", "the", " ", "  ", "   ", "\n", "\t", "▁", "é", "ß", "日本", "😀", "̀", "1", "23", "...", "<s>", "</s>", "<0x41>", "<unk>", "$", "ing", "tion", "Ab", " ", "　", "\r", " " * 17, "▁▁", "ﬁ", "->", "\\", "{", "don't", "it's!", "x²", "²a", "word***", "_a", "a_b", "<|endoftext|>", "\x1c"]


def some_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_pieces_are_those_of_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.model_path())
    tool = P.codec(P.model_path())
    for text in [*some_texts(5000, 1), "x" * 3000, " " * 100, "ab" * 2000, "日" * 50, "\0"]:
        want = model.encode(text, add_bos=True, add_eos=True)
        ids = tool.encode(text)
        assert array("I", ids).tolist() == want, text
        assert tool.decode(ids).decode("utf-8", "replace") == model.decode(want), text


def test_sentencepiece_rows(documents):
    rows = [(1, "Hello there"), (2, None), (3, ""), (1, "Hello there"), (None, "x"), (5, "long " * 30_000)]
    found = P.digest_documents(documents(rows)).collect()
    assert len(found) == len(rows)
    empty = hashlib.sha256(array("I", [1, 2]).tobytes()).hexdigest()
    assert {r["ids_sha256"] for r in found if r["doc_id"] in (2, 3)} == {empty}
    assert {r["decoded_sha256"] for r in found if r["doc_id"] == 1} == {hashlib.sha256(b"Hello there").hexdigest()}
    assert P.encode_documents(documents([(1, "a b")])).first()["decoded"] == "a b"
    assert P.digest_documents(documents([])).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = T.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (T.unpack(data, bits, 1001) == ids).all()


def plain_tokenizer():
    """A tokenizer of the library that nothing of ours has touched."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.tokenizer_path())


def test_words_as_the_library():
    tool, plain = T.encoder(T.tokenizer_path()), plain_tokenizer()
    special = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a <|endoftext| > b", "<|endoftext|><|endoftext|> tail ", "word " * 9000 + "<|endoftext|>"]
    assert tool.by_words
    assert array("I", tool.encode(special[0])).tolist() == [64, 220, 50256, 275]
    for text in [*some_texts(4000, 2), *special]:
        assert array("I", tool.encode(text)).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_special_strings_as_text():
    tool, plain = T.encoder(T.tokenizer_path(), True), plain_tokenizer()
    plain.encode_special_tokens = True
    for text in [*some_texts(500, 4), "a <|endoftext|> b", "<|endoftext|>"]:
        assert array("I", tool.encode(text)).tolist() == plain.encode(text, add_special_tokens=False).ids, text
        assert 50256 not in array("I", tool.encode(text))


def test_tokenizer_of_another_form():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tool, plain = T.WordEncoder(path), Tokenizer.from_file(path)
    assert not tool.by_words
    for text in some_texts(300, 5):
        assert array("I", tool.encode(text)).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, documents, tmp_path):
    texts = some_texts(300, 3)
    rows = [(n * 7 % 301, t) for n, t in enumerate(texts)] + [(5, None), (5, "again"), (6, "to <|endoftext|> and on"), (None, "no id"), (400, "long word " * 20_000)]
    manifest = T.write_token_files(documents(rows), f"file://{tmp_path}/t", n_files=5)
    assert {r["n_docs"] > 0 for r in manifest.collect()} == {True}
    found = sorted(T.read_token_files(manifest).collect(), key=lambda r: r["start"])
    plain = plain_tokenizer()
    want = sorted((i if i is not None else -1, t or "") for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, bytes(r["ids"])) for r in found) == sorted((i, array("I", [*plain.encode(t, add_special_tokens=False).ids, 2]).tobytes()) for i, t in want)
    assert [r["doc_id"] if r["doc_id"] is not None else -1 for r in found] == [i for i, _ in want]
    at = 0
    for r in found:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]


def test_hot_doc_id_is_spread(documents, tmp_path):
    rows = [(1, f"text {n}") for n in range(400)] + [(n, "x") for n in range(2, 100)]
    manifest = T.write_token_files(documents(rows), f"file://{tmp_path}/t", n_files=8)
    assert max(r["n_docs"] for r in manifest.collect()) < 200
    ids = [r["doc_id"] for r in sorted(T.read_token_files(manifest).collect(), key=lambda r: r["start"])]
    assert ids == sorted(ids)


def test_any_stretch_of_a_file(tmp_path):
    ids = np.arange(200_000, dtype=np.uint32) * 7 % 50_000
    out = T.TokenFileWriter(f"file://{tmp_path}/x.bin", 16)
    for k in range(0, 200_000, 1000):
        out.add(k, ids[k : k + 1000])
    out.close()
    file = T.TokenFile(f"file://{tmp_path}/x.bin")
    for a, b in ((0, 10), (65_530, 65_540), (1, 200_000), (131_072, 131_073), (5, 5)):
        assert (file.ids(a, b) == ids[a:b]).all()
    assert (file.n_docs, file.n_ids, zlib.crc32(file.ids(0, 200_000).tobytes())) == (200, 200_000, zlib.crc32(ids.tobytes()))
    assert not list(tmp_path.glob("*.part"))


def test_no_documents(documents, tmp_path):
    manifest = T.write_token_files(documents([]), f"file://{tmp_path}/t")
    assert manifest.count() == 0
    assert T.read_token_files(manifest).count() == 0
