"""Operators 11 and 13: periodic runs against brute force, byte-level BPE against the library."""

import hashlib
import random
import struct
import zlib

import pytest

from gazeloom.llm import byte_bpe, periodic_runs


def brute_runs(words, least_words=24, least_periods=3):
    out = []
    for q in range(1, len(words) // least_periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if j > i and len(part) >= max(least_words, least_periods * q) and not any(part[:-p] == part[p:] for p in range(1, q)):
                out.append((i, len(part), q))
            i = max(i + 1, j + 1 if j > i else 0)
    return sorted(out, key=lambda r: (r[0], r[2]))


def nested(rng):
    """Words with runs of many periods, with repeats inside periods and faults between runs."""
    n, out = rng.randint(0, 600), []
    while len(out) < n:
        if rng.random() < 0.3:
            out += [b"%d" % rng.randint(0, 9) for _ in range(rng.randint(1, 60))]
            continue
        q = rng.choice([1, 2, 3, 7, 20, 31, 32, 33, 40, 63, 64, 65, 100, 130])
        base = [b"%d" % rng.randint(0, rng.choice([0, 1, 5, 1000])) for _ in range(q)]
        if q > 10 and rng.random() < 0.5:
            at, inner = rng.randint(0, q - 5), base[: rng.choice([1, 2, 3, 5])]
            size = rng.randint(0, q - at)
            base[at : at + size] = (inner * size)[:size]
        out += (base * 6)[: int(q * rng.uniform(2.5, 5))]
    return out[:n]


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        documents = [nested(rng) for _ in range(rng.randint(1, 4))]
        assert list(periodic_runs.scan(documents)) == [brute_runs(d) for d in documents]


def test_long_and_hard_words():
    for words, runs in (([b"a"] * 200_000, [(0, 200_000, 1)]), ([b"%d" % (i % 50_000) for i in range(200_000)], [(0, 200_000, 50_000)]), ([b"%d" % (bin(i).count("1") % 2) for i in range(1 << 17)], [])):
        assert list(periodic_runs.scan([words])) == [runs]


def test_other_bounds():
    words = (b"a b c d " * 4).split()
    assert list(periodic_runs.scan([words], 16, 4)) == [[(0, 16, 4)]]
    assert list(periodic_runs.scan([words], 16, 5)) == [[]]
    with pytest.raises(ValueError):
        list(periodic_runs.scan([words], 100))


def op11_row(doc_id, text):
    """The row of the contract, by plain rules."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in runs)]
    best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if runs else (None,) * 3
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_op11_rows(spark, documents):
    rng = random.Random(4)
    rows = [(i, b" ".join(nested(rng)).decode()) for i in range(60)]
    rows += [(None, "x y " * 30), (7, None), (7, None), (8, ""), (9, " \t\n"), (10, "w " * 100), (10, "w " * 100), (11, " a " * 40), (12, "one")]
    docs = documents(rows).unionByName(documents([]))
    got = sorted(map(tuple, periodic_runs.digest_runs(docs, periodic_runs.plant).collect()), key=repr)
    assert got == sorted((op11_row(*r) for r in rows), key=repr)
    assert periodic_runs.digest_runs(documents([])).count() == 0


def test_runs_and_collapsed_texts(spark, documents):
    docs = documents([(1, "go " * 30 + "on"), (2, "a b c"), (3, None), (None, "k " * 24)])
    assert sorted(map(tuple, periodic_runs.periodic_runs(docs).collect()), key=repr) == sorted([(1, 0, 30, 1), (None, 0, 24, 1)], key=repr)
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.collapse_runs(docs).collect()}
    assert got == {1: ("go on", 31, 29), 2: ("a b c", 3, 0), 3: ("", 0, 0), None: ("k", 24, 23)}


def test_op11_query(spark, sf_dir):
    from gazeloom.llm.registry import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: op11_row(r.doc_id, r.text) for r in docs if len((r.text or "").split()) < 1500}
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()]
    assert len(got) == len(docs) and len(short) > 100
    assert all(r == short.get(r[0], r) for r in got)


# Byte-level BPE.


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(byte_bpe.ranks_path(), byte_bpe.split_pattern())


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=codec.rank, special_tokens={})


ALPHABET = [" "] * 6 + list("abcdeést'lrvmdABC0129.,!?-\n\t\r\x0b\x1c\x85 　中文字日本🙂é́") + ["'ll", "'re", " the", "ing", "  ", "\n\n"]


def odd_text(rng, most):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


def ids(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_encoding_equals_the_library(codec, library):
    rng = random.Random(1)
    for text in [odd_text(rng, 50) for _ in range(5000)] + ["", " ", "\n", "a" * 100_000, " " * 50_000 + "x", "'" * 500 + "ll", "9" * 50_000, "é" * 20_000, "the " * 20_000, "<|endoftext|>"]:
        found = codec.encode(text)
        assert ids(found) == library.encode_ordinary(text)
        assert codec.decode(found) == text.encode()


def test_each_prefix_has_its_last_token(codec, library):
    rng = random.Random(2)
    for _ in range(300):
        piece = "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 20)))
        last = codec.last_tokens(piece.encode())
        assert last[:-1] == [library.encode_ordinary(piece[: k + 1])[-1] for k in range(len(piece))]


def test_edits_give_the_table_of_the_new_text(codec):
    rng = random.Random(3)
    for _ in range(3000):
        text, more = odd_text(rng, 60), odd_text(rng, 10)
        at = rng.choice([len(text), rng.randint(0, len(text))])
        gone = min(rng.choice([0, 0, 1, 3, 20]), len(text) - at)
        new, cells, made = codec.edit(text.encode(), codec.prefixes(text), len(text[:at].encode()), len(text[at : at + gone].encode()), more.encode())
        assert new.decode() == text[:at] + more + text[at + gone :]
        assert cells == codec.prefixes(new.decode())
        assert codec.ids_from(new, cells) == codec.encode(new.decode())
    text = odd_text(rng, 0) + "some words and more of them, " * 5000
    _, _, made = codec.edit(text.encode(), codec.prefixes(text), 70_000, 3, b"xyz")
    assert made < 60


def test_op13_rows(spark, documents, library):
    rng = random.Random(5)
    rows = [(i, odd_text(rng, 200)) for i in range(80)] + [(None, "no id"), (1, None), (2, ""), (3, "twice"), (3, "twice"), (4, "word " * 30_000)]
    docs = documents(rows)

    def expected(i, text):
        found = library.encode_ordinary(text or "")
        return (i, len(found), hashlib.sha256(struct.pack(f"<{len(found)}I", *found)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())

    assert sorted(map(tuple, byte_bpe.digest_documents(docs).collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert byte_bpe.digest_documents(documents([])).count() == 0
    assert {(r.doc_id, tuple(ids(r.ids)), r.decoded) for r in byte_bpe.encode_documents(docs).collect()} == {(i, tuple(library.encode_ordinary(t or "")), t or "") for i, t in rows}


def test_edit_documents(spark, documents, library):
    docs = documents([(1, "Exact appends"), (2, None), (3, "far"), (None, "x")])
    encoded = byte_bpe.encode_documents(docs, prefixes=True)
    edits = spark.createDataFrame([(1, None, None, " and edits"), (1, 0, 5, "Some"), (2, 9, 1, "new"), (3, 1, 99, None), (3, -4, -2, ""), (None, 0, 0, "y"), (8, 0, 0, "z")], "doc_id long, at long, removed long, inserted string")
    got = byte_bpe.edit_documents(encoded, edits).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "Exact appends and edits"), (1, "Some appends"), (2, "new"), (3, "f"), (3, "far")]
    assert all(ids(r.ids) == library.encode_ordinary(r.text) and r.n_tokens == len(ids(r.ids)) for r in got)


def test_op13_query(spark, sf_dir, library):
    from gazeloom.llm.registry import QUERIES

    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        found = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(found), hashlib.sha256(struct.pack(f"<{len(found)}I", *found)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op13_byte_bpe"](spark, sf_dir).collect()} == want
