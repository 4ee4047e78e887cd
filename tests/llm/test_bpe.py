"""BPE equals the tiktoken library, piece by piece and over awkward texts."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from seatplan.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(4)
    alphabets = ["ab", "theand ing", " \t\n\r\x0b\x0c\x1c\x85\xa0", "0123456789.,!?'s", "éèüßñ", "中文字", "🙂👍🏽", "क़꟎՘a1 "]
    out = ["", " ", "   ", "\n\n  x", "don't I'll they've", "<|endoftext|>", "a" * 3000, " " * 5000, "ab" * 2500, "\x00\x01"]
    for a in alphabets + ["".join(alphabets)]:
        out += ["".join(rnd.choice(a) for _ in range(rnd.randrange(1, 400))) for _ in range(12)]
    out.append("".join(chr(c) for c in range(0x20, 0x3000)))
    out.append("".join(chr(rnd.choice([rnd.randrange(0x20, 0xD800), rnd.randrange(0xE000, 0x32000)])) for _ in range(4000)))
    return out


def test_ids_equal_the_library(vocabulary, theirs):
    encoder = vocabulary.encoder()
    for text, ids in zip(texts(), encoder.encode_all(texts())):
        assert ids.tolist() == theirs.encode_ordinary(text), text[:50]
        assert encoder.decode(ids) == text.encode()


def long_pieces():
    """Pieces without a break, of which some repeat for long and some hardly do."""
    rnd = random.Random(9)
    letters = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    out = [letters("abcdefghijklmnopqrstuvwxyz", 20000), letters("ABCDEFabcdef", 9000), "a" * 30000, "abc" * 7000,
           letters("the", 6000), letters("中文字漢語", 5000), "é" * 4000]
    return out + [letters("etaoin", 3000) + "z" * 7000 + letters("etaoin", 3000) + "xyzzy" * 900]


def test_long_pieces_equal_the_library(vocabulary, theirs):
    encoder = vocabulary.encoder()
    for text, ids in zip(long_pieces(), encoder.encode_all(long_pieces())):
        assert ids.tolist() == theirs.encode_ordinary(text), text[:20]


def test_blocks_are_joined_exactly(theirs, monkeypatch):
    """Tiny blocks, so that tokens often differ at their ends."""
    encoder = bpe.Encoder(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    for long, block, overlap in ((10, 8, 8), (30, 20, 5), (60, 40, 30)):
        for name, v in (("LONG", long), ("BLOCK", block), ("OVERLAP", overlap)):
            monkeypatch.setattr(bpe, name, v)
        encoder.pieces.clear()
        for text, ids in zip(texts(), encoder.encode_all(texts())):
            assert ids.tolist() == theirs.encode_ordinary(text), (long, text[:50])


def test_time_follows_the_length_of_a_piece(vocabulary):
    """Ten times the letters take about ten times as long, not a hundred times."""
    import time
    rnd = random.Random(10)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    encoder, took = vocabulary.encoder(), []
    for n in (4_000, 40_000, 400_000):
        start = time.perf_counter()
        encoder.merge([text[:n].encode()])
        took.append(time.perf_counter() - start)
    assert took[2] < 40 * max(took[1], 0.05)


def test_forgetting_pieces_changes_nothing(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe, "CELLS", 64)
    encoder = bpe.Encoder(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    for text, ids in zip(texts(), encoder.encode_all(texts())):
        assert ids.tolist() == theirs.encode_ordinary(text)


def test_pairs_are_found_in_a_full_table():
    pairs = {(a, b): a * 31 + b for a in range(40) for b in range(40) if (a + b) % 3}
    table = bpe.PairTable(pairs)
    a, b = np.divmod(np.arange(1600), 40)
    want = [pairs.get((x, y), int(bpe._NONE)) for x, y in zip(a.tolist(), b.tolist())]
    assert table.rank(a, b).tolist() == want


def test_documents(spark, docs, vocabulary, theirs):
    given = ["one two", None, "", "one two", "Ünïcode 🙂 " * 300]
    table = docs(given)
    got = {r.doc_id: r for r in bpe.round_trip(table, vocabulary).collect()}
    for i, t in enumerate(given):
        ids = theirs.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(table, vocabulary), vocabulary)
    assert {r.doc_id: bytes(r.bytes).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(given)}
    assert bpe.round_trip(table.limit(0), vocabulary).count() == 0
