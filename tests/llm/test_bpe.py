import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from quern.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def packed(plain, text):
    return np.array(plain.encode_ordinary(text or ""), "<u4").tobytes()


def test_query_against_tiktoken(spark, sf, plain):
    rows = {r.doc_id: r for r in bpe.op8_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = packed(plain, d.text)
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_random_texts(own, plain):
    rng = random.Random(1)
    letters = "  \n\t\u00a0\u2009\x1c\x85\u3000aAbz'sté中é\U0001f642\U0001f3fd1٣.,!\u0301\u200b\ufeff\x00the and ing"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert own.encode(text) == packed(plain, text)


def test_other_vocabulary(plain):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Tokenizer(bpe.read_ranks(path), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    own.transducer.max_states, own.transducer.pairs.limit = 100, 50
    for text in ("Der Fluß fließt über Öl", "año niño 中文字符 работа", "xqzjkv" * 50, "    \n\n  x"):
        assert own.encode(text) == packed(plain, text)


def test_stream_decoder_never_cuts_a_character(own):
    text = "añ中\U0001f642x" * 20
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    stream = bpe.StreamDecoder(own)
    parts = [stream.feed([i]) for i in ids]
    assert "".join(parts) + stream.finish() == text and not any("\ufffd" in p for p in parts)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (2, "", 2), (2, "", 2), (3, "x" * 300_000, 3), (4, "a b " * 100_000, 4)], "doc_id long, text string, n_tokens int")
    made = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    rows = bpe.decode(made, PATH, public_tokenizers.PATTERN).collect()
    assert [r.decoded for r in rows] == [r.text or "" for r in rows] and len(rows) == 5
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_pieces_settle_in_windows(plain):
    rng = random.Random(3)
    own = bpe.Transducer(bpe.read_ranks(PATH), window=200)
    for letters in ("a", "ab", "xqzjkv", "theandingio", "\u00e9\u4e2d"):
        piece = "".join(rng.choice(letters) for _ in range(3000))
        assert own.encode(piece.encode()) == plain.encode_ordinary(piece)


def test_patterns_that_may_not_be_cut_at_spaces():
    for pattern in (r"\w+ \w+|[\s\S]", r" +|[^ ]+", r"[\s\S]{1,3}"):
        own = bpe.Tokenizer(bpe.read_ranks(PATH), pattern)
        plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
        for text in ("one two three  four", " a\n b", "", "caf\u00e9 au lait " * 30):
            assert own.encode(text) == packed(plain, text)


def test_tokens_that_no_merge_makes():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"xyz": 257, b"q" * 100: 258}
    own = bpe.Tokenizer(ranks, r"\S+|\s+")
    plain = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("xyz xyzab ab xyz abc", "q" * 100 + " " + "q" * 101, "xyz"):
        assert own.encode(text) == packed(plain, text)


def test_batches_of_texts_with_nulls(own, plain):
    texts = ["a  b", None, "", " x y", "z\n \n c", None, "word " * 50, "a  b"]
    got = own.encode_all(pa.array(["skipped", *texts], pa.string())[1:]).to_pylist()
    assert got == [packed(plain, t) for t in texts]


def test_decoding_in_any_stride(own):
    rng = random.Random(5)
    texts = ["a\u00f1\u4e2d\U0001f642x" * 9, "", "plain text", "\U0001f642" * 30]
    for stride in (1, 2, 3, 7, 256):
        for text, stream in zip(texts, bpe.streams(own, own.encode_all(pa.array(texts)), stride)):
            parts = list(stream)
            assert b"".join(parts) == text.encode()
            assert "".join(p.decode() for p in parts) == text
    for _ in range(300):  # malformed bytes: what is decoded bit by bit is what is decoded at once
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(12))
        ids = [own.transducer.ranks[data[i : i + 1]] for i in range(12)]
        stream = bpe.StreamDecoder(own)
        assert "".join(stream.feed([i]) for i in ids) + stream.finish() == data.decode("utf-8", "replace")
