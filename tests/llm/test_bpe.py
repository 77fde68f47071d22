"""Byte-level BPE against the tiktoken library, and round trips."""

import hashlib
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from mercato.llm import bpe
from mercato.llm.queries import VOCABULARY, op1_bpe

from .helpers import EDGE_ROWS, SF, documents, edge, empty


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path(VOCABULARY))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks,
                             special_tokens={})


def test_perfect_hash_is_minimal_and_finds_every_token(vocabulary):
    assert sorted(vocabulary.perfect.slots(_hashes(list(vocabulary.ranks)))) == list(range(len(vocabulary.ranks)))


def _hashes(tokens):
    import numpy as np
    data = np.frombuffer(b"".join(tokens), np.uint8)
    length = np.array([len(t) for t in tokens])
    return bpe._hash(bpe._words_of(data), np.cumsum(length) - length, length)


@pytest.mark.parametrize("piece", [bpe.PIECE_BYTES, 64])
def test_ids_equal_the_library_on_odd_texts(vocabulary, library, monkeypatch, piece):
    monkeypatch.setattr(bpe, "PIECE_BYTES", piece)
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\r", "\t", " ", " ", "a",
             "B", "é", "ß", "1", "²", "½", "漢", "😀", "!", "%%", "'S", "\x00", "\x1c", "́", "​",
             "x" * 40, " " * 20, "\n\n", "hello", " world"]
    random.seed(5)
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", " ", "'", "'s", "a" * 3000, " " * 300 + "a", "é" * 500]
    got = bpe.Encoder(vocabulary).encode(pa.array(texts)).to_pylist()
    assert got == [library.encode_ordinary(t or "") for t in texts]
    back = bpe.Encoder(vocabulary).decode(pa.array(got, pa.list_(pa.int32()))).to_pylist()
    assert back == [(t or "").encode() for t in texts]


def test_every_character_class_equals_the_library(vocabulary, library):
    texts = ["".join(f"a{chr(c)}1{chr(c)} " for c in range(k, min(k + 256, 0x110000)) if not 0xD800 <= c < 0xE000)
             for k in range(0, 0x30000, 256)]
    got = bpe.Encoder(vocabulary).encode(pa.array(texts)).to_pylist()
    assert got == [library.encode_ordinary(t) for t in texts]


def test_query_digests(spark, library):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = op1_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edge_cases(spark):
    shared = bpe.broadcast_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    df = bpe.encode(edge(spark).withColumnRenamed("Text_", "Token_IDs"), shared)
    assert [c.lower() for c in df.columns].count("token_ids") == 1
    rows = bpe.decode(df, shared).select("doc_id", "text", "token_ids", "decoded").collect()
    assert len(rows) == len(EDGE_ROWS)
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert (r.token_ids == []) == (not r.text)
    assert bpe.round_trip(empty(spark), shared).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([([60000],)], "token_ids array<int>"), shared).collect()
