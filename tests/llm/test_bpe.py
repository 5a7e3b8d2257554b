import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm.bpe import MinimalPerfectHash, digests, encode, public_vocabulary

from .conftest import AWKWARD


@pytest.fixture(scope="module")
def vocabulary():
    return public_vocabulary()


@pytest.fixture(scope="module")
def library():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_tells_strangers():
    entries = {f"key{i}".encode(): i for i in range(3000)}
    table = MinimalPerfectHash(entries)
    assert len(table.keys) == 3000 and all(table.get(k) == v for k, v in entries.items())
    assert table.get(b"other") == -1


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_merges_match_the_library(piece):
    vocabulary = public_vocabulary()
    lines = test_merges_match_the_library.__dict__.setdefault("encoding", None)
    if lines is None:
        ranks = {t: r for r, t in enumerate(vocabulary.tokens) if t}
        lines = test_merges_match_the_library.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert vocabulary.encode_piece(piece) == lines._encode_single_piece(piece)


def test_whole_texts(spark, make_docs, vocabulary, library):
    random.seed(2)
    wild = "".join(chr(random.choice((random.randint(32, 126), random.randint(0xA0, 0xD7FF), 0x1F600))) for _ in range(3000))
    texts = ["a" * 5000, " " * 300 + "x", "it's\r\n\t  9 ", wild, "word " * 60_000, "b" * 1_200_000 + " tail"]
    rows = [*AWKWARD[:5], *((100 + i, t) for i, t in enumerate(texts))]
    got = {r["doc_id"]: r for r in digests(encode(make_docs(rows, extra=True), vocabulary, decoded=True)).toArrow().to_pylist()}
    for i, text in rows:
        ids = library.encode_ordinary(text or "") if len(text or "") < 400_000 else [t for m in public_pieces(text) for t in library._encode_single_piece(m)]
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def public_pieces(text):
    import regex

    return [m.encode() for m in regex.findall(public_tokenizers.PATTERN, text)]


def test_empty(make_docs, vocabulary):
    assert encode(make_docs([]), vocabulary).count() == 0
