import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from lexiloom.llm import token_links
from lexiloom.llm.token_links import Tokenizers, align, aligned, linked, loaded, lockstep, with_counts

from .conftest import AWKWARD

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@lru_cache
def plain():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def tokens(text):
    """[(id, bytes)] of both, or nothing where the bytes are not those of space + text."""
    a, b = plain()
    if not text:
        return [], []
    alphabet = {}
    n = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            alphabet[chr(byte)] = byte
        else:
            alphabet[chr(256 + n)] = byte
            n += 1
    first = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (first, second) if all(b"".join(x for _, x in s) == raw for s in (first, second)) else ([], [])


def spans(side):
    at, out = 0, []
    for i, raw in side:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(docs):
    per_doc, holds = [], Counter()
    for i, text in docs:
        a, b = map(spans, tokens(text))
        links = [(x, y) for x, xs, xe in a for y, ys, ye in b if xs < ye and ys < xe]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(t) for t, s, e in side if low <= s and e <= c) for side in (a, b)))
            low = c
        per_doc.append((i, len(a), len(b), groups, links))
        holds.update(set(links))
    best = defaultdict(int)
    for (a, _), n in holds.items():
        best[a] = max(best[a], n)
    return Counter(
        (i, n_a, n_b, len(g), len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "")
        for i, n_a, n_b, g, links in per_doc
    )


def sample(n):
    rng = random.Random(5)
    words = ["the", "Straße", "naïve", "日本語", "don't", "12,345", "tokenization", "<|endoftext|>", "</s>", "\n\n", "x" * 30, "🙂", "é", "ﬁ", "▁", "\t", "антиконституционно"]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(100, 100 + n)]


def rows(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.toArrow().to_pylist())


@pytest.mark.parametrize("hot", [0, 40, 1 << 17])
def test_same_as_brute_force(spark, make_docs, hot):
    docs = [*AWKWARD, *sample(60), (8, "  two  spaces "), (9, "\x00nul \x01"), (10, "word " * 400)]
    found = with_counts(linked(make_docs(docs, extra=True), Tokenizers.public()), hot)
    assert rows(found) == brute(docs)


def test_parts_of_long_texts_give_the_same(spark, make_docs, monkeypatch):
    rng = random.Random(3)
    words = ["alpha", "Beta9", "déjà", "a", "I'm", "(so)", "\n", "", "re-entry", "x2", "日本", "Zurück,"]
    docs = [(i, " ".join(rng.choices(words, k=300))) for i in range(12)] + [(50, "z" * 3000), (51, "a b " * 700)]
    expected = brute(docs)
    pair = loaded(Tokenizers.public())
    assert pair.cuts
    for lane, group in ((8, 100), (64, 1 << 20), (1 << 20, 1 << 20)):
        monkeypatch.setattr(token_links, "LANE", lane)
        monkeypatch.setattr(token_links, "GROUP", group)
        found = align([t for _, t in docs], pair)
        assert [(x.n_a, x.n_b, x.n_groups, x.n_links, x.digest.hexdigest()) for x in found] == [(r[1], r[2], r[3], r[4], r[7]) for r in sorted(expected, key=lambda r: r[0])]


def test_lockstep_steps_all_lanes_at_once():
    a_end, b_end = np.array([2, 5, 6, 1, 4]), np.array([5, 6, 2, 3, 4])
    a, b, cut = lockstep(a_end, b_end, np.array([0, 3]), np.array([0, 2]), np.array([3, 5]))
    assert sorted(zip(a.tolist(), b.tolist(), cut.tolist(), strict=True)) == [(0, 0, False), (1, 0, True), (2, 1, True), (3, 2, False), (4, 2, False), (4, 3, False), (4, 4, True)]


def test_empty(spark, make_docs):
    assert aligned(make_docs([])).count() == 0
    assert rows(aligned(make_docs([(1, None), (2, "")]))) == brute([(1, None), (2, "")])


def test_a_hot_text_and_a_wide_one(spark, make_docs):
    docs = [(i, "the same text for a third of all") for i in range(40)] + sample(20)
    assert rows(aligned(make_docs(docs, parts=5))) == brute(docs)


def test_encoder_by_ranks_gives_the_ids_of_the_file():
    points = [c for c in (*range(0x3000), *range(0x3000, 0x110000, 37)) if not 0xD800 <= c <= 0xDFFF]
    texts = [f" a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)}  {chr(c)}{chr(c)} x" for c in points] + [" " + t for _, t in sample(50)]
    assert loaded(Tokenizers.public()).encode_a(texts) == [x.ids for x in plain()[0].encode_batch(texts, add_special_tokens=False)]
