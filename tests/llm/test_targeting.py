import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lexiloom.llm import targeting
from lexiloom.llm.targeting import InternTable, Plan, Slices, resampled, xxh64

from .conftest import AWKWARD


def features(text, plan):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(words[i : i + n]) for n in range(plan.least, plan.most + 1) for i in range(len(words) - n + 1)]
    return len(words), runs


def brute(docs, target, plan):
    def bucket(f):
        return zlib.crc32(f.encode()) % plan.buckets

    s = Counter(bucket(f) for _, t in docs for f in features(t, plan)[1])
    t = Counter(bucket(f) for _, x in target for f in features(x, plan)[1])
    s_all, t_all = sum(s.values()) + plan.buckets, sum(t.values()) + plan.buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in set(s) | set(t)}
    rows = []
    for i, text in docs:
        n_words, held = features(text, plan)
        weight = math.floor(sum(gain[bucket(f)] for f in held) / len(held)) if held else 0
        h = int(hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, n_words, len(held), weight, score))
    order = sorted((r for r in rows if r[1] >= plan.min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = order[: len(order) * plan.percent // 100]
    ranks = {}
    for place, r in enumerate(drawn, 1):
        ranks.setdefault(r, []).append(place)
    return Counter((*r, (ranks.get(r) or [None]).pop(0) if ranks.get(r) else None) for r in rows)


def sample(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "ÄRGER", "日本語", "x" * 40, "y" * 31 + "Z", "é\x00q"]
    return [(i, rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(100, 100 + n)]


def result(spark, make_docs, docs, target, plan, **how):
    found = resampled(make_docs(docs, **how), make_docs(target), plan).toArrow().to_pylist()
    return Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in found)


@pytest.mark.parametrize("plan", [Plan(buckets=50, percent=30), Plan(1, 3, 97, 5, 50), Plan(2, 2, 1000, 0, 100)])
def test_same_as_brute_force(spark, make_docs, plan):
    docs, target = [*AWKWARD, *sample(150), (7, "same twenty words " * 10), (7, "same twenty words " * 10)], sample(12, 2)
    assert result(spark, make_docs, docs, target, plan, extra=True) == brute(docs, target, plan)


def test_long_texts_in_parts(spark, make_docs, monkeypatch):
    docs = [*sample(20), (1, "one Long text of many words, " * 300), (2, "w" * 700 + " ab " + "é" * 500), (3, " , " * 400 + "end")]
    plan = Plan(1, 3, 97, 5, 50)
    cut = {}
    for size in (64, 1 << 18):
        monkeypatch.setattr(targeting, "CHUNK", size)
        import pyarrow as pa

        texts = pa.array([t for _, t in docs], pa.string())
        total, of_text = np.zeros(97, np.int64), Counter()
        for group in targeting._parts(texts, 2):
            slices, owner, _ = targeting._features(group, plan)
            of_text.update(owner.tolist())
            if len(owner):
                total += InternTable(slices, 97).totals(97)
        cut[size] = (total.tolist(), of_text)
        assert of_text == Counter({i: len(features(t, plan)[1]) for i, (_, t) in enumerate(docs) if features(t, plan)[1]})
    assert cut[64] == cut[1 << 18]


def test_many_equal_scores_and_a_third_without_id(spark, make_docs):
    docs = [(None, "the very same text of some words here")] * 60 + [(5, "another text with a few words")] * 40 + sample(50)
    plan = Plan(buckets=50, min_words=3, percent=60)
    assert result(spark, make_docs, docs, sample(5, 3), plan, parts=7) == brute(docs, sample(5, 3), plan)


def test_empty_tables(spark, make_docs):
    assert resampled(make_docs([]), make_docs(sample(3)), Plan()).count() == 0
    docs = sample(40)
    assert result(spark, make_docs, docs, [], Plan()) == brute(docs, [], Plan())


def test_hashes_and_byte_verification(monkeypatch):
    words = [b"a" * n + bytes([n]) for n in range(60)] * 3 + [b"", b"abcdefgh", b"abcdefgi", b"abcdefgh"]
    start = np.cumsum([0, *map(len, words)])[:-1]
    slices = Slices(np.frombuffer(b"".join(words), np.uint8), start, np.array(list(map(len, words))))
    assert xxh64(slices).tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    for clash in (False, True):
        if clash:  # all keys equal: only the bytes tell features apart
            monkeypatch.setattr(targeting, "xxh64", lambda s: np.zeros(len(s.start), np.uint64))
        table = InternTable(slices, 1000)
        assert {words[table.owner[s]] for s in table.filled} == set(words) and len(table.filled) == len(set(words))
        assert [words[table.owner[s]] for s in table.slot_of] == words
        assert {words[table.owner[s]]: table.count[s] for s in table.filled} == Counter(words)
