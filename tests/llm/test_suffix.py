import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm.suffix import LENGTH, common_prefix, deep_shallow, repeated_substrings

from .conftest import AWKWARD


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=40).map(str.encode), min_size=1, max_size=14))
def test_deep_shallow_sorts(strings):
    order, prefixes = deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings)
    assert prefixes[1:] == [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def brute(rows):
    count = {}
    for _, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - LENGTH + 1):
            count[raw[i : i + LENGTH]] = count.get(raw[i : i + LENGTH], 0) + 1
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - LENGTH + 1):
            if count[raw[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(doc_id), len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def rows_with_passages():
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    passages = [" ".join(random.choice(words) for _ in range(random.randint(40, 120))) for _ in range(4)]
    rows = [*AWKWARD, (-3, "Te " * 900), (-4, "x" * 199), (-5, "x" * 199), (-6, "y" * 200), (-7, "y" * 200), (-8, "ab Te Te " + "Te " * 100 + "zz")]
    for i in range(100, 170):
        text = " ".join(random.choice(words) for _ in range(random.randint(5, 120)))
        chance, last = random.random(), rows[-1][1]
        if chance < 0.4:
            text += " " + random.choice(passages)[random.randint(0, 50) :] + " " + text[: random.randint(0, 300)]
        elif chance < 0.5:
            text = last
        elif chance < 0.7:
            cut = random.randint(0, len(last))
            text = last[:cut] + "é" + last[cut + 1 :]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_removed_bytes_match_brute_force(make_docs, hot):
    rows = rows_with_passages()
    got = repeated_substrings(make_docs(rows, extra=True), hot=hot).toArrow().to_pylist()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute(rows)


def test_empty(make_docs):
    assert repeated_substrings(make_docs([])).count() == 0
