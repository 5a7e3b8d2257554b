import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from lexiloom.llm.decontam import agreement, clean, leaks, masks_of, words_of

from .conftest import AWKWARD


@pytest.fixture(scope="module")
def case():
    random.seed(8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(random.choice(words) for _ in range(random.randint(15, 50)))) for i in range(20)]
    items += [(50, "five words are just enough"), (51, "too short"), (52, None), (53, items[0][1]), (54, "Paris is lovely"), (55, "zebrafish"), (56, "..."),
              (57, "one two three four")]
    docs = list(AWKWARD)
    for i in range(100, 200):
        text = " ".join(random.choice(words) for _ in range(random.randint(5, 150)))
        kind = i % 5
        if kind == 0:
            text = text[:200] + " " + items[i % 20][1].upper() + ", " + text[200:]
        elif kind == 1:  # every eighth word replaced
            text += " " + " ".join("zz" if k % 8 == 7 else w for k, w in enumerate(items[i % 20][1].split()))
        elif kind == 2:  # every other word replaced: no passage any more
            text += " " + " ".join("zz" if k % 2 else w for k, w in enumerate(items[i % 20][1].split()))
        elif i % 10 == 3:
            text += " Five words ARE just enough!"
        elif i % 10 == 4:
            text += (" paris, is LOVELY. ", " paris is not lovely", " a zebrafish", " one two three for", " one two three four")[i // 10 % 5]
        docs.append((i, text))
    return items, docs


def brute(docs, items):
    out = set()
    for doc_id, text in docs:
        doc = words_of(text or "")
        for _, item in items:
            own = words_of(item or "")
            if any(agreement(doc, own, s) >= 0.8 for s in range(-len(own) + 1, len(doc))):
                out.add(doc_id)
    return out


def test_leaks_match_brute_force(spark, make_docs, case):
    items, docs = case
    table = spark.createDataFrame(items, "item_id long, text string")
    kept = clean(make_docs(docs, extra=True), table)
    bad = brute(docs, items)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - bad
    assert kept.columns == make_docs([], extra=True).columns
    assert {d for d, _ in docs if d and d >= 100 and d % 5 in (0, 1)} <= bad


def test_item_ids_and_agreement_match_brute_force(spark, make_docs, case):
    """What the query returns, by sums of equal words written out here."""
    items, docs = case
    docs = [(d, t) for d, t in docs if d is not None]
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()

    def best(doc, own):
        n = min(len(own), 20)
        found = [0.0]
        for shift in range(-len(own) + 1, len(doc)):
            same = [0 <= k + shift < len(doc) and doc[k + shift] == w for k, w in enumerate(own)]
            found += [sum(same[a : a + n]) / n for a in range(len(own) - n + 1)]
        return max(found)

    plain = lambda text: re.findall(r"\w+", (text or "").lower())
    want = {}
    for _, text in docs[:70]:
        for _, item in items:
            if plain(item) and (share := best(plain(text), plain(item))) >= 0.8:
                want[md5(text or ""), md5(item or "")] = round(share, 9)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.digest, r.item): round(r.agreement, 9) for r in leaks(make_docs(docs[:70]), table).collect()}
    assert got == want and len(want) > 10


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert clean(make_docs(AWKWARD), none).count() == len(AWKWARD)
    assert leaks(make_docs([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_agreement_counts_words_outside_as_unequal():
    assert agreement(np.array([1, 2], np.uint64), np.array([1, 2, 3, 4], np.uint64), 0) == 0.5
    assert agreement(np.array([], np.uint64), np.array([], np.uint64), 0) == 0.0


@pytest.mark.parametrize("n", range(5, 21))
def test_masks_hit_every_arrangement_of_the_law(n):
    least = -(-4 * n // 5)
    shifts = [sum(1 << (s + i) for i, c in enumerate(m) if c == "1") for m in masks_of(n) for s in range(n - len(m) + 1)]
    missed = [x for x in itertools.combinations(range(n), n - least) if all(sum(1 << i for i in x) & s for s in shifts)]
    assert not missed


def test_substitutions_at_steps_of_five_and_six(spark, make_docs):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (*range(5, 21), 31, 59)]
    docs = []
    for n, text in items:
        for step in (5, 6):
            for phase in range(step):
                words = ["zz" if k % step == phase else w for k, w in enumerate(text.split())]
                docs.append((len(docs), "some words before " + " ".join(words) + " and after"))
    bad = brute(docs, items)
    kept = clean(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - bad
    assert {d for d, t in docs if "i31x1" in t or "i59x1" in t} <= bad
