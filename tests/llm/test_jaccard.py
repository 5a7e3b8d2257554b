import random

import pytest

from lexiloom.llm import jaccard
from lexiloom.llm.jaccard import near_duplicate_classes, one_of_each_class, shingle_sets

from .conftest import AWKWARD


def brute(rows, n, num, den):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and den * common >= num * (len(a) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    members = {}
    for i, (doc_id, _) in enumerate(rows):
        members.setdefault(root(i), []).append(doc_id)
    return {d: (len(sets[i]), min(members[root(i)])) for i, (d, _) in enumerate(rows)}


def generated(count, seed):
    random.seed(seed)
    bases = [" ".join(random.choice("abcdefghij") for _ in range(random.randint(1, 60))) for _ in range(count // 12)]
    rows = []
    for i in range(count):
        words = random.choice(bases).split()
        for _ in range(random.choice((0, 0, 1, 1, 2, 3))):
            words[random.randrange(len(words))] = random.choice("abcdefghijKL")
        rows.append((i, random.choice([" ".join(words)] * 20 + ["", None, " \t", "A b"])))
    return rows


@pytest.mark.parametrize(("words", "num", "den"), [(3, 90, 100), (2, 80, 100)])
def test_components_match_brute_force(make_docs, words, num, den):
    rows = generated(350, words)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_classes(make_docs(rows, extra=True), words, num, den).toArrow().to_pylist()}
    assert got == brute(rows, words, num, den)


def test_a_large_group_of_near_copies_with_a_common_line(make_docs):
    random.seed(4)
    line = "one line that every text has at its start "
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(random.choice((0, 1, 2, 6))):
            words[random.randrange(60)] = f"x{random.randrange(9)}"
        rows.append((i, line + " ".join(words)))
    rows += [(1000 + i, line + " ".join(f"r{i}.{k}" for k in range(40))) for i in range(100)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_classes(make_docs(rows), 3, 90, 100).toArrow().to_pylist()}
    assert got == brute(rows, 3, 90, 100)


def test_awkward_rows_and_the_stage(make_docs):
    docs = make_docs([*AWKWARD, (None, "same text here")], extra=True)
    got = list((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in near_duplicate_classes(docs, 3, 90, 100).toArrow().to_pylist())
    expected = [("1", 0, 1), ("2", 0, 2), ("3", 0, 3), ("4", 1, 4), ("5", 1, 5), ("6", 1, 5), ("6", 1, 5), ("None", 1, 5), ("None", 2, None)]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = one_of_each_class(docs, 3, 90, 100)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "None", "None"]


def test_words_are_split_at_ascii_space_and_only_ascii_is_lowered():
    import pyarrow as pa

    a, b, c, d = shingle_sets(pa.array(["A\x0bB\tÄ", "a b Ä", "a b ä", "a b\xa0Ä"]), 3)
    assert a.tolist() == b.tolist() != c.tolist() and len(d) == 1


def test_members_of_opened_groups_are_not_stored_as_pairs(make_docs, monkeypatch):
    random.seed(11)
    rows = []
    for i in range(112):
        words = [f"w{i % 8}.{k}" for k in range(40)]  # 14 copies of a text each: too few to count as frequent, below the threshold
        for at in random.sample(range(40), 2):
            words[at] = f"own{i}.{at}"
        rows.append((i, " ".join(words)))
    stored, cut = {}, jaccard.cut_lineage

    def spy(df, name):
        out = cut(df, name)
        stored[name] = max(stored.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", spy)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_classes(make_docs(rows), 3, 90, 100).toArrow().to_pylist()}
    assert got == brute(rows, 3, 90, 100)
    assert stored["matrix"] and "opened" not in stored  # a pair is a row only once its common tokens are counted
