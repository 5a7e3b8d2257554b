import hashlib
import random
import re

import pytest
import regex
import xxhash

from lexiloom.llm import fingerprint
from lexiloom.llm.fingerprint import LONG_PIECE, LONG_WORD, PIECE_END, WORDS_PER_CUT, fingerprints


def parts(text):
    """The same pieces in plain Python."""
    out = set()
    for piece in re.split(PIECE_END, text):
        if len(piece) <= LONG_PIECE:
            out.add(piece)
            continue
        joined = []
        for word in re.split(r"\s+", piece):
            if len(word) > LONG_PIECE:
                word = regex.sub(LONG_WORD, r"\1\n", word)
            joined.append(word + ("\n" if signed(word) % WORDS_PER_CUT == 0 else ""))
        out.update(re.split(r"\n\s?", " ".join(joined)))
    return out - {""}


def signed(text):
    value = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return value - (1 << 64) if value >= 1 << 63 else value


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1] or "")))
    out = []

    def near(a, b):
        a, b = parts(a), parts(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + following[:quarter]
        out.append((str(doc_id), len(text), hashlib.sha256(changed.encode()).hexdigest(), round(near(text, changed), 9), round(near(text, following), 9)))
    return sorted(out)


def rows_of(count):
    random.seed(count)
    rows = [(None, "no id. x"), (1, None), (2, ""), (3, "é😀. b; c\n\nd"), (3, "é😀. b; c\n\nd"), (4, "one")]
    for i in range(10, 10 + count):
        sentences = [f"s{random.randrange(50)} t{random.randrange(9)}." for _ in range(random.choice((1, 5, 40, 300)))]
        rows.append((i * 7, random.choice((" ", "\n")).join(sentences)))
    rows += [(9000, " ".join(f"w{random.randrange(10**6)}" for _ in range(3000))), (9001, "".join(random.choices("abcdefghij", k=30_000))), (9002, "".join(map(chr, random.choices(range(0x4E00, 0x9000), k=9000))))]
    return rows + [(5000, f"one id. text {i}") for i in range(60)] + [(None, f"no id either {i}") for i in range(50)]


@pytest.mark.parametrize("cells", [8, 1])
def test_likeness_matches_sets(make_docs, monkeypatch, cells):
    monkeypatch.setattr(fingerprint, "FIRST_CELLS", cells)  # with one cell a table nearly every pair must be tried again
    rows = rows_of(40)
    got = fingerprints(make_docs(rows, extra=True)).toArrow().to_pylist()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == brute(rows)
    assert {r["doc_id"] for r in got if r["near_edited"] > 0.4} >= {9001, 9002} and all(r["near_edited"] > 0.3 for r in got if r["doc_id"] == 9000)
    by_text, once = {}, {str(i): t for i, t in rows if [x for x, _ in rows].count(i) == 1}
    for r in got:
        if str(r["doc_id"]) in once:
            by_text.setdefault(once[str(r["doc_id"])], set()).add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_one_row_and_none(make_docs):
    (row,) = fingerprints(make_docs([(7, "a. b. c. d")])).collect()
    assert row.near_next == 1.0
    assert fingerprints(make_docs([])).count() == 0


def test_sketches_are_not_stored(make_docs, monkeypatch):
    stored, cut = {}, fingerprint.cut_lineage

    def spy(df, name):
        stored.setdefault(name, dict(df.dtypes))
        return cut(df, name)

    monkeypatch.setattr(fingerprint, "cut_lineage", spy)
    fingerprints(make_docs(rows_of(5))).collect()
    assert not {"fingerprint", "edited_fingerprint"} & set(stored["versions"]) and not any("struct" in kind for kind in stored["versions"].values())
    assert set(stored["stuck"]) == {"id", "side"}  # what is tried again travels as numbers
