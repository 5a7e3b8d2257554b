import random

import pytest

from lexiloom.llm.quality import kth_largest, resample

from .conftest import AWKWARD


@pytest.fixture(scope="module")
def corpus():
    random.seed(6)
    words = [f"w{i}" for i in range(2000)]
    rows, labels = [], []
    for i in range(100, 1300):
        text = " ".join(random.choice(words) for _ in range(random.randint(20, 120)))
        kind = "clean"
        if i % 10 == 0:
            text, kind = " | ".join(text.split()) + " !!", "junk"
        elif i % 10 == 1:
            text, kind = text + " awful idiot nonsense", "toxic"
        elif i % 10 == 2 and i % 3 == 0:
            text, kind = "Te " * 50 + text, "junk"
        rows.append((i, text, kind))
        if i % 2 or i % 10 in (0, 2):
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels


def test_clean_documents_stay_and_the_rest_goes(spark, make_docs, corpus):
    rows, labels = corpus
    docs = make_docs([*AWKWARD, *((i, t) for i, t, _ in rows)], extra=True)
    marked = spark.createDataFrame([*labels, (None, 1, 0), (101, None, None)], "doc_id long, quality int, toxic int")
    kept = resample(docs, marked)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns
    clean = {i for i, _, k in rows if k == "clean"}
    assert clean <= ids
    assert len(ids & {i for i, _, k in rows if k != "clean"}) < 0.05 * len(rows)
    assert {i for i, _ in AWKWARD} <= ids


def test_without_labels_all_stay(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resample(make_docs(AWKWARD), none).count() == len(AWKWARD)
    assert resample(make_docs([]), none).count() == 0


@pytest.mark.parametrize("k", [1, 7, 500, 999])
def test_kth_largest_is_exact_with_ties(spark, k):
    random.seed(k)
    values = [random.choice((random.gauss(0, 1), 0.5, -1e9, 1e-12)) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    assert kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_rare_toxic_words_and_marks_count_in_small_tables(spark, make_docs):
    random.seed(9)
    words, abuse = [f"w{i}" for i in range(300)], [f"abuse{i}" for i in range(10)]
    rows, labels, bad = [], [], set()
    for i in range(1000):
        text = [random.choice(words) for _ in range(random.randint(20, 400))]
        if i % 25 in (3, 11):
            text[5:5] = random.sample(abuse, 3)
        elif i % 25 == 7:
            text = [w + "###" for w in text]
        if i % 25 in (3, 11, 7):
            bad.add(i)
        if i % 5 < 2 or i % 50 == 7:
            labels.append((i, int(i % 25 != 7), int(i % 25 in (3, 11))))
        rows.append((i, " ".join(text)))
    # the words are in fewer documents than four standard errors of the raw counts ask for
    assert max(sum(a in t.split() for _, t in rows) for a in abuse) * len([x for x in labels if x[1] and not x[2]]) / 1000 < 17
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in resample(make_docs(rows), marked).select("doc_id").collect()}
    assert len(kept & bad) <= 0.05 * len(bad)
    assert len({i for i, _ in rows} - bad - kept) <= 0.01 * len(rows)
