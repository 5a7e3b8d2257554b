import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import neighbour_graph
from lexiloom.llm.neighbour_graph import Settings, build, entries, nearest, search, usable

SCHEMA = "vec_id long, embedding array<float>, label int, node string, query string"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, every, k):
    """query_id -> [(vec_id, score)], with every candidate that ties with the last."""
    good = [(i, tuple(np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in good]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    good = sorted({(i, v) for i, v in good if len(v) == size})
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted(((-float(np.dot(q, v)), j) for j, v in good if j != i))
            out.setdefault(i, []).append([(j, -s) for s, j in near[:k]])
    return out


def found(df):
    out = {}
    for r in sorted(df.toArrow().to_pylist(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return out


def recall(got, expected):
    hits = total = 0
    for q, lists in expected.items():
        hits += len({j for j, *_ in got.get(q, [])} & {j for j, _ in lists[0]})
        total += len(lists[0])
    return hits / total


def vectors(n, dim, seed=0, centres=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    if centres:
        x = x * 0.3 + rng.standard_normal((centres, dim))[rng.integers(0, centres, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, x[i].astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows", [vectors(1500, 24), vectors(1500, 16, 1, 12)])
def test_recall_order_and_scores(spark, rows):
    how = Settings(degree=24, bucket=100, first=12, beam=160, expand=16)
    got, expected = found(nearest(frame(spark, rows), 20, 20, how)), brute(rows, 20, 20)
    assert set(got) == set(expected) and recall(got, expected) >= 0.95
    known = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, near in got.items():
        assert [r for *_, r in near] == list(range(1, 21))
        assert [(j, -s) for j, s, _ in near] == sorted(((j, -s) for j, s, _ in near), key=lambda x: (x[1], x[0]))
        for j, s, _ in near:
            assert s == pytest.approx(float(known[q] @ known[j]), abs=1e-12)


def test_awkward_rows_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbour_graph, "SMALL_CLASS", 30)  # thin the class of copies in salted groups
    rows = vectors(80, 4, 3) + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1000, 1150)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (20_000, None), (20_020, []), (20_040, [0.0] * 4), (20_060, [1.0, None, 1.0, 1.0]), (20_080, [1.0, float("nan"), 1.0, 1.0])]
    rows += [(20_100, [float("inf"), 1.0, 1.0, 1.0]), (20_120, [1.0] * 5), (40, rows[40][1]), (-20, [0.5, 0.5, 0.0, 0.0])]
    got, expected = found(nearest(frame(spark, rows), 20, 20)), brute(rows, 20, 20)
    assert set(got) == set(expected)
    for q, near in got.items():
        assert [j for j, *_ in near] == [j for j, _ in expected[q][0]], q


def test_norms_of_many_sizes(spark):
    rows = [(i, (np.array(v) * (1 + i % 7)).tolist()) for i, v in vectors(900, 12, 5)]
    assert recall(found(nearest(frame(spark, rows), 20, 20, Settings(bucket=100))), brute(rows, 20, 20)) >= 0.95


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_rows(spark, n):
    rows = vectors(n, 3)
    got, expected = found(nearest(frame(spark, rows), 1, 20)), brute(rows, 1, 20)
    assert {q: [j for j, *_ in near] for q, near in got.items()} == {q: [j for j, _ in x[0]] for q, x in expected.items() if x[0]}


def test_queries_from_outside(spark):
    rows, outside = vectors(1200, 16, 7), vectors(40, 16, 8)
    how = Settings(degree=24, bucket=100, first=12, beam=160, expand=16, entries=50)
    index = build(usable(frame(spark, rows), "vec_id", "embedding"), 11, how)
    queries = entries(index, spark.createDataFrame(outside, "query long, vec array<double>"), how)
    nodes = {r["node"]: r["ids"][0] for r in index.nodes.select("node", "ids").collect()}
    got = {r["query"]: {nodes[x] for x in r["beam"][:10]} for r in search(index, queries, how).collect()}
    index.drop()
    known = np.array([v for _, v in rows])
    hits = sum(len(got[q] & set(np.argsort(-(known @ np.array(v)))[:10].tolist())) for q, v in outside)
    assert hits / 400 >= 0.95
    assert not spark.catalog.tableExists(index.name)


def test_batches_are_opened_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(600))], names=["m"])
    cut = list(neighbour_graph._cut(iter([batch, batch.slice(0, 0)])))
    assert [len(c) for c in cut] == [256, 256, 88] and [v for c in cut for v in c.column(0).to_pylist()] == list(range(600))
