import zlib
from collections import Counter

from lexiloom.llm.sharding import Leaf, descend, grow, layout, place

from .conftest import AWKWARD


def test_sizes_slots_and_growth(spark, make_docs):
    rows = place(make_docs([*AWKWARD, *((i, f"text {i}") for i in range(10, 900))], extra=True), layout(24)).toArrow().to_pylist()
    assert len(rows) == len(AWKWARD) + 890
    texts = {**dict(AWKWARD), **{i: f"text {i}" for i in range(10, 900)}}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert r["grown_shard"] in (r["shard"], 24)
    for shard, count in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(count))
    assert sum(r["grown_shard"] == 24 for r in rows) > 10


def test_a_changed_weight_moves_rows_of_that_subtree_only(spark):
    before = layout(24)
    after = [Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in before]
    keys = spark.range(4000).selectExpr("cast(id as string) as key")
    moved = [r for r in keys.select(descend(keys.key, before).alias("a"), descend(keys.key, after).alias("b")).collect() if r.a != r.b]
    home = {x.shard: x for x in before}
    assert moved
    for r in moved:  # into a subtree whose weight grew, at the level where the path changes
        old, new, grown = home[r.a], home[r.b], home[5]
        assert new.region == grown.region
        if old.region == new.region:
            assert new.rack == grown.rack
        if old.rack == new.rack:
            assert r.b == 5


def test_weights_are_shares(spark):
    leaves = [Leaf(0, 0, 0, 1.0), Leaf(0, 0, 1, 3.0), Leaf(1, 1, 2, 0.0)]
    keys = spark.range(6000).selectExpr("cast(id as string) as key")
    counts = Counter(r.s for r in keys.select(descend(keys.key, leaves).alias("s")).collect())
    assert set(counts) == {0, 1} and 0.71 < counts[1] / 6000 < 0.79


def test_empty(make_docs):
    assert place(make_docs([]), layout(24)).count() == 0
    assert max(x.shard for x in grow(layout(24))) == 24
