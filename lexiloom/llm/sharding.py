"""Sharding by a hierarchical weighted hash tree.

Every row descends region -> rack -> shard.  At each level each child of the node reached draws ``-ln(u) / weight`` with ``u`` a
hash of (child, key), and the smallest draw wins; a child wins in proportion to its weight, and the draws of its siblings do not
change when its own weight does.  So a changed weight moves rows only into or out of the subtree whose weight changed, and a shard
added as a subtree of its own (``grow``) takes rows only into itself.

Edge cases: a null key is one key of its own; a null text has no bytes; repeated rows share a shard and take consecutive slots; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import query, table

ROW_OVERHEAD = 8
BLOCK_DIGITS = 2  # hex digits: 256 blocks per shard are numbered side by side


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, shards_per_rack: int = 4, racks_per_region: int = 3) -> list[Leaf]:
    """Equal shards in full racks and regions; rack numbers are unique over the tree."""
    return [Leaf(s // (shards_per_rack * racks_per_region), s // shards_per_rack, s) for s in range(shards)]


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, as a region of its own: no other subtree's weight changes."""
    return [*leaves, Leaf(*(max(getattr(x, n) for x in leaves) + 1 for n in ("region", "rack", "shard")), weight)]


def levels(leaves: list[Leaf]) -> list[dict[int, dict[int, float]]]:
    """Per level: parent -> child -> weight of the child's subtree.  Subtrees without weight take nothing and are left out."""
    if any(x.weight < 0 for x in leaves) or not any(x.weight for x in leaves):
        raise ValueError("weights must not be negative, and one must be positive")
    found: list[dict[int, dict[int, float]]] = [{}, {}, {}]
    for leaf in leaves:
        for level, (parent, child) in enumerate(((0, leaf.region), (leaf.region, leaf.rack), (leaf.rack, leaf.shard))):
            if leaf.weight:
                kids = found[level].setdefault(parent, {})
                kids[child] = kids.get(child, 0.0) + leaf.weight
    return found


def _draw(level: int, node: Column, weight: Column, key: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(level)), node.cast("string"), key))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.ln(uniform) / weight


def _winner(level: int, kids: Column, key: Column) -> Column:
    draws = F.transform(kids, lambda c: F.struct(_draw(level, c["node"], c["weight"], key).alias("draw"), c["node"].alias("node")))
    return F.array_min(draws)["node"]


def descend(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a string key."""
    node = F.lit(0)
    for level, parents in enumerate(levels(leaves)):
        entries = [
            x
            for parent, kids in sorted(parents.items())
            for x in (F.lit(parent), F.array(*(F.struct(F.lit(k).alias("node"), F.lit(w).alias("weight")) for k, w in sorted(kids.items()))))
        ]
        kids = F.element_at(F.create_map(*entries), node)
        node = _winner(level, kids, key)
    return node


def place(docs: DataFrame, leaves: list[Leaf], block_digits: int = BLOCK_DIGITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack.

    Slots are numbered in blocks of each shard by a hash of the row: the blocks are counted first, which shuffles partial counts,
    and rows are numbered within their block, so no task holds a whole shard.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    homes = {x.shard: x for x in leaves}
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        descend(key, leaves).alias("shard"),
        descend(key, grow(leaves)).alias("grown_shard"),
        key.alias("key"),
    ).withColumn("block", F.substring(F.md5(F.concat_ws(":", "key", F.col("text_crc32").cast("string"))), 1, block_digits))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    home = F.create_map(*(v for s, x in homes.items() for v in (F.lit(s), F.struct(F.lit(x.region).alias("region"), F.lit(x.rack).alias("rack")))))
    return (
        rows.withColumn("within", F.row_number().over(within) - 1)
        .join(starts, ["shard", "block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("within")).alias("slot"),
            "grown_shard",
            F.element_at(home, F.col("shard"))["region"].alias("region"),
            F.element_at(home, F.col("shard"))["rack"].alias("rack"),
        )
    )


SHARDS = 24


def _tree_sql(name: str, leaves: list[Leaf], source: str) -> str:
    """CTEs that descend the levels one by one."""
    parts, parent = [], "0"
    for level, parents in enumerate(levels(leaves)):
        values = ", ".join(f"({p}, {k}, {w!r}::DOUBLE)" for p, kids in parents.items() for k, w in kids.items())
        draw = f"-ln((('0x' || substr(md5(concat_ws(':', '{level}', t.node::VARCHAR, k.key)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / t.weight"
        previous = source if level == 0 else f"{name}{level - 1}"
        parts.append(
            f"{name}{level} AS (SELECT k.key, arg_min(t.node, {draw}) AS node FROM (SELECT key, {parent} AS parent FROM {previous}) k "
            f"JOIN (VALUES {values}) t(parent, node, weight) USING (parent) GROUP BY k.key)"
        )
        parent = "node"
    return ", ".join(parts)


_LEAVES = layout(SHARDS)
OP1_SQL = f"""
WITH byte_crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), docs AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, coalesce(octet_length(encode(text)), 0) + 8 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32
  FROM documents, byte_crc
), keys AS (SELECT DISTINCT key FROM docs),
{_tree_sql("own", _LEAVES, "keys")}, {_tree_sql("grown", grow(_LEAVES), "keys")}
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, own2.node AS shard,
  row_number() OVER (PARTITION BY own2.node ORDER BY substr(md5(concat_ws(':', key, text_crc32::VARCHAR)), 1, {BLOCK_DIGITS}), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown2.node AS grown_shard, own2.node // 12 AS region, own2.node // 4 AS rack
FROM docs JOIN own2 USING (key) JOIN grown2 USING (key)
"""


@query("op1_hash_tree_sharding", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), layout(SHARDS))
