"""Exact Jaccard self-join of word n-gram sets through a token-group matrix.

1. Every text becomes a set of n-gram hashes; equal sets become one node.
2. Only a node's prefix is indexed: its first |A| - ceil(t|A|) + 1 tokens in one global order.  Two sets of similarity t share prefix
   tokens, and at least ``needed`` of them, so counting shared prefix tokens decides most pairs without opening a set.  The order
   is frequent tokens last, then by hash; frequencies are counted over all documents and kept in a table of fixed size, which only
   costs time where tokens collide.
3. Star step: every node is compared with the pivot of its tokens.  A group of thousands of near copies becomes one component in time
   linear in its size.
4. Token-group matrix: nodes of similar size that share their first common token are partitioned into groups of about GROUP_MEMBERS; a
   group stores the union of its members' prefix tokens.  Query nodes meet groups with members of *other* components through that
   matrix, and only by tokens that are rare enough in both to have as many shared ones behind them as a link needs; then the overlap
   with the union bounds the overlap with every member, and only groups that the bound cannot exclude are opened; their members are
   counted, then verified exactly.

Links inside a component would not change it, so they are never expanded; every link between components is found.

Edge cases: a text without words, or a null, is an empty set and linked with nothing; fewer than n words are one n-gram; repeated rows
are one node; rows without doc_id take part and get the smallest doc_id of their class, if any; extra columns are ignored.
Token hashes have 64 bits, set digests 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import query, table, whole_text
from .components import components

LEVEL_BITS = 18  # slots of the table of frequent tokens
FREQUENT = 16  # rows beyond the usual load of a slot from which its tokens count as frequent
GROUP_MEMBERS = 32
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Threshold:
    """Linked when den * intersection >= num * union."""

    words: int
    num: int
    den: int

    def prefix(self, size: int) -> int:
        return size - -(-self.num * size // self.den) + 1

    def rest(self, size: Column) -> Column:
        """Tokens after the prefix."""
        return F.ceil(size * self.num / self.den) - 1

    def overlap(self, a: Column, b: Column) -> Column:
        return F.ceil((a + b) * self.num / (self.num + self.den))

    def needed(self, a: Column, b: Column) -> Column:
        """Least number of common prefix tokens of two linked sets: what lies behind the shorter prefix is at most its rest."""
        return F.greatest(F.lit(1), self.overlap(a, b) - F.greatest(self.rest(a), self.rest(b)))

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 20
BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []  # BASE^i and BASE^-i modulo 2^64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 2 * CHUNK), x, np.uint64)))) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(ODD[1])
    return x ^ (x >> np.uint64(29))


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of adjoining texts that begin at ``starts``, and the number of its text."""
    up, down = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:-1])))
    inside = ~SPACE[data]
    goes_on = inside & np.concatenate((np.zeros(1, bool), inside[:-1]))
    goes_on[starts[starts < len(data)]] = False  # a text begins a word even if the one before ends in one
    begin = np.flatnonzero(inside & ~goes_on)
    end = np.flatnonzero(inside & ~np.concatenate((goes_on[1:], np.zeros(1, bool)))) + 1
    return _mixed((sums[end] - sums[begin]) * down[begin]), np.searchsorted(starts, begin, "right") - 1


def _sets_of_chunk(data: np.ndarray, starts: np.ndarray, words: int) -> Iterator[np.ndarray]:
    hashes, owner = _word_hashes(data, starts)
    held = np.bincount(owner, minlength=len(starts))
    count = max(0, len(hashes) - words + 1)
    value = np.full(count, words, np.uint64)
    for i in range(words):
        value = _mixed(value * np.uint64(ODD[0]) + hashes[i : i + count])
    whole = owner[:count] == owner[words - 1 : words - 1 + count]
    value = value[whole]
    ends = np.cumsum(np.maximum(0, held - words + 1))
    first_word = np.cumsum(held) - held
    for i, (n, end) in enumerate(zip(held.tolist(), ends.tolist(), strict=True)):
        if n >= words:
            yield np.unique(value[end - n + words - 1 : end])
        else:
            short = np.full(min(n, 1), n, np.uint64)
            for w in hashes[first_word[i] : first_word[i] + n]:
                short = _mixed(short * np.uint64(ODD[0]) + w)
            yield short


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text.  Only A-Z is lower-cased; words are split at ASCII white space."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
        high = min(high, len(texts))
        yield from _sets_of_chunk(data[offsets[low] : offsets[high]], offsets[low:high] - offsets[low], words)
        low = high


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.tobytes(), usedforsecurity=False).digest()


def _nodes_and_counts(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, node, null, null) of every row; and of each task one row of counts of tokens by slot."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    names = ["doc_id", "n_shingles", "node", "slots", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(1 << LEVEL_BITS, np.int64), None
        for batch in batches:
            kind, sizes, nodes, slots = batch.schema.field(0).type, [], [], []
            for found in shingle_sets(batch.column(1), words):
                sizes.append(len(found))
                nodes.append(_digest(found))
                slots.append(_slots(found))
            if slots:
                counts += np.bincount(np.concatenate(slots), minlength=len(counts))
            none = [pa.nulls(len(sizes), pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), *none], names=names)
        at = np.flatnonzero(counts)
        if len(at):
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (at, counts[at])]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *lists], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut_lineage(rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, slots array<long>, counts array<long>"), "nodes")


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64((1 << LEVEL_BITS) - 1)).astype(np.int64)


def _prefix_rows(docs: DataFrame, how: Threshold, levels) -> DataFrame:
    """(token, node, size) of every prefix token; levels: broadcast table of frequency levels by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, nodes, sizes, counts = [], [], [], []
            for found in shingle_sets(batch.column(0), how.words):
                if not len(found):
                    continue
                n = how.prefix(len(found))
                nodes.append(_digest(found))
                level = levels.value[_slots(found)]
                if level.any():
                    found = found[np.lexsort((found, level))]
                tokens.append(found[:n])
                sizes.append(len(found))
                counts.append(n)
            if not tokens:
                continue
            keys = np.repeat(np.frombuffer(b"".join(nodes), "V16"), counts)
            binary = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, 16 * len(keys) + 1, 16, dtype=np.int32)), pa.py_buffer(keys.tobytes())])
            columns = [pa.array(np.concatenate(tokens).view(np.int64)), binary, pa.array(np.repeat(np.array(sizes, np.int64), counts))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "node", "size"])

    return docs.select(whole_text().alias("text")).mapInArrow(run, "token long, node binary, size long")


def _frequency_levels(counted: DataFrame) -> np.ndarray:
    """By slot, log2 of the rows that its most frequent token has beyond what all slots hold.  2^LEVEL_BITS rows reach the driver."""
    pairs = counted.where("slots is not null").select(F.explode(F.arrays_zip("slots", "counts")).alias("p")).select(F.col("p.slots").alias("slot"), F.col("p.counts").alias("n"))
    found = pairs.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << LEVEL_BITS)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    usual = np.median(counts)
    beyond = counts - usual - 4 * np.sqrt(usual)
    return np.where(beyond >= FREQUENT, np.log2(np.maximum(beyond, 1)), 0).astype(np.uint8)


def _sets_of(docs: DataFrame, how: Threshold, wanted: DataFrame) -> DataFrame:
    """(node, tokens) of the wanted nodes, written once.

    Which texts can be wanted is decided where they are read, by a table of first bytes of the digests; the join makes it exact.
    """
    first = wanted.select(F.conv(F.hex(F.substring("node", 1, 3)), 16, 10).cast("int").alias("head")).distinct()
    heads = np.zeros(1 << 24, bool)
    heads[first.toArrow().column("head").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(heads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            nodes, tokens = [], []
            for found in shingle_sets(batch.column(0), how.words):
                digest = _digest(found)
                head = int.from_bytes(digest[:3])
                if bits[head >> 3] >> (7 - (head & 7)) & 1:
                    nodes.append(digest)
                    tokens.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    sets = docs.select(whole_text().alias("text")).mapInArrow(run, "node binary, tokens binary")
    return cut_lineage(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "token-sets")


def _verified(pairs: DataFrame, docs: DataFrame, how: Threshold) -> DataFrame:
    """(u, v) of the pairs that are linked, by their whole sets."""
    pairs = cut_lineage(pairs.select("u", "v"), "pairs")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = _sets_of(docs, how, ends)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("left_tokens")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("right_tokens")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(how.den * common >= how.num * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return cut_lineage(both.select("u", "v", "left_tokens", "right_tokens").mapInArrow(run, "u binary, v binary"), "verified")


def _with_held(rows: DataFrame) -> DataFrame:
    """Rows of (token, node) with ``held``, how many of them the node has: no two nodes share more tokens than either holds."""
    return rows.join(rows.groupBy("node").agg(F.count("*").alias("held")), "node")


def _star_pairs(shared: DataFrame, how: Threshold) -> DataFrame:
    """(u, v): a node and the pivot with which it shares most tokens, where enough are shared.

    The pivot of a token is its node with most shared tokens: among near copies, the one with fewest words of its own.
    """
    rows = _with_held(shared)
    pivots = rows.groupBy("token").agg(F.max(F.struct("held", "node", "size")).alias("pivot"))
    met = (
        rows.join(pivots, "token")
        .where((F.col("node") != F.col("pivot.node")) & how.sizes_fit(F.col("size"), F.col("pivot.size")))
        .groupBy("node", "size", "pivot")
        .agg(F.count("*").alias("common"))
        .where(F.col("common") >= how.needed(F.col("size"), F.col("pivot.size")))
    )
    return met.groupBy("node").agg(F.max(F.struct("common", "pivot")).alias("best")).select(F.col("node").alias("u"), F.col("best.pivot.node").alias("v"))


def _ranked(shared: DataFrame) -> DataFrame:
    """Rows (token, node, size, component) of tokens that lie in several components, with ``held``, how many the node has, and ``slack``.

    The tokens of a node are ordered by the number of nodes that have them, rare first; slack counts a token and those after it.  If two
    nodes share k tokens, the rarest shared one has a slack of k or more in both.
    """
    tokens = shared.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("nodes"))
    rows = shared.join(tokens.where("low <> high").select("token", "nodes"), "token")
    own = Window.partitionBy("node")
    rows = rows.withColumns({"held": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("nodes", "token"))})
    return cut_lineage(rows.select("token", "node", "size", "component", "held", (F.col("held") - F.col("rank") + 1).alias("slack")), "matrix-rows")


def _group_matrix_pairs(shared: DataFrame, how: Threshold) -> DataFrame:
    """(u, v) of different components that the token-group matrix and the count of common prefix tokens leave open.

    shared: (token, node, size, component).
    """
    rows = _ranked(shared)
    band = F.floor(F.log(F.col("size")) / F.log(F.lit(1.05)))
    like = ["lead", "band", "level"]
    members = rows.groupBy("node", "size", "component", "held").agg(F.min("token").alias("lead"))
    members = members.withColumns({"band": band, "level": F.floor(F.log2("held"))})
    counts = members.groupBy(*like).agg(F.count("*").alias("alike"))
    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("alike") / GROUP_MEMBERS))
    members = cut_lineage(members.join(counts, like).select("node", "size", "component", "held", F.xxhash64(*like, cut).alias("group")), "groups")
    spans = members.groupBy("group").agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.max("component").alias("last"), F.max("held").alias("most_held")
    )
    matrix = rows.join(members.select("node", "group"), "node").groupBy("token", "group").agg(F.max("slack").alias("group_slack")).join(spans, "group")
    matrix = cut_lineage(matrix, "matrix")
    a, low, high = F.col("size"), F.greatest(F.col("least"), F.ceil(F.col("size") * how.num / how.den)), F.least(F.col("most"), F.floor(F.col("size") * how.den / how.num))
    least = F.least(how.needed(a, low), how.needed(a, high)) - F.when(low < high, 1).otherwise(0)  # sizes between may need one less
    meets = (F.col("component") < F.col("last")) & (low <= high) & (F.least("held", "most_held") >= least) & (F.least("slack", "group_slack") >= least)
    met = rows.join(matrix, "token").where(meets).select("node", "size", "component", "group", least.alias("needed")).distinct()
    tokens = cut_lineage(rows.groupBy("node").agg(F.collect_list("token").alias("tokens")), "node-tokens")  # at most a node's prefix
    # a group is one row with its members, so a node that opens it is compared with them in place and no pair becomes a row before it is counted
    inside = members.join(tokens.withColumnRenamed("tokens", "own"), "node").select(
        "group", F.struct(F.col("node").alias("v"), "size", "component", "held", "own").alias("m")
    )
    inside = inside.groupBy("group").agg(F.collect_list("m").alias("members"))
    inside = inside.withColumn("union", F.array_distinct(F.flatten(F.transform("members", lambda m: m["own"]))))
    opened = met.join(tokens, "node").join(inside, "group").where(F.size(F.array_intersect("tokens", "union")) >= F.col("needed"))

    def passes(m: Column) -> Column:
        needed = how.needed(a, m["size"])
        fits = (F.col("component") < m["component"]) & how.sizes_fit(a, m["size"]) & (m["held"] >= needed)
        return fits & (F.size(F.array_intersect("tokens", m["own"])) >= needed)

    return opened.select(F.col("node").alias("u"), F.explode(F.transform(F.filter("members", passes), lambda m: m["v"])).alias("v"))


def near_duplicate_classes(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, node, component_id for every row."""
    how = Threshold(words, num, den)
    spark = docs.sparkSession
    counted = _nodes_and_counts(docs, words)
    nodes = counted.where("slots is null").select("doc_id", "n_shingles", "node")
    levels = spark.sparkContext.broadcast(_frequency_levels(counted))
    prefix = _prefix_rows(docs, how, levels)
    key = F.xxhash64("node")
    every = Window.partitionBy("token")  # prefix tokens are made and moved once; the frequent ones lie behind the prefixes
    repeated = prefix.withColumns({"low": F.min(key).over(every), "high": F.max(key).over(every)}).where("low <> high")
    shared = cut_lineage(repeated.select("token", "node", "size").distinct(), "shared-tokens")

    links = _verified(_star_pairs(shared, how), docs, how)
    stars = cut_lineage(components(links), "stars")
    placed = shared.join(stars.withColumnRenamed("u", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = _verified(_group_matrix_pairs(placed, how), docs, how)
    classes = components(links.union(more))

    named = nodes.join(classes.withColumnRenamed("u", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = named.join(smallest, "component", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", "node", own.alias("component_id"))


@query("op9_token_group_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def one_of_each_class(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that a smaller doc_id of their class stands for, all columns as they are.

    Rows that repeat a doc_id stay or go together; rows without doc_id and documents without words stay.
    """
    classes = near_duplicate_classes(docs, words, num, den)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
