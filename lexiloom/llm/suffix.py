"""Exact substring deduplication over a sparse suffix array, sorted deep-shallow.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else in the corpus.

* Anchors.  Of the grams of GRAM bytes inside a LENGTH-byte window, the one with the smallest hash (leftmost) is the window's anchor.
  Equal windows have their anchors at the same offset, so only suffixes at anchors, about 2 of 150 positions, need sorting.
* Anchors whose gram hash occurs once in the corpus match nothing.  For the others the bytes around them are sent to the gram's group.
* Deep-shallow sorting.  A group sorts its anchors by the bytes to the right and by the bytes to the left: multikey quicksort over
  8-byte words to a shallow depth, then a blind trie for groups whose common prefix is longer.  Neighbours' common prefixes give, for
  each depth, the classes of equal prefixes, and two windows with the anchor at offset l are equal if their left classes at depth l
  and their right classes at depth LENGTH - l are.
* Repeats inside one text are found where the text is, by window hashes, so a text that repeats a word ten thousand times sends each
  distinct window once.  Copies of a text are one text that occurs several times, and go whole.
* A gram with more than HOT anchors (a passage that very many documents share) takes an equal exact way without a group: its windows
  are counted by a 128-bit hash, which Spark combines on the map side.

Edge cases: null and empty texts, and texts below LENGTH bytes, lose nothing; repeated rows are copies; matches never cross rows; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import query, table, whole_text

LENGTH = 200
GRAM = 48
WINDOW = LENGTH - GRAM + 1
SHALLOW = 16
HOT = 20_000
HEAD_BYTES = 3
PLACE_BITS = 28  # texts up to 256 MB
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BASE = 0xD6E8FEB86659FD93


class _Powers:
    """BASE^i and BASE^-i modulo 2^64, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 2 * n
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64)))) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(ODD[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(ODD[1])
    return x ^ (x >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours: prefix and suffix minima of blocks of that width."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(blocks, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(after[:count], before[width - 1 : width - 1 + count])


class Anchors:
    """at, key: place and gram hash of each anchor; low, high: the windows [low, high) it serves; kept: whether it is needed outside;
    local: starts of windows that occur twice in this text."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, down = _POWERS.to(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])))
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        shift = np.uint64(PLACE_BITS)
        places = _sliding_min((grams >> shift << shift) | np.arange(len(grams), dtype=np.uint64), WINDOW) & np.uint64((1 << PLACE_BITS) - 1)
        edges = np.flatnonzero(places[1:] != places[:-1]) + 1
        self.low, self.high = np.concatenate(([0], edges)), np.append(edges, len(places))
        self.at = places[self.low].astype(np.int64)
        self.key = grams[self.at].view(np.int64)
        self.kept, self.local = np.ones(len(self.at), bool), np.empty(0, np.int64)
        _, inverse, counts = np.unique(self.key, return_inverse=True, return_counts=True)
        if len(counts) < len(self.key):
            several = np.flatnonzero(counts[inverse] > 1)
            lengths = (self.high - self.low)[several]
            ends = np.cumsum(lengths)
            starts = np.arange(ends[-1]) + np.repeat(self.low[several] - ends + lengths, lengths)
            hashes = _mixed((sums[starts + LENGTH] - sums[starts]) * down[starts])
            _, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            self.local = starts[counts[inverse] > 1]
            new = np.zeros(len(starts), bool)
            new[first] = True
            self.kept[several] = np.logical_or.reduceat(new, ends - lengths)


def _bytes(text) -> np.ndarray:
    return np.frombuffer(text.as_buffer() or b"", np.uint8)


def _digest(data: np.ndarray) -> bytes:
    return hashlib.md5(data.tobytes(), usedforsecurity=False).digest()


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], signed=True)


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(key, short, at) of the anchors of every text.  Two rows under a key of its own mark a text that repeats itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shorts, places = [], [], []
            for value in batch.column(0):
                data = _bytes(value)
                if len(data) < LENGTH:
                    continue
                found, short = Anchors(data), _short(_digest(data))
                own, at = found.key[found.kept], found.at[found.kept]
                if len(found.local):
                    own, at = np.append(own, [short ^ 1] * 2), np.append(at, [-1, -2])
                keys.append(own)
                places.append(at)
                shorts.append(np.full(len(own), short, np.int64))
            if keys:
                columns = [np.concatenate(keys), np.concatenate(shorts), np.concatenate(places).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "short", "at"])

    return texts.mapInArrow(run, "key long, short long, at int")


def _candidate_texts(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(digest, text, places) of each distinct text with shared anchors.

    Texts that cannot be wanted are left out where they are read, by the first bytes of their digests; the join makes it exact.
    """
    wanted = shared.groupBy("short").agg(F.collect_set("at").alias("places"))
    heads = np.zeros(1 << (8 * HEAD_BYTES), bool)
    first = shared.select(F.shiftrightunsigned("short", 64 - 8 * HEAD_BYTES).cast("int").alias("head")).distinct()
    heads[first.toArrow().column("head").to_numpy()] = True
    bits = texts.sparkSession.sparkContext.broadcast(np.packbits(heads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            digests = [_digest(_bytes(t)) for t in batch.column(0)]
            head = np.array([int.from_bytes(d[:HEAD_BYTES]) for d in digests], np.int64)
            keep = pa.array((held[head >> 3] >> (7 - (head & 7)).astype(np.uint8) & 1).astype(bool))
            columns = [pa.array([_short(d) for d in digests], pa.int64()), pa.array(digests, pa.binary()), batch.column(0)]
            yield pa.RecordBatch.from_arrays(columns, names=["short", "digest", "text"]).filter(keep)

    found = texts.mapInArrow(run, "short long, digest binary, text binary").dropDuplicates(["digest"])
    return cut_lineage(found.join(wanted, "short").select("digest", "text", "places"), "candidate-texts")


def _contexts(candidates: DataFrame) -> DataFrame:
    """(key, digest, start, left, windows, around): the bytes that the windows of one shared anchor cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "digest", "start", "left", "windows", "around"]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for digest, text, places in zip(*(batch.column(i) for i in range(3)), strict=True):
                data, digest = _bytes(text), digest.as_py()
                found, whole = Anchors(data), data.tobytes()
                for i in np.flatnonzero(found.kept & np.isin(found.at, places.values.to_numpy())).tolist():
                    low, high = int(found.low[i]), int(found.high[i])
                    for column, value in zip(rows, (int(found.key[i]), digest, low, int(found.at[i]) - low, high - low, whole[low : high - 1 + LENGTH]), strict=True):
                        column.append(value)
                if len(rows[0]) > 20_000:
                    yield _batch(rows, names)
                    rows = [[] for _ in names]
            yield _batch(rows, names)

    return candidates.mapInArrow(run, "key long, digest binary, start int, left int, windows int, around binary")


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=names)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - 1 - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() - 1) // 8


class _Node:
    """An inner node of a blind trie: the depth at which its children differ, and the child of each byte there (-1: the end)."""

    __slots__ = ("depth", "kids")

    def __init__(self, depth: int, kids: dict):
        self.depth, self.kids = depth, kids


def _byte(text: bytes, depth: int) -> int:
    return text[depth] if depth < len(text) else -1


def _inserted(root, strings: list[bytes], member: int):
    """The trie with one more string.  It descends blindly to some leaf; one comparison there tells where it branches off."""
    own, node = strings[member], root
    while isinstance(node, _Node):
        node = node.kids.get(_byte(own, node.depth)) or next(iter(node.kids.values()))
    sample = strings[node[0]]
    depth = common_prefix(own, sample)
    above, node = None, root
    while isinstance(node, _Node) and node.depth < depth:
        above, node = node, node.kids[own[node.depth]]
    if isinstance(node, _Node) and node.depth == depth:
        node.kids.setdefault(_byte(own, depth), []).append(member)
    elif not isinstance(node, _Node) and len(own) == len(sample) == depth:
        node.append(member)
    else:
        fork = _Node(depth, {_byte(sample, depth): node, _byte(own, depth): [member]})
        if above is None:
            return fork
        above.kids[own[above.depth]] = fork
    return root


def _blind_sort(strings: list[bytes], members: list[int]) -> list[int]:
    root = [members[0]]
    for member in members[1:]:
        root = _inserted(root, strings, member)
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack += [node.kids[b] for b in sorted(node.kids, reverse=True)]
        else:
            order += node
    return order


def deep_shallow(strings: list[bytes], start: int = 0) -> tuple[list[int], list[int]]:
    """The order of strings that share their first ``start`` bytes, and each one's common prefix with the one before it (0 for the first)."""
    order, stack = [], [(list(range(len(strings))), start)]
    while stack:
        members, depth = stack.pop()
        if len(members) <= 1:
            order += members
        elif depth >= start + SHALLOW:
            order += _blind_sort(strings, members)
        else:
            pivot = strings[members[len(members) // 2]][depth : depth + 8]
            parts: tuple[list[int], list[int], list[int]] = ([], [], [])
            for m in members:
                word = strings[m][depth : depth + 8]
                parts[(word >= pivot) + (word > pivot)].append(m)
            stack += [(parts[2], depth), (parts[1], depth + 8), (parts[0], depth)]
    return order, [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def _ranked(strings: list[bytes], groups: list[tuple[int, int]], start: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order over all groups, and the common prefix with the string before; -1 at the start of a group."""
    order, prefixes = np.empty(len(strings), np.int64), np.empty(len(strings), np.int64)
    for low, high in groups:
        own, common = deep_shallow(strings[low:high], start)
        order[low:high], prefixes[low:high] = np.array(own) + low, common
        prefixes[low] = -1
    return order, prefixes


def _repeated(keys: np.ndarray, start: np.ndarray, left: np.ndarray, windows: np.ndarray, around: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, window start) of every window that another row of its group has too.  Rows come sorted by key."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    groups = list(zip(np.concatenate(([0], edges)).tolist(), np.append(edges, len(keys)).tolist(), strict=True))
    offsets = left.tolist()
    right_order, right_common = _ranked([b[o:] for b, o in zip(around, offsets, strict=True)], groups, GRAM)
    left_order, left_common = _ranked([b[:o][::-1] for b, o in zip(around, offsets, strict=True)], groups, 0)
    rows, starts = [], []
    right_class, left_class = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    for offset in range(WINDOW):
        has = np.flatnonzero((left >= offset) & (left - windows < offset))
        if not len(has):
            continue
        right_class[right_order] = np.cumsum(right_common < LENGTH - offset)
        left_class[left_order] = np.cumsum(left_common < offset)
        pair = right_class[has] * (len(keys) + 1) + left_class[has]
        order = np.argsort(pair, kind="stable")
        equal = pair[order][1:] == pair[order][:-1]
        hit = has[order[np.append(equal, False) | np.insert(equal, 0, False)]]
        rows.append(hit)
        starts.append(start[hit] + left[hit] - offset)
    return (np.concatenate(rows), np.concatenate(starts)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _runs(owners: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, begin, end) of the bytes under windows whose starts follow each other."""
    order = np.lexsort((starts, owners))
    owners, starts = owners[order], starts[order]
    new = np.ones(len(owners), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (starts[1:] > starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owners)) - 1 if len(first) else first
    return owners[first], starts[first], starts[last] + LENGTH


def _matched(contexts: DataFrame) -> DataFrame:
    """(digest, begin, end) of repeated bytes; the rows of a key come together, sorted."""

    def solve(table_: pa.Table) -> pa.RecordBatch:
        keys, start, left, windows = (table_.column(n).to_numpy() for n in ("key", "start", "left", "windows"))
        around, digests = table_.column("around").to_pylist(), table_.column("digest").to_pylist()
        rows, starts = _repeated(keys, start.astype(np.int64), left.astype(np.int64), windows.astype(np.int64), around)
        rows, begin, end = _runs(rows, starts)
        columns = [pa.array([digests[r] for r in rows.tolist()], pa.binary()), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["digest", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if cut:
                yield solve(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield solve(pa.Table.from_batches(waiting))

    return contexts.sortWithinPartitions("key").mapInArrow(run, "digest binary, begin int, end int")


def _counted(contexts: DataFrame) -> DataFrame:
    """(digest, begin, end) of repeated windows by their 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                for i in range(row["windows"]):
                    value = xxhash.xxh3_128_intdigest(row["around"][i : i + LENGTH])
                    for column, x in zip(rows, (value >> 64, value & (1 << 64) - 1, row["digest"], row["start"] + i), strict=True):
                        column.append(x)
            columns = [pa.array(np.array(r, np.uint64).view(np.int64)) for r in rows[:2]] + [pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["high", "low", "digest", "begin"])

    windows = contexts.mapInArrow(run, "high long, low long, digest binary, begin int")
    place = F.xxhash64("digest", "begin")
    several = windows.groupBy("high", "low").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("high", "low")
    return windows.join(several, ["high", "low"], "left_semi").select("digest", "begin", (F.col("begin") + LENGTH).alias("end"))


def _removed(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256) of the candidate texts."""
    held = spans.groupBy("digest").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, begins, ends in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                data = _bytes(text)
                change = np.zeros(len(data) + 1, np.int64)
                if begins.is_valid:
                    np.add.at(change, begins.values.to_numpy(), 1)
                    np.add.at(change, ends.values.to_numpy(), -1)
                local = Anchors(data).local
                np.add.at(change, local, 1)
                np.add.at(change, local + LENGTH, -1)
                gone = np.cumsum(change)[:-1] > 0
                for column, value in zip(out, (int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest()), strict=True):
                    column.append(value)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "n_removed", "n_spans", "kept_sha256"])

    rows = candidates.select("digest", "text").join(held, "digest", "left")
    return rows.mapInArrow(run, "digest binary, n_removed long, n_spans long, kept_sha256 string")


def repeated_substrings(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts = docs.select(whole_text().cast("binary").alias("text"))
    anchors = _anchor_rows(texts)
    place = F.xxhash64("short", "at")
    repeated = anchors.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("key")
    shared = cut_lineage(anchors.join(repeated, "key", "left_semi").distinct(), "shared-anchors")
    candidates = _candidate_texts(texts, shared.select("short", "at"))
    contexts = _contexts(candidates)
    crowded = cut_lineage(shared.where("at >= 0").groupBy("key").count().where(F.col("count") > hot).select("key"), "crowded")
    if crowded.limit(1).count():
        spans = _matched(contexts.join(crowded, "key", "left_anti").repartition("key")).union(_counted(contexts.join(crowded, "key", "left_semi")))
    else:
        spans = _matched(contexts.repartition("key"))
    removed = cut_lineage(_removed(candidates, spans), "removed")

    text = whole_text().cast("binary")
    rows = docs.select("doc_id", F.unhex(F.md5(text)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own_sha"))
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"))
    several = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    joined = rows.join(copies, "digest").join(removed, "digest", "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(several, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(several, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(several, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own_sha")).alias("kept_sha256"),
    )


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents"))
