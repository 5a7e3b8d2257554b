"""Importance resampling towards a target distribution, with n-grams interned in open-addressed NumPy tables.

A text is cut into words of digits, letters and everything beyond ASCII, with A-Z in lower case.  Its features are the runs of ``least``
to ``most`` words.  Words are copied into one buffer with a single space between them, so a feature is a slice of that buffer whatever
its number of words.  Each chunk of a batch interns its features in an open-addressed table: XXH64 keys, linear probing, and a claim
only holds when the bytes agree.  A slot has its feature's bucket (CRC-32 of the bytes) and its count; occurrences keep the number of
their slot, by which they gather what belongs to the bucket.

Two passes over the texts: the first adds up buckets over documents and over the target texts (each task sends one row per bucket), the
second sums the gains of each document's features.  Gains are a table of one number per bucket, whatever the corpus.

The draw is exact and needs no task that holds all rows: scores are whole numbers, so counts by score give the rank at which each score
begins, and only documents of one score are ordered among themselves, after rows that are equal in all columns became one with a count.

Edge cases: a null text has no words; a text without words has no features and weight 0; fewer words than ``least`` make no feature; a
null doc_id hashes as an empty one and comes last in a tie; repeated rows are rows of their own with ranks next to each other; an empty
table of documents gives no rows, an empty target gives every bucket t = T = 0; extra columns are ignored.  A long text is read in parts
that end after a word, the last words of a part being carried over; only a single word is never cut.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import query, table, whole_text

CHUNK = 1 << 18  # bytes of text interned in one table
LEVEL_WIDTH = 256  # scores whose counts are added up side by side

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


@dataclass(frozen=True)
class Plan:
    least: int = 1
    most: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: str = "2024"


class Slices:
    """Features of some texts as slices of one buffer; eight bytes at any place can be read at once."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.buffer = np.concatenate((buffer, np.zeros(8, np.uint8)))
        self.eight = np.ndarray(len(self.buffer) - 7, "<u8", self.buffer, 0, (1,))
        self.four = np.ndarray(len(self.buffer) - 7, "<u4", self.buffer, 0, (1,))
        self.start, self.length = start, length

    def bytes_of(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of slices a and b agree, one by one."""
        equal = self.length[a] == self.length[b]
        left = np.flatnonzero(equal & (a != b))
        at_a, at_b, rest = self.start[a[left]], self.start[b[left]], self.length[a[left]].copy()
        while len(left):
            tail = np.minimum(rest, 8).astype(np.uint64) * np.uint64(8)
            mask = np.where(tail == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (tail % np.uint64(64))) - np.uint64(1))
            differs = (self.eight[at_a] ^ self.eight[at_b]) & mask != 0
            equal[left[differs]] = False
            on = ~differs & (rest > 8)
            left, at_a, at_b, rest = left[on], at_a[on] + 8, at_b[on] + 8, rest[on] - 8
        return equal


# The five primes of XXH64
P1, P2, P3, P4, P5 = map(
    np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(slices: Slices) -> np.ndarray:
    """XXH64 with seed 0 of every slice: those below 32 bytes together by length, longer ones one by one."""
    out = np.empty(len(slices.start), np.uint64)
    order = np.argsort(slices.length, kind="stable")
    lengths = slices.length[order]
    at = 0
    while at < len(order):
        n = int(lengths[at])
        if n >= 32:
            for i in order[at:].tolist():
                out[i] = xxhash.xxh64_intdigest(slices.bytes_of(i))
            break
        end = int(np.searchsorted(lengths, n, "right"))
        which = order[at:end]
        place = slices.start[which]
        h = np.full(len(which), P5 + np.uint64(n), np.uint64)
        for _ in range(n // 8):
            h = _rotated(h ^ (_rotated(slices.eight[place] * P2, 31) * P1), 27) * P1 + P4
            place = place + 8
        if n & 4:
            h = _rotated(h ^ (slices.four[place].astype(np.uint64) * P1), 23) * P2 + P3
            place = place + 4
        for _ in range(n & 3):
            h = _rotated(h ^ (slices.buffer[place].astype(np.uint64) * P5), 11) * P1
            place = place + 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[which] = h ^ (h >> np.uint64(32))
        at = end
    return out


class InternTable:
    """Open-addressed table of the distinct slices: ``owner`` has the slice that claimed a slot, ``slot_of`` the slot of each slice."""

    def __init__(self, slices: Slices, buckets: int):
        n = len(slices.start)
        size = 1 << max(4, (2 * n).bit_length())
        keys = xxh64(slices)
        self.owner = np.full(size, -1, np.int64)
        self.slot_of = (keys & np.uint64(size - 1)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            slot = self.slot_of[left]
            free = self.owner[slot] < 0
            self.owner[slot[free]] = left[free]  # of several claims to a free slot one stays; the others go on from there
            owner = self.owner[slot]
            settled = keys[owner] == keys[left]
            check = np.flatnonzero(settled)
            settled[check] = slices.same(owner[check], left[check])
            left = left[~settled]
            self.slot_of[left] = (self.slot_of[left] + 1) & (size - 1)
        self.filled = np.flatnonzero(self.owner >= 0)
        self.count = np.bincount(self.slot_of, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        self.bucket[self.filled] = [zlib.crc32(slices.bytes_of(i)) % buckets for i in self.owner[self.filled].tolist()]

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        np.add.at(out, self.bucket[self.filled], self.count[self.filled])
        return out

    def gathered(self, of_bucket: np.ndarray) -> np.ndarray:
        """What each occurrence's bucket holds, through its slot."""
        in_slot = np.zeros(len(self.owner), np.int64)
        in_slot[self.filled] = of_bucket[self.bucket[self.filled]]
        return in_slot[self.slot_of]


def _parts(texts: pa.Array, carry: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """Groups of (text, bytes, carried words) of about CHUNK bytes; a longer text comes in parts that end after a word."""
    group, held = [], 0
    for i, value in enumerate(texts):
        view = value.as_buffer()
        at, size, before = 0, len(view) if view is not None else 0, b""
        while at < size:
            end = min(size, at + CHUNK)
            if end < size:
                while end < size:  # on to the next byte that is in no word
                    piece = np.frombuffer(view, np.uint8, min(CHUNK, size - end), end)
                    stops = np.flatnonzero(~WORD_BYTE[LOWER[piece]])
                    end += int(stops[0]) + 1 if len(stops) else len(piece)
                    if len(stops):
                        break
            part = bytes(memoryview(view)[at:end])
            words = before.count(b" ")
            group.append((i, before + part, words))
            held += len(part)
            if end < size and carry:
                buffer, start, stop, _ = _words([before + part])
                last = start[-carry:]
                before = b"".join(buffer[a:b].tobytes() + b" " for a, b in zip(last, stop[-carry:], strict=True))
            at = end
            if held >= CHUNK:
                yield group
                group, held = [], 0
    if group:
        yield group


def _words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of adjoining parts in one buffer, a space after each: buffer, starts, ends, and the part of each word."""
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    low = LOWER[data]
    inside = WORD_BYTE[low]
    closes = ~inside
    closes[1:] &= inside[:-1]
    closes[0] = False
    kept = inside | closes
    buffer, is_word = low[kept], inside[kept]
    buffer[~is_word] = 32
    end = np.flatnonzero(~is_word)
    start = np.concatenate((np.zeros(1, np.int64), end[:-1] + 1))[: len(end)]
    borders = np.cumsum([len(p) + 1 for p in parts])
    place = np.flatnonzero(closes)
    return buffer, start, end, np.searchsorted(borders, place, "right")


def _features(group: list[tuple[int, bytes, int]], plan: Plan) -> tuple[Slices, np.ndarray, np.ndarray]:
    """All features of a group of parts, the text of each, and the text of each word (carried words left out)."""
    buffer, start, end, part = _words([p for _, p, _ in group])
    text_of = np.array([i for i, _, _ in group], np.int64)
    first = np.searchsorted(part, np.arange(len(group)))
    fresh = np.arange(len(part)) - first[part] >= np.array([c for _, _, c in group], np.int64)[part] if len(part) else np.zeros(0, bool)
    starts, ends, owners = [], [], []
    for n in range(plan.least, plan.most + 1):
        m = max(0, len(part) - n + 1)
        whole = (part[:m] == part[n - 1 : n - 1 + m]) & fresh[n - 1 : n - 1 + m]
        starts.append(start[:m][whole])
        ends.append(end[n - 1 : n - 1 + m][whole])
        owners.append(text_of[part[:m][whole]])
    at = np.concatenate(starts)
    return Slices(buffer, at, np.concatenate(ends) - at), np.concatenate(owners), text_of[part[fresh]]


def bucket_totals(texts: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, n): occurrences of features by bucket; each task sends its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(plan.buckets, np.int64)
        for batch in batches:
            for group in _parts(batch.column(0), plan.most - 1):
                slices, _, _ = _features(group, plan)
                if len(slices.start):
                    total += InternTable(slices, plan.buckets).totals(plan.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return texts.select(whole_text().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _collected(totals: DataFrame, buckets: int) -> np.ndarray:
    """At most one row per bucket comes to the driver."""
    found = totals.toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: a thousand times the log ratio of the smoothed target and raw models, rounded down."""
    n = float(len(raw))
    s_all, t_all = float(raw.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, of_bucket: np.ndarray, plan: Plan) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(of_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, sums = (np.zeros(len(batch), np.int64) for _ in range(3))
            for group in _parts(batch.column(1), plan.most - 1):
                slices, owner, words = _features(group, plan)
                n_words += np.bincount(words, minlength=len(batch))
                if len(owner):
                    n_features += np.bincount(owner, minlength=len(batch))
                    np.add.at(sums, owner, InternTable(slices, plan.buckets).gathered(shared.value))
            weight = sums // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: str, doc_id: Column) -> Column:
    """A thousand times a Gumbel draw that depends on seed and doc_id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """The rows with the rank of those drawn: of the eligible ones the given percentage, by falling score, then doc_id.

    scored: a written table with doc_id and score, which is read several times; its other columns order rows equal in both.
    """
    names = scored.columns
    in_draw = scored.where(eligible)
    drawn = in_draw.count() * percent // 100
    level = F.floor(F.col("score") / LEVEL_WIDTH)
    counts = in_draw.groupBy("score").agg(F.count("*").alias("n")).withColumn("level", level)
    above = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)  # a few hundred rows: scores are sums of logarithms
    levels = counts.groupBy("level").agg(F.sum("n").alias("n")).select("level", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    inside = Window.partitionBy("level").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("score", "level", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("within")).join(levels, "level")
    starts = starts.select("score", (F.col("before") + F.col("within")).alias("start")).where(F.col("start") < drawn)

    rows = scored.withColumn("drawable", F.coalesce(eligible, F.lit(False))).join(starts, "score", "left")
    reached = F.col("drawable") & F.col("start").isNotNull()
    out = rows.where(~reached).select(*names, F.lit(None).cast("long").alias("rank"))
    equal = rows.where(reached).groupBy(*names, "start").agg(F.count("*").alias("n"))
    others = [F.col(c).asc_nulls_last() for c in names if c not in ("doc_id", "score")]
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), *others)
    last = F.col("start") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = equal.withColumn("last", last).select(*names, F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last"))).alias("place"))
    return out.union(placed.select(*names, F.when(F.col("place") <= drawn, F.col("place")).alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document."""
    of_bucket = gains(_collected(bucket_totals(docs, plan), plan.buckets), _collected(bucket_totals(target, plan), plan.buckets))
    scored = weighed(docs, of_bucket, plan).withColumn("score", F.col("weight") + noise(plan.seed, F.col("doc_id")))
    return ranked(cut_lineage(scored, "weighed"), F.col("n_words") >= plan.min_words, plan.percent)


PRODUCTION = Plan()
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP13_SQL = rf"""
WITH byte_crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, true AS raw FROM documents
  UNION ALL SELECT NULL, NULL, coalesce(text, ''), false FROM benchmark
), words AS (
  SELECT r, raw, unnest(regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), crcs AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % {PRODUCTION.buckets} AS bucket
  FROM (SELECT DISTINCT word FROM words), byte_crc
), counts AS (
  SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM words JOIN crcs USING (word) GROUP BY bucket
), sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {PRODUCTION.buckets}) / ((s + 1)::DOUBLE * (t_all + {PRODUCTION.buckets}))))::BIGINT AS gain FROM counts, sums
), held AS (
  SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN crcs USING (word) JOIN gains USING (bucket) WHERE raw GROUP BY r
), scored AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('{PRODUCTION.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN held USING (r) WHERE raw
), places AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {PRODUCTION.min_words}
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  (CASE WHEN place <= n * {PRODUCTION.percent} // 100 THEN place END)::BIGINT AS rank
FROM scored LEFT JOIN places USING (r)
"""


@query("op13_target_resampling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), PRODUCTION).select("doc_id", "n_features", "weight", "score", "rank")
