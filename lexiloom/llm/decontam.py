"""Benchmark decontamination by spaced-seed hashing.

Masks look at some words of a window, so it still meets its source when words under the holes were substituted.  A family of masks
belongs to the item's length, and together its masks hit every arrangement of substitutions that the law below allows.  Hashes of the
benchmark's windows fill a bit table of fixed size that goes with the tasks; a document's windows that pass it are joined to the
benchmark's windows by hash, which gives (document, item, shift) candidates, and each candidate is verified word by word around the
hit: some stretch of min(item length, 20) words must agree in at least 80 % of its places.

Decisions belong to texts, so copies of a text are decided once.

Edge cases: a null or empty text and an item without words match nothing; an item of fewer than 5 words matches where all of them
stand in a row; documents meet only the masks of lengths that the benchmark has; a very long text is read whole, and sent once per
item that it may hold, however often it does; repeated rows and items count once; an empty benchmark leaves every document clean; extra columns are kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import query, table, whole_text

# By least item length n: whatever n / 5 words of n words in a row are substituted, one of the masks looks at none of them.
FAMILIES = {
    20: ("1110110111", "11100010001111", "1110000100101011", "110110010111", "1110101100000101", "11010101010011", "1101100010100011"),
    15: ("11110111", "11100100111", "110010101011", "1001011001011", "1101100001011", "100100110111"),
    10: ("111011", "11000111", "110110001"),
    5: ("1111", "10111", "11011", "11101"),
    # the law allows no substitution in fewer than 5 words
    4: ("1111",),
    3: ("111",),
    2: ("11",),
    1: ("1",),
}
STRETCH = 20
AGREEMENT = 0.8
TABLE_BITS = 25
MEMO_WORDS = 1 << 19
WORD = re.compile(r"\w+")
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def words_of(text: str) -> np.ndarray:
    found = WORD.findall(text.lower())
    if len(_WORDS) > MEMO_WORDS:
        _WORDS.clear()
    return np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))


def window_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the looked-at words of every window; masks differ in their start value."""
    count = max(0, len(tokens) - len(mask) + 1)
    value = np.full(count, int(mask, 2), np.uint64)
    for i, looked_at in enumerate(mask):
        if looked_at == "1":
            value = value * np.uint64(ODD[0]) + tokens[i : i + count]
    value = (value ^ (value >> np.uint64(31))) * np.uint64(ODD[1])
    return value ^ (value >> np.uint64(29))


def masks_of(length: int) -> tuple[str, ...]:
    """The masks for an item of so many words; none without words."""
    return next((masks for least, masks in FAMILIES.items() if length >= least), ())


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << TABLE_BITS) - 1)
    return (hashes & low).astype(np.int64), (hashes >> np.uint64(TABLE_BITS) & low).astype(np.int64)


def _benchmark_windows(items: DataFrame) -> DataFrame:
    """(item, tokens) by distinct text, and their windows (hash, position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"item": [], "tokens": [], "hashes": [], "positions": []}
            for text in batch.column(0).to_pylist():
                tokens = words_of(text)
                windows = [np.empty(0, np.uint64), *(window_hashes(tokens, m) for m in masks_of(len(tokens)))]
                out["item"].append(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest())
                out["tokens"].append(tokens.tobytes())
                out["hashes"].append(np.concatenate(windows).view(np.int64))
                out["positions"].append(np.concatenate([np.arange(len(w), dtype=np.int32) for w in windows]))
            types = (pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    texts = items.select(whole_text().alias("text")).distinct()
    return cut_lineage(texts.mapInArrow(run, "item string, tokens binary, hashes array<long>, positions array<int>"), "benchmark")


def _bit_table(benchmark: DataFrame) -> np.ndarray:
    """Two bits per benchmark window.  At most 2^(TABLE_BITS - 5) words reach the driver, whatever the benchmark's size."""
    low = (1 << TABLE_BITS) - 1
    h = F.col("hash")
    bits = F.explode(F.array(h.bitwiseAND(low), F.shiftrightunsigned(h, TABLE_BITS).bitwiseAND(low))).alias("bit")
    words = benchmark.select(F.explode("hashes").alias("hash")).select(bits).groupBy(F.shiftright("bit", 5).cast("int").alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 31 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (TABLE_BITS - 5), np.uint32)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint32)
    return bits.view(np.uint8)


def _suspects(docs: DataFrame, bits, masks: tuple[str, ...]) -> DataFrame:
    """(digest, tokens, hashes, positions) of the texts with windows that the bit table holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            tokens = [words_of(t) for t in texts]
            starts = np.concatenate(([0], np.cumsum([len(t) for t in tokens], dtype=np.int64)))
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
            owner = np.repeat(np.arange(len(tokens)), np.diff(starts))
            hits = []
            for mask in masks:
                hashes = window_hashes(flat, mask)
                first, second = _slots(hashes)
                at = np.flatnonzero(held[first >> 3] >> (first & 7).astype(np.uint8) & 1)
                at = at[(held[second[at] >> 3] >> (second[at] & 7).astype(np.uint8) & 1).astype(bool)]
                at = at[owner[at] == owner[at + len(mask) - 1]]
                hits.append((at, hashes[at]))
            at, hashes = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.uint64)), *hits, strict=True))
            order = np.argsort(at, kind="stable")
            at, hashes = at[order], hashes[order].view(np.int64)
            texts_hit, first = np.unique(owner[at], return_index=True)
            last = np.append(first[1:], len(at))[: len(first)]
            names = ["digest", "tokens", "hashes", "positions"]
            columns = [
                pa.array([hashlib.md5(texts[d].encode(), usedforsecurity=False).hexdigest() for d in texts_hit], pa.string()),
                pa.array([tokens[d].tobytes() for d in texts_hit], pa.binary()),
                pa.array([hashes[a:b] for a, b in zip(first, last, strict=True)], pa.list_(pa.int64())),
                pa.array([(at[a:b] - starts[d]).astype(np.int32) for a, b, d in zip(first, last, texts_hit, strict=True)], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    found = docs.select(whole_text().alias("text")).mapInArrow(run, "digest string, tokens binary, hashes array<long>, positions array<int>")
    return cut_lineage(found, "suspects")


def agreement(doc: np.ndarray, item: np.ndarray, shift: int) -> float:
    """The best share of equal words over a stretch of min(item, STRETCH) words; words outside the document are unequal."""
    places = np.arange(len(item)) + shift
    inside = (places >= 0) & (places < len(doc))
    equal = np.zeros(len(item), np.int64)
    equal[inside] = doc[places[inside]] == item[inside]
    n = min(len(item), STRETCH)
    sums = np.concatenate(([0], np.cumsum(equal)))
    return float((sums[n:] - sums[:-n]).max()) / n if n else 0.0


def _verified(candidates: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = [
                max(agreement(np.frombuffer(d.as_buffer(), np.uint64), np.frombuffer(i.as_buffer(), np.uint64), s) for s in shifts.as_py())
                for d, i, shifts in zip(batch.column("doc_tokens"), batch.column("item_tokens"), batch.column("shifts"), strict=True)
            ]
            kept = batch.select(["digest", "item"]).append_column("agreement", pa.array(share, pa.float64()))
            yield kept.filter(pa.array([x >= AGREEMENT for x in share], pa.bool_()))

    return candidates.mapInArrow(run, "digest string, item string, agreement double")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(digest, item, agreement): md5 of a text that holds a passage of the item with that md5; best agreement of each pair."""
    spark = docs.sparkSession
    benchmark = _benchmark_windows(items)
    bits = spark.sparkContext.broadcast(_bit_table(benchmark))
    least = F.coalesce(*(F.when(F.length("tokens") >= 8 * n, n) for n in FAMILIES), F.lit(0)).alias("least")
    masks = dict.fromkeys(m for row in benchmark.select(least).distinct().collect() for m in masks_of(row.least))
    suspects = _suspects(docs, bits, tuple(masks))

    def windows(rows: DataFrame, key: str, position: str) -> DataFrame:
        pairs = F.explode(F.arrays_zip("hashes", "positions")).alias("w")
        return rows.select(key, pairs).select(key, F.col("w.hashes").alias("hash"), F.col("w.positions").alias(position)).distinct()

    met = windows(suspects, "digest", "at").join(windows(benchmark, "item", "from"), "hash")
    # one row per pair: its shifts are fewer than the two texts have words
    shifts = met.groupBy("digest", "item").agg(F.collect_set(F.col("at") - F.col("from")).alias("shifts"))
    one = suspects.select("digest", F.col("tokens").alias("doc_tokens")).dropDuplicates(["digest"])
    both = shifts.join(benchmark.select("item", F.col("tokens").alias("item_tokens")), "item").join(one, "digest")
    found = _verified(both.select("digest", "item", "shifts", "doc_tokens", "item_tokens"))
    return cut_lineage(found.groupBy("digest", "item").agg(F.max("agreement").alias("agreement")), "leaks")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without leaked passages, all columns as they are."""
    bad = leaks(docs, items).select("digest").distinct()
    return docs.join(bad, F.md5(whole_text()) == bad["digest"], "left_anti")


@query("op5_spaced_seed_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the ids of the benchmark items that it holds."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = leaks(docs, items)
    named = found.join(items.select("item_id", F.md5(whole_text()).alias("item")).distinct(), "item")
    by_text = named.groupBy("digest").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("agreement").alias("agreement"))
    rows = docs.select("doc_id", F.md5(whole_text()).alias("digest")).join(by_text, "digest", "left")
    return rows.select("doc_id", F.col("agreement").isNotNull().alias("contaminated"), "item_ids", "agreement")
