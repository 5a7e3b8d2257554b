"""Quality classifier by importance resampling.

Two generative models over hashed features: the target (documents labelled good: quality 1, not toxic) and the raw text (all
documents).  Features of a document are its distinct hashed words, punctuation runs and bigrams, and how long it repeats itself.  The
importance weight of a document is the product over its features of target probability over raw probability.  Counts are hashed
into two tables, and of a feature's two ratios the weaker one holds, so that a chance collision decides nothing.  A ratio counts where
it differs from 1 by more than RATIO, and is shrunken by 1 - EVIDENCE / deviance, where the deviance is that of the feature's labelled
good and bad documents from the share of good ones.  It grows with the labelled documents that have the feature, whatever part of the
corpus they are; what labels cannot tell apart stays neutral, in long documents too.  A labelled document is scored without its own
counts, so that the cut that is chosen on labels holds for the others.

Sampling is Gumbel top-k: k documents with the largest log weight + TEMPERATURE * Gumbel noise, which draws k documents without
replacement in proportion to weight^(1/TEMPERATURE).  k is the number of documents whose log weight reaches the cut that separates
labelled good from labelled bad documents best; a low temperature keeps clean documents.

Raw counts are taken over all documents.  Labels are used up to LABELS rows, those smallest by hash of their id.

Edge cases: null and empty texts have no features and weight 1; a document with several labels is good if all are; without labels
every document is kept; rows with equal id and text draw the same noise, and rows with equal keys stay or go together, so k may be
exceeded by ties; extra columns are kept by ``resample``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import query, table, whole_text

TABLE_BITS = 17
LABELS = 100_000
RATIO = 1.5
EVIDENCE = 9.0
TEMPERATURE = 0.05
LONG_RUN = 4
BINS = 4096
MEMO_WORDS = 1 << 19
PIECE = re.compile(r"\w+|[^\w\s]+")
ODD = 0x9E3779B97F4A7C15


class _Pieces(dict):
    def __missing__(self, piece: str) -> int:
        value = self[piece] = xxhash.xxh3_64_intdigest(piece)
        return value


_PIECES = _Pieces()


def _runs(hashes: np.ndarray, lag: int) -> np.ndarray:
    """Hashes of the runs in which a piece equals the one ``lag`` before it: that there is a long one, and log2 of the lengths."""
    edges = np.diff(np.concatenate(([0], (hashes[lag:] == hashes[:-lag]).astype(np.int8), [0])))
    lengths = np.flatnonzero(edges < 0) - np.flatnonzero(edges > 0)
    lengths = lengths[lengths >= LONG_RUN]
    levels = np.append(np.log2(lengths), 0)[: len(lengths) + bool(len(lengths))]
    return (levels.astype(np.uint64) + np.uint64(100 * lag)) * np.uint64(ODD)


def features(text: str) -> np.ndarray:
    """Hashes of the distinct features of a text."""
    found = PIECE.findall(text.lower())
    if len(_PIECES) > MEMO_WORDS:
        _PIECES.clear()
    hashes = np.fromiter(map(_PIECES.__getitem__, found), np.uint64, len(found))
    pairs = (hashes[:-1] * np.uint64(ODD)) ^ hashes[1:]
    parts = [hashes, pairs * np.uint64(ODD), *(_runs(hashes, lag) for lag in (1, 2) if len(hashes) > lag)]
    return np.unique(np.concatenate(parts))


def slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each feature in the first table, and in the second one, which lies behind it."""
    shift = np.uint64(64 - TABLE_BITS)
    return (hashes >> shift).astype(np.int64), ((hashes * np.uint64(ODD) ^ hashes) * np.uint64(ODD) >> shift).astype(np.int64) + (1 << TABLE_BITS)


def log_weight(hashes: np.ndarray, ratio: np.ndarray) -> float:
    a, b = (ratio[s] for s in slots(hashes))
    return float(np.where(a * b > 0, np.where(np.abs(a) < np.abs(b), a, b), 0.0).sum())


def _label_sample(labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted doc_ids and whether they are good; at most LABELS rows."""
    good = F.min(((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    rows = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("good"))
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELS).toArrow()
    ids, good = found.column("doc_id").to_numpy(), found.column("good").to_numpy()
    order = np.argsort(ids)
    return ids[order], good[order].astype(np.int8)


def _label_of(ids: np.ndarray, good: np.ndarray, doc_ids: list) -> list[int]:
    """1 good, 0 bad, -1 without label."""
    wanted = np.array([-(1 << 63) if d is None else d for d in doc_ids], np.int64)
    at = np.minimum(np.searchsorted(ids, wanted), max(0, len(ids) - 1))
    return np.where(ids[at] == wanted, good[at], -1).tolist() if len(ids) else [-1] * len(wanted)


def log_ratios(raw: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The shrunken log ratio of each slot; the last slot holds the numbers of documents."""
    (raw, n), (good, n_good), (bad, n_bad) = ((np.maximum(x[:-1], 0), x[-1]) for x in (raw, good, bad))
    if n_good <= 0 or n_bad <= 0:
        return np.zeros(len(raw), np.float32)
    ratio = np.log((good + 1) / (raw * (n_good / n) + 1))
    usual = (good + bad) * (n_good / (n_good + n_bad))
    unusual = good + bad - usual
    deviance = 2 * sum(x * np.log(np.maximum(x, 1) / np.where(x > 0, e, 1)) for x, e in ((good, usual), (bad, unusual)))
    counts = (np.abs(ratio) > np.log(RATIO)) & (ratio * (good - usual) > 0) & (deviance > EVIDENCE)
    return np.where(counts, ratio * (1 - EVIDENCE / np.where(counts, deviance, 1)), 0).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Log ratios of the feature slots, and the label sample.  2^(TABLE_BITS + 1) counts reach the driver, whatever the corpus.

    The rows of the ratios are by label: for bad and good documents, from whose counts one such document is taken off, and for others.
    """
    sample = docs.sparkSession.sparkContext.broadcast(_label_sample(labels))
    size = 2 << TABLE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good, bad = np.zeros((3, size + 1), np.int64)  # the last slot counts documents
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), _label_of(*sample.value, batch.column(0).to_pylist()), strict=True):
                both = slots(features(text))
                for counts in ((raw, bad), (raw, good), (raw,))[label]:
                    for own in both:
                        counts[own] += 1
                    counts[size] += 1
        at = np.flatnonzero(raw)
        columns = [pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in (raw, good, bad))]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "raw", "good", "bad"])

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "slot int, raw long, good long, bad long")
    found = rows.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("raw", "good", "bad"))).toArrow()
    counts = np.zeros((3, size + 1))
    counts[:, found.column("slot").to_numpy()] = [found.column(c).to_numpy() for c in ("raw", "good", "bad")]
    raw, good, bad = counts
    return np.stack([log_ratios(raw - 1, good, bad - 1), log_ratios(raw - 1, good - 1, bad), log_ratios(raw, good, bad)]), sample.value


def scored(docs: DataFrame, ratio: np.ndarray, labels: tuple[np.ndarray, np.ndarray], columns: tuple[str, ...]) -> DataFrame:
    """The named columns as the struct ``kept``, log_weight, noise (standard Gumbel, by id and text) and label (1, 0, or -1 for none)."""
    shared = docs.sparkSession.sparkContext.broadcast((ratio, labels))
    rows = docs.select(F.struct(*columns).alias("kept"), F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, labels = shared.value
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            marks = _label_of(*labels, ids)
            weight = [log_weight(features(t), ratio[label]) for t, label in zip(texts, marks, strict=True)]
            draws = np.array([xxhash.xxh3_64_intdigest(f"{i}\0{t}", seed=7) for i, t in zip(ids, texts, strict=True)], np.uint64)
            noise = -np.log(-np.log(((draws >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)))
            extra = [pa.array(weight, pa.float64()), pa.array(noise, pa.float64()), pa.array(marks, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), *extra], names=["kept", "log_weight", "noise", "label"])

    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, log_weight double, noise double, label int")


def best_cut(scores: DataFrame) -> float:
    """The log weight that separates labelled good from labelled bad best, in the middle of the gap between them.

    Weights are rounded to 0.05, so the rows are few.
    """
    rows = scores.where("label >= 0").groupBy(F.round(F.greatest("log_weight", F.lit(-100.0)) * 20).alias("w"), "label").count().toArrow().to_pylist()
    total = {x: sum(r["count"] for r in rows if r["label"] == x) for x in (0, 1)}
    if not total[0] or not total[1]:
        return -np.inf
    kept, best = {0: 0, 1: 0}, (-1.0, 0.0)
    levels = sorted({r["w"] for r in rows}, reverse=True)
    for w, lower in zip(levels, [*levels[1:], levels[-1] - 1], strict=True):
        for r in rows:
            if r["w"] == w:
                kept[r["label"]] += r["count"]
        best = max(best, (kept[1] / total[1] - kept[0] / total[0], (w + lower) / 40))
    return best[1]


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest ``key`` (k >= 1), by histograms that are refined until the bin holds one value."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low < high:
        width = (high - low) / BINS
        bin_of = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        bins = keys.where(F.col("key").between(low, high)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in sorted(bins.toArrow().to_pylist(), key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return low



def _key():
    return F.col("log_weight") + TEMPERATURE * F.col("noise")


def _selection(docs: DataFrame, labels: DataFrame):
    """The fitted ratios, the label sample, the scores of all documents, and the smallest key that is kept."""
    ratio, sample = fit(docs, labels)
    scores = cut_lineage(scored(docs, ratio, sample, ("doc_id",)).select("kept.doc_id", "log_weight", "label", _key().alias("key")), "scores")
    k = scores.where(F.col("log_weight") >= best_cut(scores)).count()
    return ratio, sample, scores, kth_largest(scores, k) if k else np.inf


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled documents, all columns as they are."""
    ratio, sample, _, least = _selection(docs, labels)
    return scored(docs, ratio, sample, tuple(docs.columns)).where(_key() >= least).select("kept.*")


@query("op7_importance_resampling")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its log weight, its key and whether it is sampled."""
    _, _, scores, least = _selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "log_weight", "key", (F.col("key") >= least).alias("kept"))
