"""Alignment of two tokenizers by their byte ranges, merged in lockstep.

Every document is encoded by a byte-level tokenizer A (space + text) and by a piece tokenizer B (text; it adds the space).  The tokens of
both cover the same bytes.  One NumPy state vector holds, for all lanes of a batch, the places of their A and B pointers; each step emits
the link of the two tokens that every lane looks at, advances the pointer whose token ends first, or both and a cut where they end
together, and drops the lanes that are done.  A lane is a document, or a part of a long one: texts are cut before a space between ASCII
letters or digits, where either tokenizer always begins a token, so a batch takes as many steps as its longest part has links.

How often a pair of ids is linked is counted in documents over the corpus.  The counts grow with the corpus, so they are a table.  Its
HOT_PAIRS most frequent pairs, which make up most links, are sent to all tasks (a fixed size); what is left meets the whole table in a
join, so no link is without its count, and no key of that join is one that many documents share.

Edge cases: null and empty texts, and texts whose tokens do not give their bytes back, have no tokens: all numbers are 0 and groups_sha256
is ''; strings of special tokens are plain text; repeated rows and rows without doc_id are documents of their own; an empty table gives no
rows; extra columns are ignored; a text of any length is read in parts, but one without any place to cut is one part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import query, table, whole_text

LANE = 1 << 9  # characters from which a text is cut
GROUP = 1 << 20  # characters merged at once
HOT_PAIRS = 1 << 17
B_BITS = 32  # a pair of ids is one number: A's id, then B's
CUT = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
AFTER_WORD = re.compile(rb"[0-9A-Za-z] ")


@dataclass(frozen=True)
class Tokenizers:
    """The two files, as text and bytes, and the pattern of A's pre-tokens; of fixed size, they go to the tasks as a broadcast."""

    a: str
    b: bytes
    pattern: str

    @staticmethod
    def public(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> Tokenizers:
        import public_tokenizers

        with open(public_tokenizers.path(a), encoding="utf-8") as first, open(public_tokenizers.path(b), "rb") as second:
            return Tokenizers(first.read(), second.read(), public_tokenizers.PATTERN)


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers loaded, with the bytes, lengths and decimal digits of every id."""

    def __init__(self, files: Tokenizers):
        import sentencepiece
        import tiktoken

        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        model, alphabet = json.loads(files.a)["model"], _byte_alphabet()
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of A are not in the order of its merges")
        special = {x["id"] for x in json.loads(files.a)["added_tokens"]}
        self.a_bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            if i not in special:
                self.a_bytes[i] = bytes(map(alphabet.__getitem__, token))
        # with ids in that order, A is the encoder by ranks, which takes a quarter of the time
        self.a = tiktoken.Encoding("a", pat_str=files.pattern, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if x}, special_tokens={})
        self.b_bytes = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        # a part may begin at a space only if no token of either goes on after a word into the next one
        self.cuts = not any(AFTER_WORD.search(x) for x in (*self.a_bytes, *self.b_bytes))
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.digits, self.widths = _decimals(max(len(self.a_bytes), len(self.b_bytes)))

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return list(map(self.a.encode_ordinary, texts))

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1 as bytes, left-aligned with room for one more byte, and their number."""
    text = [str(i).encode() for i in range(n)]
    width = max(map(len, text)) + 1
    return np.array(text, f"S{width}").view(np.uint8).reshape(n, width), np.array(list(map(len, text)), np.int64)


@lru_cache(maxsize=2)
def loaded(files: Tokenizers) -> Pair:
    return Pair(files)


def parts_of(text: str, cuts: bool = True) -> Iterator[tuple[str, bool]]:
    """The text in parts of about LANE characters, each but the first beginning with a space; joined they are the text."""
    at = 0
    while at < len(text):
        m = CUT.search(text, at + LANE) if cuts and len(text) - at > LANE else None
        end = m.start() if m else len(text)
        yield text[at:end], at == 0
        at = end


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, a_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links and cuts of all lanes: (A place, B place, whether both end there), in the order of steps.

    a_end, b_end: where every token ends in its lane's bytes; a_at, b_at: each lane's first places; a_stop: its place after the last A token.
    """
    at = np.stack((a_at, b_at))
    stop = a_stop
    live = at[0] < stop
    at, stop = at[:, live], stop[live]
    links_a, links_b, cuts = [], [], []
    while at.shape[1]:
        a, b = at
        ends_a, ends_b = a_end[a], b_end[b]
        links_a.append(a.copy())
        links_b.append(b.copy())
        cuts.append(ends_a == ends_b)
        at[0] += ends_a <= ends_b
        at[1] += ends_b <= ends_a
        live = at[0] < stop
        if not live.all():
            at, stop = at[:, live], stop[live]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *links_a]), np.concatenate([none, *links_b]), np.concatenate([none.astype(bool), *cuts])


def _ends(lengths: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Where tokens end, counted from the first byte of their lane; held: number of tokens of each lane."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
    return total[1:] - np.repeat(total[np.cumsum(held) - held], held)


def _rendered(pair: Pair, a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups as bytes ``a1,a2|b1;``, and where each group ends; groups are numbered from 0 without gaps."""
    n_groups = int(a_group[-1]) + 1 if len(a_group) else 0
    ids = np.concatenate((a_ids, b_ids))
    order = np.argsort(np.concatenate((2 * a_group, 2 * b_group + 1)), kind="stable")
    side = np.concatenate((2 * a_group, 2 * b_group + 1))[order]
    ids = ids[order]
    width = pair.widths[ids]
    cells = pair.digits[ids]  # a copy: one row per token
    last = np.append(side[1:] != side[:-1], True) if len(side) else np.zeros(0, bool)
    sign = np.where(~last, ord(","), np.where(side % 2 == 0, ord("|"), ord(";"))).astype(np.uint8)
    cells[np.arange(len(ids)), width] = sign
    kept = np.arange(cells.shape[1]) <= width[:, None]
    upto = np.cumsum(width + 1)
    return cells[kept], upto[np.flatnonzero(last & (side % 2 == 1))] if n_groups else np.zeros(0, np.int64)


class Aligned:
    """What is known of one text so far; its parts are added in order, so no text is held as tokens at once."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.same, self.digest, self.held = True, hashlib.sha256(), []

    def add(self, n_a: int, n_b: int, n_groups: int, groups: bytes, pairs: np.ndarray) -> None:
        self.digest.update(b";" + groups if self.n_groups else groups)
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups, self.n_links + len(pairs)
        self.held.append(np.unique(pairs, return_counts=True))
        if len(self.held) > 16:
            self.held = [self.pairs()]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct id pairs and how often each is linked."""
        if len(self.held) == 1:
            return self.held[0]
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ids, place = np.unique(np.concatenate([p for p, _ in self.held]), return_inverse=True)
        times = np.zeros(len(ids), np.int64)
        np.add.at(times, place, np.concatenate([n for _, n in self.held]))
        return ids, times


def _lanes(texts: list[str | None], pair: Pair) -> Iterator[list[tuple[int, str, bool]]]:
    """(text, part, whether it is the text's first) in groups of about GROUP characters."""
    group, held = [], 0
    for i, text in enumerate(texts):
        for part, first in parts_of(text or "", pair.cuts):
            group.append((i, part, first))
            held += len(part)
            if held >= GROUP:
                yield group
                group, held = [], 0
    if group:
        yield group


def align(texts: list[str | None], pair: Pair) -> list[Aligned]:
    """Tokens, groups and links of every text."""
    out = [Aligned() for _ in texts]
    for group in _lanes(texts, pair):
        _align_lanes([x for x in group if out[x[0]].same], pair, out)
    return [x if x.same else Aligned() for x in out]


def _align_lanes(group: list[tuple[int, str, bool]], pair: Pair, out: list[Aligned]) -> None:
    whole = [" " + part if first else part for _, part, first in group]
    a, b = pair.encode_a(whole), pair.encode_b([part if first else part[1:] for _, part, first in group])
    for (i, _, _), text, own_a, own_b in zip(group, whole, a, b, strict=True):
        raw = text.encode()
        if b"".join(map(pair.a_bytes.__getitem__, own_a)) != raw or b"".join(map(pair.b_bytes.__getitem__, own_b)) != raw:
            out[i].same = False
    lanes = [k for k, x in enumerate(group) if out[x[0]].same]
    if not lanes:
        return
    owner = np.array([group[k][0] for k in lanes], np.int64)
    a, b = [a[k] for k in lanes], [b[k] for k in lanes]
    n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
    a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
    a_at, b_at = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    a_end, b_end = _ends(pair.a_length[a_ids], n_a), _ends(pair.b_length[b_ids], n_b)
    link_a, link_b, cut = lockstep(a_end, b_end, a_at, b_at, a_at + n_a)

    a_last, b_last = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    a_last[link_a[cut]] = b_last[link_b[cut]] = True
    a_group, b_group = (np.cumsum(x) - x for x in (a_last, b_last))
    text, group_ends = _rendered(pair, a_ids, b_ids, a_group, b_group)
    text = text.tobytes()

    a_owner, b_owner = np.repeat(owner, n_a), np.repeat(owner, n_b)
    link_owner = a_owner[link_a]
    order = np.argsort(link_owner, kind="stable")
    pairs = (a_ids[link_a] << B_BITS | b_ids[link_b])[order]
    sums = (np.bincount(x, minlength=len(out)) for x in (a_owner, b_owner, a_owner[a_last], link_owner))
    link_at = group_at = byte_at = 0
    for i, (tokens_a, tokens_b, groups, links) in enumerate(zip(*(x.tolist() for x in sums), strict=True)):
        if links:
            end = int(group_ends[group_at + groups - 1])
            out[i].add(tokens_a, tokens_b, groups, text[byte_at : end - 1], pairs[link_at : link_at + links])
            link_at, group_at, byte_at = link_at + links, group_at + groups, end


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about GROUP characters."""
    for batch in batches:
        at = held = 0
        lengths = [len(v.as_buffer() or b"") for v in batch.column(column)]
        for i, n in enumerate(lengths):
            held += n
            if held >= GROUP or i == len(lengths) - 1:
                yield batch.slice(at, i + 1 - at)
                at, held = i + 1, 0


def linked(docs: DataFrame, files: Tokenizers) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs with times: the distinct id pairs and how often each is linked."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(files)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(shared.value)
        for batch in _groups(batches, 1):
            found = align(batch.column(1).to_pylist(), pair)
            distinct = [x.pairs() for x in found]
            offsets = pa.array(np.cumsum([0, *(len(p) for p, _ in distinct)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in distinct]), kind)) for k, kind in ((0, pa.int64()), (1, pa.int64()))]
            sums = [pa.array([getattr(x, n) for x in found], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
            digests = pa.array([x.digest.hexdigest() if x.n_a else "" for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums, digests, *lists], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return rows.mapInArrow(run, schema)


def _counted(links: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether no other pair of its A id has more.  Batches are added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    counts = links.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.withColumn("a", F.shiftright("pair", B_BITS)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row per id of the vocabulary
    return cut_lineage(counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-table")


def with_counts(links: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The rows of ``links`` with n_best and count_sum."""
    links = cut_lineage(links.withColumn("row", F.monotonically_increasing_id()), "links")
    counts = _counted(links)
    hot = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).orderBy("pair").toArrow()
    columns = [hot.column(c).to_numpy() for c in ("pair", "n", "best")]
    shared = links.sparkSession.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, best = shared.value
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            owner = np.repeat(np.arange(len(batch)), batch.column("pairs").value_lengths().to_numpy())
            place = np.minimum(np.searchsorted(ids, pairs), max(len(ids) - 1, 0))
            known = ids[place] == pairs if len(ids) else np.zeros(len(pairs), bool)
            place, mine, rare = place[known], owner[known], ~known
            sums = [np.zeros(len(batch), np.int64) for _ in range(2)]
            np.add.at(sums[0], mine, n[place] * times[known])
            np.add.at(sums[1], mine, best[place] * times[known])
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[rare], minlength=len(batch))))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[rare])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sums[0]), pa.array(sums[1]), *lists], names=["row", "count_sum", "n_best", "pairs", "times"])

    looked_up = links.select("row", "pairs", "times").mapInArrow(run, "row long, count_sum long, n_best long, pairs array<long>, times array<long>")
    looked_up = cut_lineage(looked_up, "looked-up")
    rare = looked_up.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    met = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    sums = looked_up.select("row", "count_sum", "n_best").union(met).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return links.drop("pairs", "times").join(sums, "row").drop("row")


def aligned(docs: DataFrame, files: Tokenizers | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    found = with_counts(linked(docs, files or Tokenizers.public()))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op11_lockstep_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
