"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves a whole pre-token in one probe.  Tier 2: a pre-token that is no entry is
merged on a linked list of byte spans whose adjacent pairs wait in a heap by (rank, position); the rank of a pair of tokens comes from
a table of all ways to split a token into two.  The rank file is read on the driver and broadcast: its size is that of the vocabulary, whatever the corpus.

Edge cases: a null text is an empty text, which has no tokens; white space, control characters and broken words are ordinary bytes; a
run of any length is merged in O(n log n); repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table, whole_text

MEMO_ENTRIES = 1 << 18  # pre-tokens a worker remembers; only time depends on it
CHUNK = 1 << 16  # pre-tokens of a long text handled at once
LONG_TEXT = 1 << 20
KEYS_PER_BUCKET = 2


WORD = 0xFFFFFFFFFFFFFFFF
STEP = 0x9E3779B97F4A7C15


def _slot(low: int, high: int, shift: int, size: int) -> int:
    return (((high ^ (shift * STEP & WORD)) * (low | 1) & WORD) >> 20) % size


def _hashes(key: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(key)
    return value & WORD, value >> 64


class MinimalPerfectHash:
    """key -> value for a fixed set of n byte strings, in n slots and one displacement per bucket."""

    def __init__(self, entries: dict[bytes, int]):
        n = len(entries)
        self.size, self.buckets = n, max(1, n // KEYS_PER_BUCKET)
        self.displacements = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        grouped: dict[int, list[tuple[int, int, bytes]]] = {}
        for key in entries:
            low, high = _hashes(key)
            grouped.setdefault(low % self.buckets, []).append((low, high, key))
        free = np.ones(n, bool)
        for bucket, members in sorted(grouped.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                break  # single keys take the slots that are left, in order
            shift = 0
            while True:
                slots = [_slot(low, high, shift, n) for low, high, _ in members]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                shift += 1
            self.displacements[bucket] = shift
            for slot, (_, _, key) in zip(slots, members, strict=True):
                free[slot], self.keys[slot], self.values[slot] = False, key, entries[key]
        left = iter(np.flatnonzero(free).tolist())
        for bucket, members in sorted(grouped.items()):
            if len(members) == 1:
                slot, key = next(left), members[0][2]
                self.displacements[bucket] = -slot - 1
                self.keys[slot], self.values[slot] = key, entries[key]

    def get(self, key: bytes) -> int:
        """The value of the key, -1 if it is none of the set."""
        low, high = _hashes(key)
        shift = self.displacements[low % self.buckets]
        slot = -shift - 1 if shift < 0 else _slot(low, high, shift, self.size)
        return self.values[slot] if self.keys[slot] == key else -1


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.digest = xxhash.xxh3_64_intdigest(repr((sorted(ranks.items()), pattern)).encode())
        self.lookup = MinimalPerfectHash(ranks)
        self.pattern = pattern
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None:
                    self.pairs[left << 32 | right] = rank

    @staticmethod
    def read(path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.lookup.get(piece)
        return [whole] if whole >= 0 else self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        """Spans are named by their first byte; ``end`` links them forward and ``before`` back, ``ids`` has their tokens.

        A heap entry is one integer: rank, first byte of the left span, end of the right span.
        """
        n, rank, push, pop = len(piece), self.pairs.get, heapq.heappush, heapq.heappop
        bits = n.bit_length()
        high, mask = 2 * bits, (1 << bits) - 1
        ids = list(map(self.single.__getitem__, piece))
        end, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [r << high | i << bits | i + 2 for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            start, stop = entry >> bits & mask, entry & mask
            middle = end[start]
            if middle >= stop or end[middle] != stop:
                continue  # one of the two has been merged since
            merged = ids[start] = entry >> high
            end[start], end[middle] = stop, n + 1
            if stop < n:
                before[stop] = start
                if (r := rank(merged << 32 | ids[stop])) is not None:
                    push(heap, r << high | start << bits | end[stop])
            left = before[start]
            if left >= 0 and (r := rank(ids[left] << 32 | merged)) is not None:
                push(heap, r << high | left << bits | stop)
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = end[at]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Memo(dict):
    """Pre-token -> its ids as little-endian bytes, filled through the two tiers; the last two generations are kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.encode, self.older = vocabulary.encode_piece, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.encode(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()


_MEMOS: dict[int, _Memo] = {}  # one per vocabulary; a worker that runs several tasks goes on with it


def _pieces(pattern, text: str) -> Iterator[list[str]]:
    if len(text) < LONG_TEXT:
        yield pattern.findall(text)
    else:
        matches = (m[0] for m in pattern.finditer(text))
        while part := list(islice(matches, CHUNK)):
            yield part


def encode_batches(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, decoded: bool, memo: _Memo) -> Iterator[pa.RecordBatch]:
    """The columns before the text as they come, ids, and with ``decoded`` the bytes that the ids stand for."""
    pattern = regex.compile(vocabulary.pattern)
    for batch in batches:
        flat, back = [], []
        for value in batch.column(batch.num_columns - 1):
            parts = []
            for part in _pieces(pattern, value.as_py() or ""):
                parts.append(b"".join(map(memo.__getitem__, part)))
                memo.trim()
            ids = np.frombuffer(b"".join(parts), "<u4")
            flat.append(ids)
            if decoded:
                back.append(vocabulary.decode(ids.tolist()))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in flat], dtype=np.int64))).astype(np.int32)
        values = pa.array((np.concatenate(flat) if flat else np.empty(0)).astype(np.int32))
        columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.ListArray.from_arrays(pa.array(offsets), values)]
        names = [*batch.schema.names[:-1], "ids"]
        if decoded:
            columns.append(pa.array(back, pa.binary()))
            names.append("decoded")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """key, ids array<int>, and on demand the decoded bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(key, whole_text(text).alias("text"))
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>" + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _MEMOS.setdefault(shared.value.digest, _Memo(shared.value))
        return encode_batches(batches, shared.value, decoded, memo)

    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@lru_cache(maxsize=2)
def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path(name), public_tokenizers.PATTERN)


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), public_vocabulary(), decoded=True))
