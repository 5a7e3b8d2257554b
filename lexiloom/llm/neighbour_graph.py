"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node, which keeps the smallest of its ids that any answer can need.  For the graph, vectors are divided by the
largest norm and get one more component that makes all norms 1, so that a large inner product means near on the sphere whatever the
norms; they travel as half-precision numbers.  A first graph comes from buckets of random hyperplanes.  Each round then joins neighbours
of neighbours: a node's list has its neighbours and those that have it as theirs, the members' vectors are joined to it, and every pair
of members of which one is new goes to both as a candidate if it is better than the worst that is held.  Rounds end when few
neighbours are new.

The graph is written bucketed by node, with the neighbours' vectors, so that a search moves only its own rows.  A query holds a beam of
the best nodes seen; each step expands the best ones not yet expanded, until none is left.  It begins at the nearest of a fixed number of
sampled nodes, and at its own node if it is in the table.  What the beam holds within the error of half precision of the last
answer is scored anew in double precision on the original vectors.

Edge cases: rows without vec_id, and vectors that are null, empty, zero, of another length than most, or hold a null or a number that
is not finite, take no part; rows equal in vec_id and vector count once; rows that share a query's vec_id are not its candidates; ties go
to the smaller vec_id; fewer candidates than asked for are all returned; an empty table gives no rows; extra columns are ignored.
A list takes all neighbours of its node and a hashed sample of those that point to it; a bucket above its size is cut by a hash: both
only shape the graph.  Norms that differ by more than about 10^3 leave the small vectors without precision in the graph.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import query, table

SMALL_CLASS = 4096  # rows of one vector that are ordered in one place
LISTS = 256  # lists of one batch that a task opens at a time: each holds up to thousands of pairs
HALF_ERROR = 2.0**-9  # of an inner product of unit vectors in half precision, with room to spare


@dataclass(frozen=True)
class Settings:
    degree: int = 32  # neighbours of a node
    tables: int = 4  # hyperplane tables of the first graph
    bucket: int = 400  # nodes of a bucket
    first: int = 24  # neighbours that a bucket gives a node
    rounds: int = 8
    settled: float = 0.05  # share of new neighbours at which rounds end
    beam: int = 320
    expand: int = 80  # nodes of a beam expanded in a step
    entries: int = 1024  # sampled nodes, at the nearest of which queries begin
    seed: int = 7


# ---- nodes


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): the rows that take part, vectors as doubles."""
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above all numbers
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).select("n")
    return rows.join(F.broadcast(usual), F.size("vec") == F.col("n"), "left_semi")


def _smallest_ids(rows: DataFrame, keep: int) -> DataFrame:
    """(digest, ids): the ``keep`` smallest ids of each vector.  A vector with many rows is thinned in salted groups first."""
    small = max(SMALL_CLASS, 4 * keep)  # salted groups of more than twice ``keep`` rows on average: each pass leaves half at most
    while True:
        counts = rows.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > small)
        if counts.limit(1).count() == 0:
            return rows.groupBy("digest").agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"))
        salted = rows.join(counts, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("n", F.lit(1)) / small)))
        order = Window.partitionBy("digest", "salt").orderBy("id")
        rows = cut_lineage(salted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).select("digest", "id"), "smallest-ids")


def nodes_of(keyed: DataFrame, keep: int) -> DataFrame:
    """(node, digest, ids, vec): one row per distinct vector of (id, vec, digest)."""
    ids = _smallest_ids(keyed.select("digest", "id").distinct(), keep)
    vectors = keyed.groupBy("digest").agg(F.min_by("vec", "id").alias("vec"))
    return cut_lineage(ids.join(vectors, "digest").withColumn("node", F.monotonically_increasing_id()), "nodes")


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind).reshape(len(column), -1) if len(column) else np.empty((0, 0), kind)


def _halves(column: pa.Array) -> np.ndarray:
    """Binary half-precision vectors as single-precision rows."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), "<f2").astype(np.float32).reshape(n, -1) if n else np.empty((0, 0), np.float32)


def _binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.strides[0] if len(matrix) else 0
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())])


def on_sphere(vectors: np.ndarray, largest: float, query_side: bool = False) -> np.ndarray:
    """Half-precision unit vectors; a query's own last component is 0, so its product with a node is the scaled inner product."""
    scaled = vectors / largest
    squared = (scaled * scaled).sum(axis=1)
    last = np.zeros(len(scaled)) if query_side else np.sqrt(np.maximum(0, 1 - squared))
    return np.column_stack((scaled, last)).astype("<f2")


def points_of(nodes: DataFrame, largest: float) -> DataFrame:
    """(node, half)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), _binary(on_sphere(_matrix(batch.column(1), np.float64), largest))], names=["node", "half"])

    return cut_lineage(nodes.select("node", "vec").mapInArrow(run, "node long, half binary"), "points")


# ---- the graph


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, in no order."""
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def first_candidates(points: DataFrame, n: int, how: Settings) -> DataFrame:
    """(u, v, score) of nodes that share a bucket of hyperplanes."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / how.bucket)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _halves(batch.column("half"))
            for t in range(how.tables if len(batch) else 0):
                planes = np.random.default_rng((how.seed, t)).standard_normal((vectors.shape[1], bits)).astype(np.float32)
                place = ((vectors @ planes) > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(vectors))
                key = pa.array((t << 40) + place.astype(np.int64))
                yield pa.RecordBatch.from_arrays([key, batch.column("node"), batch.column("half")], names=["place", "node", "half"])

    def pairs(group: pa.Table) -> pa.Table:
        own, vectors = group.column("node").to_numpy(), _halves(group.column("half"))
        if len(own) < 2:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "score": pa.array([], pa.float32())})
        scores = vectors @ vectors.T
        np.fill_diagonal(scores, -np.inf)
        best = _best(scores, min(how.first, len(own) - 1))
        return pa.table({"u": np.repeat(own, best.shape[1]), "v": own[best.ravel()], "score": np.take_along_axis(scores, best, 1).ravel()})

    placed = points.select("node", "half").mapInArrow(run, "place long, node long, half binary")
    counts = placed.groupBy("place").agg(F.count("*").alias("n"))
    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (2 * how.bucket)))
    return placed.join(counts, "place").withColumn("cut", cut).select("place", "cut", "node", "half").groupBy("place", "cut").applyInArrow(pairs, "u long, v long, score float")


GRAPH = "u long, near array<long>, scores array<float>, fresh array<boolean>"


def _segments(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements."""
    lists = batch.column(column)
    lengths = lists.value_lengths().fill_null(0).to_numpy()
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten()


def _kept(row: np.ndarray, rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of elements sorted by row: whether each is among its row's first ``most``; and how many each row keeps."""
    held = np.bincount(row, minlength=rows)
    place = np.arange(len(row)) - (np.cumsum(held) - held)[row]
    return place < most, np.minimum(held, most)


def _cut(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a fixed number of rows, so that memory does not follow the size of a batch."""
    most = most or LISTS
    for batch in batches:
        for low in range(0, len(batch), most):
            yield batch.slice(low, most)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))


def merged(candidates: DataFrame, degree: int) -> DataFrame:
    """The graph of the best candidates; candidates: (u, v, score, held), held true for neighbours of the graph before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            row, found = _segments(batch, "found")
            v, score, held = (found.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.lexsort((~held, v, row))  # of one node twice, the one that was held before
            row, v, score, held = row[order], v[order], score[order], held[order]
            again = np.zeros(len(row), bool)
            again[1:] = (row[1:] == row[:-1]) & (v[1:] == v[:-1])
            row, v, score, held = row[~again], v[~again], score[~again], held[~again]
            order = np.lexsort((v, -score, row))
            row, v, score, held = row[order], v[order], score[order], held[order]
            keep, counts = _kept(row, len(batch), degree)
            yield pa.RecordBatch.from_arrays([batch.column("u"), *(_lists(counts, x[keep]) for x in (v, score, ~held))], names=["u", "near", "scores", "fresh"])

    grouped = candidates.groupBy("u").agg(F.collect_list(F.struct("v", "score", "held")).alias("found"))
    return cut_lineage(grouped.mapInArrow(run, GRAPH), "graph")


def edges_of(graph: DataFrame) -> DataFrame:
    """(u, v, score, fresh)"""
    return graph.select("u", F.explode(F.arrays_zip("near", "scores", "fresh")).alias("e")).select("u", F.col("e.near").alias("v"), F.col("e.scores").alias("score"), F.col("e.fresh").alias("fresh"))


def improved(graph: DataFrame, points: DataFrame, how: Settings, step: int) -> DataFrame:
    """One round of NN-descent."""
    edges = edges_of(graph).select("u", "v", "fresh")
    pointing = edges.groupBy("v").agg(F.count("*").alias("n"))
    drawn = F.pmod(F.xxhash64("u", "v", F.lit(step)), F.lit(1 << 20)) * F.col("n") < F.lit(how.degree << 20)
    back = edges.join(pointing, "v").where(drawn).select(F.col("v").alias("m"), F.col("u").alias("member"), "fresh")
    lists = edges.select(F.col("u").alias("m"), F.col("v").alias("member"), "fresh").union(back)
    lists = lists.groupBy("m").agg(F.collect_set(F.struct("member", "fresh")).alias("members"))
    lists = lists.where(F.exists("members", lambda x: x["fresh"])).select("m", F.explode("members").alias("x")).select("m", F.col("x.member").alias("node"), F.col("x.fresh").alias("fresh"))
    worst = graph.select(F.col("u").alias("node"), F.when(F.size("scores") >= how.degree, F.element_at("scores", -1)).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
    known = points.join(worst, "node")
    local = lists.join(known, "node").groupBy("m").agg(F.collect_list(F.struct("node", "fresh", "worst", "half")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            row, found = _segments(batch, "members")
            node, fresh, worst = (found.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            vectors, out = _halves(found.field(3)), []
            borders = np.searchsorted(row, np.arange(len(batch) + 1))
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                scores = vectors[a:b] @ vectors[a:b].T
                good = (scores > worst[a:b, None]) & (fresh[a:b, None] | fresh[a:b]) & (node[a:b, None] != node[a:b])
                i, j = np.nonzero(good)
                out.append((node[a:b][i], node[a:b][j], scores[i, j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["u", "v", "score"])

    found = local.select("members").mapInArrow(run, "u long, v long, score float").withColumn("held", F.lit(False))
    return merged(edges_of(graph).select("u", "v", "score", F.lit(True).alias("held")).union(found), how.degree)


@dataclass(frozen=True)
class Index:
    """rows: (id, vec, digest); nodes: (node, digest, ids, vec); points: (node, half); name: the table (node, near, halves), bucketed by node."""

    rows: DataFrame
    nodes: DataFrame
    points: DataFrame
    name: str
    largest: float

    def graph(self) -> DataFrame:
        return self.rows.sparkSession.table(self.name)

    def drop(self) -> None:
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, near, halves): the vectors of a node's neighbours as one value, which is a slice of the values that came."""
    for batch in batches:
        lists = batch.column("x")
        flat = lists.flatten()
        near, half = flat.field(0), flat.field(1)
        counts = lists.value_lengths().to_numpy()
        _, offsets, data = half.buffers()
        ends = np.frombuffer(offsets, np.int32)[half.offset : half.offset + len(half) + 1] if len(half) else np.zeros(1, np.int32)
        cuts = ends[np.concatenate(([0], np.cumsum(counts)))]
        halves = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(cuts.astype(np.int32)), data])
        yield pa.RecordBatch.from_arrays([batch.column("u"), _lists(counts, near.to_numpy()), halves], names=["node", "near", "halves"])


def build(rows: DataFrame, keep: int, how: Settings = Settings()) -> Index | None:
    """The index of (id, vec) rows; None where there are none.  keep: one more than the most answers that a search will ask for."""
    spark = rows.sparkSession
    keyed = cut_lineage(rows.withColumn("digest", F.md5(F.to_json("vec"))), "vectors")
    nodes = nodes_of(keyed, keep)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    size, largest = nodes.agg(F.count("*"), F.max(norm)).first()
    if not size:
        return None
    points = points_of(nodes, largest)
    graph = merged(first_candidates(points, size, how).withColumn("held", F.lit(False)), how.degree)
    for step in range(how.rounds):
        new, held = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("fresh"))).first()
        if not new or new < how.settled * held:
            break
        graph = improved(graph, points, how, step)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = edges_of(graph).select("u", F.col("v").alias("node")).join(points, "node").groupBy("u").agg(F.collect_list(F.struct("node", "half")).alias("x"))
    name = f"neighbour_graph_{uuid.uuid4().hex}"
    laid_out = near.mapInArrow(_laid_out, "node long, near array<long>, halves binary")
    laid_out.repartition(width, "node").write.bucketBy(width, "node").sortBy("node").saveAsTable(name)
    return Index(keyed, nodes, points, name, largest)


# ---- search

STATE = "query long, half binary, beam array<long>, scores array<float>, done array<boolean>, front array<long>"


def _advance(how: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Beams merged with what was found; the best nodes not yet expanded become the next front and count as expanded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            row, beam = _segments(batch, "beam")
            own = beam.to_numpy(), batch.column("scores").flatten().to_numpy(), batch.column("done").flatten().to_numpy(zero_copy_only=False)
            from_row, found = _segments(batch, "found")  # one element per expanded node
            near, score = found.field(0), found.field(1)
            from_row = np.repeat(from_row, near.value_lengths().to_numpy())
            more = near.flatten().to_numpy(), score.flatten().to_numpy(), np.zeros(len(from_row), bool)
            row = np.concatenate((row, from_row))
            node, score, done = (np.concatenate(x) for x in zip(own, more, strict=True))
            done = done.astype(bool)
            order = np.lexsort((~done, node, row))
            row, node, score, done = row[order], node[order], score[order], done[order]
            once = np.ones(len(row), bool)
            once[1:] = (row[1:] != row[:-1]) | (node[1:] != node[:-1])
            row, node, score, done = row[once], node[once], score[once], done[once]
            order = np.lexsort((node, -score, row))
            row, node, score, done = row[order], node[order], score[order], done[order]
            keep, counts = _kept(row, len(batch), how.beam)
            row, node, score, done = row[keep], node[keep], score[keep], done[keep]
            waiting = np.flatnonzero(~done)
            first, fronts = _kept(row[waiting], len(batch), how.expand)
            taken = waiting[first]
            done[taken] = True
            columns = [batch.column("query"), batch.column("half"), *(_lists(counts, x) for x in (node, score.astype(np.float32), done)), _lists(fronts, node[taken])]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "half", "beam", "scores", "done", "front"])

    return run


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, near, scores): the neighbours of a front node that can enter the beam."""
    for batch in batches:
        near, scores, counts = [], [], []
        for half, halves, worst, ids in zip(*(batch.column(c) for c in ("half", "halves", "worst", "near")), strict=True):
            own = np.frombuffer(half.as_buffer(), "<f2").astype(np.float32)
            found = np.frombuffer(halves.as_buffer(), "<f2").astype(np.float32).reshape(-1, len(own)) @ own
            better = found > worst.as_py()
            near.append(ids.values.to_numpy()[better])
            scores.append(found[better])
            counts.append(len(scores[-1]))
        if counts:
            yield pa.RecordBatch.from_arrays([batch.column("query"), _lists(counts, np.concatenate(near)), _lists(counts, np.concatenate(scores))], names=["query", "near", "scores"])


def _step(state: DataFrame, places: DataFrame, how: Settings) -> DataFrame:
    """The states after their fronts met the places (node, near, halves)."""
    worst = F.when(F.size("scores") >= how.beam, F.element_at("scores", -1)).otherwise(F.lit(float("-inf"))).cast("float")
    front = state.select("query", "half", worst.alias("worst"), F.explode("front").alias("node"))
    met = front.join(places, "node").select("query", "half", "worst", "near", "halves").mapInArrow(_expanded, "query long, near array<long>, scores array<float>")
    found = met.groupBy("query").agg(F.collect_list(F.struct("near", "scores")).alias("found"))
    none = F.array().cast("array<struct<near:array<bigint>,scores:array<float>>>")
    both = state.join(found, "query", "left").select("query", "half", "beam", "scores", "done", F.coalesce("found", none).alias("found"))
    return cut_lineage(both.mapInArrow(_advance(how), STATE), "search")


def search(index: Index, queries: DataFrame, how: Settings = Settings()) -> DataFrame:
    """(query, beam, scores) of queries (query, vec, start): the best nodes found with their approximate scores, best first.

    query: a distinct number per row; start: the nodes at which it begins.
    """
    largest = index.largest

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                half = _binary(on_sphere(_matrix(batch.column("vec"), np.float64), largest, query_side=True))
                yield pa.RecordBatch.from_arrays([batch.column("query"), half, batch.column("start")], names=["query", "half", "front"])

    begun = queries.select("query", "vec", "start").mapInArrow(begin, "query long, half binary, front array<long>")
    empty = {"beam": "array<long>", "scores": "array<float>", "done": "array<boolean>"}
    state = begun.select("query", "half", *(F.array().cast(kind).alias(c) for c, kind in empty.items()), "front")
    state = _step(state, index.points.select("node", F.array("node").alias("near"), F.col("half").alias("halves")), how)
    while state.where(F.size("front") > 0).limit(1).count():
        state = _step(state, index.graph(), how)
    return state.select("query", "beam", "scores")


def entries(index: Index, queries: DataFrame, how: Settings = Settings(), most: int = 8) -> DataFrame:
    """queries (query, vec) with ``start``: the nearest of a fixed number of sampled nodes.  The sample is sent to all tasks."""
    sample = index.nodes.orderBy(F.xxhash64("node")).limit(how.entries).select("node", "vec").toArrow()
    node, vectors = sample.column("node").to_numpy(), _matrix(sample.column("vec").combine_chunks(), np.float64)
    shared = queries.sparkSession.sparkContext.broadcast((node, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, vectors = shared.value
        for batch in batches:
            if len(batch):
                best = _best(_matrix(batch.column("vec"), np.float64) @ vectors.T, most)
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("vec"), _lists(np.full(len(best), best.shape[1]), node[best.ravel()])], names=["query", "vec", "start"])

    return queries.select("query", "vec").mapInArrow(run, "query long, vec array<double>, start array<long>")


def answers(index: Index, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of queries (query, query_id, vec): exact scores of what was found, a query's own id left out."""
    last = F.element_at("scores", F.least(F.size("scores"), F.lit(k + 1)))  # its own node may hold a place
    near = F.filter(F.arrays_zip("beam", "scores"), lambda x: x["scores"] >= F.col("last") - HALF_ERROR)
    pairs = found.where(F.size("beam") > 0).withColumn("last", last).select("query", F.explode(near).alias("x")).select("query", F.col("x.beam").alias("node"))
    both = pairs.join(index.nodes.select("node", "ids", F.col("vec").alias("other")), "node").join(queries.select("query", "query_id", "vec"), "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                score = (_matrix(batch.column("vec"), np.float64) * _matrix(batch.column("other"), np.float64)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("query_id"), batch.column("ids"), pa.array(score)], names=["query", "query_id", "ids", "score"])

    scored = both.select("query", "query_id", "ids", "vec", "other").mapInArrow(run, "query long, query_id long, ids array<long>, score double")
    rows = scored.select("query", "query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int, k: int, how: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row whose id is divisible by ``every``."""
    index = build(usable(rows, key, vector), k + 1, how)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = index.rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "digest").distinct()
    queries = own.join(index.nodes, "digest").select(F.monotonically_increasing_id().alias("query"), "query_id", "vec", "node")
    queries = cut_lineage(queries, "queries")
    begun = entries(index, queries, how).join(queries.select("query", "node"), "query")
    begun = begun.select("query", "vec", F.array_distinct(F.concat("start", F.array("node"))).alias("start"))
    out = cut_lineage(answers(index, queries, search(index, begun, how), k), "answers")
    index.drop()
    return out


@query("op12_nn_descent")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 20, 20)
