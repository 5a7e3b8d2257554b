"""Document fingerprints as invertible Bloom lookup tables, in DataFrame operations only.

A text is the set of digests of its paragraphs, cut at sentence ends; longer pieces are cut at places that depend on their words.  A sketch has TABLES tables of cells; a digest
goes into one cell of each table, which holds a count, the XOR of its digests and the XOR of their check hashes.  Sketches subtract
cell by cell: what two versions share cancels, and peeling (a cell with one digest gives it away and frees the cells of the other
tables) recovers the digests in which they differ.  A sketch of the first size is peeled inside its row.  Peeling that gets stuck is repeated with a
larger sketch for those pairs only, as rows of cells, until every pair is solved.  The fingerprint is the sketch of the first size, as text.
What is stored on the way are digests; sketches are several times larger and made again where they are needed.

A document meets its edited version and its successor by doc_id.  Documents are cut into blocks at approximate quantiles of doc_id;
only the first text of each block travels to the block before it, so order costs one shuffle and no task holds more than a block.

Edge cases: null and empty texts are the empty set; two empty sets have likeness 1; rows with equal doc_id follow each other by a hash of
their text, in several blocks if they are many, rows without doc_id come first; a single row is its own successor; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import query, table, whole_text

PIECE_END = r"(?<=[.!?|;:])\s+|\n+"
LONG_PIECE = 256  # characters from which a piece is cut further, at places that its content gives
WORDS_PER_CUT = 8
LONG_WORD = r"(.{16,63}?[aeiou0-9аеиоуا\u3041-\u3096\u4E00-\u5FFF\uAC00-\uBFFF]|.{64})"
TABLES = 3
FIRST_CELLS = 8  # cells of each table of the fingerprint
LOAD = 0.7  # cells of each table per digest of either side, in the first retry
ROUNDS = 9
WORTH_PEELING = 5  # cells with one digest from which the first size is tried; with fewer it gets stuck
BLOCKS_PER_PARTITION = 4


def pieces(text: Column) -> Column:
    """Sorted distinct digests of the paragraphs and sentences of a text, long ones cut further."""
    parts = F.flatten(F.transform(F.split(text, PIECE_END), _cut))
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda p: F.length(p) > 0), lambda p: F.xxhash64(p))))


def _cut(piece: Column) -> Column:
    """A long piece is cut after every word of certain hashes, and a word as long as that after certain letters, so an edit leaves the other cuts."""

    def marked(word: Column) -> Column:
        long_word = F.regexp_replace(word, LONG_WORD, "$1\n")
        word = F.when(F.length(word) > LONG_PIECE, long_word).otherwise(word)
        return F.when(F.pmod(F.xxhash64(word), F.lit(WORDS_PER_CUT)) == 0, F.concat(word, F.lit("\n"))).otherwise(word)

    words = F.transform(F.split(piece, r"\s+"), marked)  # no line end is left in a piece
    return F.when(F.length(piece) <= LONG_PIECE, F.array(piece)).otherwise(F.split(F.array_join(words, " "), r"\n\s?"))


ID, TIE = "id_or_least", "tie"


def _blocks(docs: DataFrame) -> DataFrame:
    """The rows with a block number that does not fall in the order of doc_id and then of ``tie``, a hash of the text.

    Cuts are quantiles of doc_id, found in two levels.  An id that fills several blocks is cut further by the hash.
    """
    rows = docs.withColumns({ID: F.coalesce("doc_id", F.lit(-(1 << 63))), TIE: F.xxhash64("text")})
    count = BLOCKS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / count for i in range(1, count)]
    found = rows.agg(F.percentile_approx(ID, shares, 20 * count)).first()[0] or []
    cuts = sorted(set(found))
    if not cuts:
        return rows.withColumn("block", F.lit(0).cast("long"))
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    heads = F.array(*(F.lit(g[0]).cast("long") for g in groups))
    nested = F.array(*(F.array(*(F.lit(c).cast("long") for c in g)) for g in groups))
    outer = F.size(F.filter(heads, lambda c: c <= F.col(ID)))
    inner = F.size(F.filter(F.try_element_at(nested, outer), lambda c: c <= F.col(ID)))
    block = F.when(outer == 0, 0).otherwise((outer - 1) * width + inner).cast("long")
    parts = F.lit(1)
    for c in cuts:
        if (n := found.count(c)) > 1:
            parts = F.when(F.col(ID) == c, n).otherwise(parts)
    part = F.when(parts > 1, F.floor((F.col(TIE) / 2.0**64 + 0.5) * parts)).otherwise(count)  # ids after the one that is cut come last
    return rows.withColumn("block", block * (count + 1) + F.least(part, F.lit(count)).cast("long"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, own, next_text and following: the text that follows in the order of doc_id, then of a hash of the text, and the digests of
    both; the last row is followed by the first.

    The texts are shuffled once, with their digests.  The first row of each block is found by its numbers, which go to all tasks: a fixed number of blocks per
    partition.
    """
    rows = _blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")))
    least = rows.groupBy("block").agg(F.min(F.struct(ID, TIE)).alias("least")).select("block", f"least.{ID}", f"least.{TIE}")
    heads = rows.join(F.broadcast(least), ["block", ID, TIE]).groupBy("block").agg(F.min("text").alias("head"))
    order = Window.orderBy("block")  # one small row per block
    after = least.select("block", F.coalesce(F.lead("block").over(order), F.first("block").over(order)).alias("after"))
    follow = after.join(heads.withColumnRenamed("block", "after"), "after").select("block", "head", pieces(F.col("head")).alias("head_own"))
    inside = Window.partitionBy("block").orderBy(ID, TIE, "text")
    led = rows.withColumn("own", pieces(F.col("text"))).withColumns({"follow": F.lead("text").over(inside), "follow_own": F.lead("own").over(inside)})
    return led.join(F.broadcast(follow), "block").select(
        "doc_id", "text", "own", F.coalesce("follow", "head").alias("next_text"), F.coalesce("follow_own", "head_own").alias("following")
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as much of the following text as there is."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def _cell(key: Column, of_table: Column, seed: int, cells: Column) -> Column:
    return F.pmod(F.xxhash64(key, of_table, F.lit(seed)), cells)


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _peeled(cells: DataFrame, seed: int) -> DataFrame:
    """(id, side, differing, stuck): digests recovered from the difference sketch of each pair, and cells that are left.

    cells: (id, side, per_table, table, cell, count, key, check).  A round looks at one table, in which a digest has one cell only, so no
    digest is taken out twice.  What is recovered is counted, and its digests XORed, in a row of table -1.
    """
    names = ["id", "side", "per_table", "table", "cell", "count", "key", "check"]

    def row(of_table: Column, cell: Column, count: Column) -> Column:
        return F.struct(of_table.alias("table"), cell.cast("long").alias("cell"), count.cast("long").alias("count"), F.col("key"), F.col("check"))

    for i in range(ROUNDS):
        own = i % TABLES
        key, count, size = F.col("key"), F.col("count"), F.col("per_table")
        alone = (F.col("table") == own) & (F.abs(count) == 1) & (F.col("check") == _check(key)) & (F.col("cell") == _cell(key, F.lit(own), seed, size))
        taken = [row(F.lit(-1), F.lit(0), F.lit(1))]
        taken += [row(F.lit(t), _cell(key, F.lit(t), seed, size), -count) for t in range(TABLES) if t != own]
        same = row(F.col("table"), F.col("cell"), count)
        cells = (
            cells.select("id", "side", "per_table", F.explode(F.when(alone, F.array(*taken)).otherwise(F.array(same))).alias("r"))
            .select("id", "side", "per_table", "r.*")
            .groupBy("id", "side", "per_table", "table", "cell")
            .agg(F.sum("count").alias("count"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
            .where((F.col("count") != 0) | (F.col("key") != 0) | (F.col("check") != 0))
            .select(*names)
        )
    found = F.col("table") == -1
    return cells.groupBy("id", "side").agg(F.coalesce(F.sum(F.when(found, F.col("count"))), F.lit(0)).alias("differing"), F.count_if(~found).alias("stuck"))


def sketch(keys: Column) -> Column:
    """The sketch of the first size: an array of (count, key, check), table after table."""
    places = [F.lit(t) for t in range(TABLES)]
    placed = F.transform(keys, lambda k: F.struct(k.alias("key"), _check(k).alias("check"), *(_place(k, t).alias(f"c{i}") for i, t in enumerate(places))))
    none = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))

    def cell(all_placed: Column, of_table: int, number: Column) -> Column:
        def add(so_far: Column, p: Column) -> Column:
            more = F.struct((so_far["count"] + 1).alias("count"), so_far["key"].bitwiseXOR(p["key"]).alias("key"), so_far["check"].bitwiseXOR(p["check"]).alias("check"))
            return F.when(p[f"c{of_table}"] == number, more).otherwise(so_far)

        return F.aggregate(all_placed, none, add)

    # bound to a variable, so that the places are found once and not for every cell
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(FIRST_CELLS - 1).cast("long"))
    return F.transform(F.array(placed), lambda found: F.flatten(F.array(*(F.transform(numbers, _cell_maker(cell, found, t)) for t in range(TABLES)))))[0]


def _cell_maker(cell, found: Column, of_table: int):
    return lambda number: cell(found, of_table, number)


def _place(key: Column, of_table: Column) -> Column:
    return _cell(key, of_table, 0, F.lit(FIRST_CELLS)).cast("long")


def written(cells: Column) -> Column:
    """A sketch as text: its filled cells by number, with count, key and check."""
    shown = F.transform(cells, lambda c, i: F.when(c["count"] > 0, F.concat_ws(".", i.cast("string"), c["count"].cast("string"), F.hex(c["key"]), F.hex(c["check"]))))
    return F.concat(F.lit("iblt1:"), F.array_join(shown, ";"))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["count"] - y["count"]).alias("count"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def _differing(a: Column, b: Column) -> Column:
    """The number of digests in one of two sketches of the first size only, or null where peeling their difference gets stuck."""

    def solved(cells: Column) -> Column:
        single = F.size(F.filter(cells, lambda c: (F.abs(c["count"]) == 1) & (c["check"] == _check(c["key"]))))
        equal = F.forall(cells, lambda c: (c["count"] == 0) & (c["key"] == 0))
        return F.when(equal, F.lit(0).cast("long")).when(single >= WORTH_PEELING, _peeled_in_row(cells))

    return F.transform(F.array(subtracted(a, b)), solved)[0]


def _peeled_in_row(cells: Column) -> Column:
    """Like ``_peeled``, for the cells of one sketch of the first size: the number of digests, or null."""
    size = FIRST_CELLS
    none = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))

    def without(cell: Column, k: Column) -> Column:
        return F.struct((cell["count"] - k["count"]).alias("count"), cell["key"].bitwiseXOR(k["key"]).alias("key"), cell["check"].bitwiseXOR(k["check"]).alias("check"))

    def step(state: Column, turn: Column) -> Column:
        own = (turn % TABLES).cast("int")

        def alone(c: Column, i: Column) -> Column:
            return (F.abs(c["count"]) == 1) & (c["check"] == _check(c["key"])) & (_place(c["key"], own) == i)

        def taken_out(taken: Column) -> Column:
            def rest(c: Column, i: Column) -> Column:
                of_table = F.floor(i / size).cast("int")

                def less(so_far: Column, k: Column) -> Column:
                    return F.when(_place(k["key"], of_table) == i % size, without(so_far, k)).otherwise(so_far)

                return F.aggregate(taken, c, less)

            more = F.struct(F.transform(state["cells"], rest).alias("cells"), (state["found"] + F.size(taken)).alias("found"))
            return F.when(F.size(taken) == 0, state).otherwise(more)

        return F.transform(F.array(F.filter(F.slice(state["cells"], own * size + 1, size), alone)), taken_out)[0]

    start = F.struct(cells.alias("cells"), F.lit(0).cast("long").alias("found"))
    left = lambda state: F.exists(state["cells"], lambda c: (c["count"] != 0) | (c["key"] != 0) | (c["check"] != 0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda state: F.when(~left(state), state["found"]))


def _unsolved(versions: DataFrame) -> DataFrame:
    """(id, side, own, other) of the pairs that the first size leaves open: side 1 the edited version, side 2 the successor."""
    both = F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"differing{i}").isNull().alias("open"), F.col(name).alias("other")) for i, name in ((1, "changed"), (2, "following"))))
    return versions.select("id", "own", F.explode(F.filter(both, lambda p: p["open"])).alias("p")).select("id", "p.side", "own", "p.other")


def _difference_cells(pairs: DataFrame, attempt: int) -> DataFrame:
    """Cells of the subtracted sketches of pairs, ``attempt`` - 1 doublings larger than the first retry."""
    per_table = (F.ceil((F.size("own") + F.size("other")) * F.lit(LOAD * 2 ** (attempt - 1))) + 4).cast("long")
    signed = F.concat(F.transform("own", lambda k: F.struct(k.alias("key"), F.lit(1).cast("long").alias("sign"))), F.transform("other", lambda k: F.struct(k.alias("key"), F.lit(-1).cast("long").alias("sign"))))
    rows = pairs.repartition("id").select("id", "side", per_table.alias("per_table"), F.explode(signed).alias("d")).select("id", "side", "per_table", "d.*", F.explode(F.array(*map(F.lit, range(TABLES)))).alias("table"))
    rows = rows.withColumn("cell", _cell(F.col("key"), F.col("table"), attempt, F.col("per_table")))
    sums = rows.groupBy("id", "side", "per_table", "table", "cell").agg(F.sum("sign").alias("count"), F.bit_xor("key").alias("key"), F.bit_xor(_check(F.col("key"))).alias("check"))
    return sums.where((F.col("count") != 0) | (F.col("key") != 0))


def differences(versions: DataFrame) -> DataFrame:
    """(id, side, differing) of the pairs that the first size leaves open: the number of digests in one of the two only.

    The pairs that are tried again are few: they are written as numbers, so that Spark can send them to the digests.
    """
    pairs = left = _unsolved(versions)
    solved, attempt = [], 1
    while True:
        peeled = cut_lineage(_peeled(_difference_cells(left, attempt), attempt), "peeled")
        solved.append(peeled.where("stuck = 0").select("id", "side", "differing"))
        stuck = cut_lineage(peeled.where("stuck > 0").select("id", "side"), "stuck")
        if not stuck.limit(1).count():
            return reduce(DataFrame.union, solved)
        left = pairs.join(stuck, ["id", "side"], "left_semi")
        attempt += 1


def likeness(own: Column, other: Column, differing: Column) -> Column:
    """Shared over all digests of two sets with those sizes and that many digests in one of them only."""
    return F.when(own + other == 0, 1.0).otherwise((own + other - differing) / (own + other + differing))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    followed = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    sets = followed.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.unhex(F.sha2("edited", 256)).alias("edited_sha256"),
        "own",
        pieces(F.col("edited")).alias("changed"),
        "following",
    )
    sketches = sets.select("*", *(sketch(F.col(name)).alias(f"{name}_cells") for name in ("own", "changed", "following")))
    compared = sketches.select(
        F.monotonically_increasing_id().alias("id"),
        *sets.columns,
        _differing(F.col("own_cells"), F.col("changed_cells")).alias("differing1"),
        _differing(F.col("own_cells"), F.col("following_cells")).alias("differing2"),
    )
    # the successor's digests are this row's for the pairs that are still open only
    still = F.when(F.col("differing2").isNull(), F.col("following"))
    versions = cut_lineage(compared.withColumns({"n_following": F.size("following"), "following": still}), "versions")
    by_id = differences(versions).groupBy("id").agg(*(F.max(F.when(F.col("side") == i, F.col("differing"))).alias(f"later{i}") for i in (1, 2)))
    both = versions.drop("following").join(by_id, "id", "left")
    n_own = F.size("own")
    return both.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        written(sketch(F.col("own"))).alias("fingerprint"),
        written(sketch(F.col("changed"))).alias("edited_fingerprint"),
        likeness(n_own, F.size("changed"), F.coalesce("differing1", "later1")).alias("near_edited"),
        likeness(n_own, F.col("n_following"), F.coalesce("differing2", "later2")).alias("near_next"),
    )


@query("op8_invertible_sketch")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
