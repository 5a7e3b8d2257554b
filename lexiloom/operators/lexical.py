"""Exact-form statistics.

Counts are taken per line from the array of its lexical words, so most operators never explode
tokens; where forms become keys, the first shuffle carries (form, unit) partial sums, not tokens.
"""

from __future__ import annotations

from collections.abc import Sequence
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.text import (
    PRIMARY,
    Script,
    compare_words,
    lexical_words,
    nfc_each,
    nfc_maybe,
    pieces,
    token_class,
    tokens,
    utf16_length,
)


def token_occurrences(lines: DataFrame, script: Script = PRIMARY, release: str | None = None) -> DataFrame:
    """The token table: position, offsets in three units, exact and compare form, class.

    Pieces tile the line, so offsets are running sums, taken inside the row: no line or token moves.
    """
    columns = ["line_id", "text_unit_id", "source_work_id"]
    text = F.col("text")
    cut = lines.select(*columns, pieces(text).alias("pieces"), tokens(text).alias("tokens"), nfc_maybe(text).alias("maybe"))
    # in steps of their own: pieces and tokens are read twice, and cut once
    placed = cut.select(*columns, "tokens", "maybe", running_ends(F.col("pieces")).alias("ends"))
    formed = placed.select(*columns, "tokens", "ends", nfc_each(F.col("tokens"), F.col("maybe")).alias("forms"))
    # the outer form: Spark would make the arrays once more to ask whether they have items
    split = formed.select(*columns, F.posexplode_outer(F.arrays_zip("tokens", "ends", "forms")).alias("position", "p"))
    split = split.filter("position IS NOT NULL")
    rows = split.select(*columns, "position", "p.ends", F.col("p.tokens").alias("exact_form"), F.col("p.forms").alias("compare_form"))
    offsets = []
    for unit, measure in UNITS.items():
        end = F.col("ends")[unit]
        offsets += [(end - measure(F.col("exact_form"))).alias(f"start_{unit}"), end.alias(f"end_{unit}")]
    return rows.select(
        F.concat_ws(":", F.lit("occurrence"), "line_id", F.col("position").cast("string")).alias("occurrence_id"),
        *columns,
        "position",
        *offsets,
        "exact_form",
        "compare_form",
        token_class(F.col("exact_form"), script).alias("token_class"),
        F.lit(release).cast("string").alias("analysis_release_id"),
    )


UNITS = {"utf16": utf16_length, "cp": F.length, "byte": F.octet_length}


@F.arrow_udf(ArrayType(StructType([StructField(unit, IntegerType()) for unit in UNITS])))
def running_ends(items: pa.Array) -> pa.Array:
    """Where each of a line's pieces ends when they are put together, for a batch of lines: sums over its bytes."""
    flat, starts = items.flatten().cast(pa.large_string()), items.offsets.to_numpy()
    starts = starts - starts[0]
    cuts = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    before = np.repeat(cuts[starts[:-1]], np.diff(starts))
    # bytes that open a code point, and those that open one beyond the basic plane
    opened = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    wide = np.concatenate([[0], np.cumsum(data >= 0xF0)])
    ends = cuts[1:]
    cp = opened[ends] - opened[before]
    parts = [cp + wide[ends] - wide[before], cp, ends - before]
    rows = pa.StructArray.from_arrays([pa.array(part.astype(np.int32)) for part in parts], list(UNITS))
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), rows)


def _hits(words: Column, form: Column) -> Column:
    return F.size(F.filter(words, lambda w: w == form))


def rate(raw: Column, eligible: Column) -> Column:
    """Occurrences per ten thousand eligible tokens; null when there are none."""
    return F.try_divide(raw, eligible) * 10000


def exact_frequency(lines: DataFrame, form: str, script: Script = PRIMARY, zero_as_null: bool = False) -> DataFrame:
    """One row: raw count, distinct lines and units, eligible tokens, rate."""
    counted = lines.select(
        "text_unit_id", F.col("text").alias("t"), compare_words(F.col("text"), script).alias("w")
    ).select("text_unit_id", F.size("w").alias("n"), _hits(F.col("w"), F.lit(normalize("NFC", form))).alias("h"))
    total = counted.agg(
        F.coalesce(F.sum("h"), F.lit(0)).alias("raw_frequency"),
        F.count_if(F.col("h") > 0).alias("distinct_lines"),
        F.count_distinct(F.when(F.col("h") > 0, F.col("text_unit_id"))).alias("distinct_units"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("eligible_tokens"),
    )
    ratio = rate(F.col("raw_frequency"), F.col("eligible_tokens"))
    if not zero_as_null:
        return total.select(F.lit(form).alias("form"), "*", F.coalesce(ratio, F.lit(0.0)).alias("per_ten_thousand"))
    some = F.col("raw_frequency") > 0
    return total.select(
        F.lit(form).alias("form"),
        F.when(some, F.col("raw_frequency")).alias("raw_frequency"),
        F.when(some, F.col("distinct_lines")).alias("distinct_lines"),
        F.when(some, F.col("distinct_units")).alias("distinct_units"),
        F.when(some, ratio).alias("per_ten_thousand"),
    )


def exact_occurrences(lines: DataFrame, form: str, script: Script = PRIMARY) -> DataFrame:
    """The occurrences behind a count, one row each; lines without the form never build offsets."""
    holding = lines.filter(F.array_contains(compare_words(F.col("text"), script), form))
    return token_occurrences(holding, script).filter(
        (F.col("token_class") == "lexical_primary") & (F.col("compare_form") == form)
    )


def _weighted_forms(lines: DataFrame, words: Column, *keep: str) -> DataFrame:
    """Every token once with n = 1, and every distinct form of a line once more with l = 1."""
    both = F.array("w", F.array_distinct("w"))
    listed = lines.select(*keep, words.alias("w")).select(*keep, F.posexplode(both).alias("l", "v"))
    return listed.select(*keep, (1 - F.col("l")).alias("n"), "l", F.explode("v").alias("form"))


def form_counts(lines: DataFrame, script: Script = PRIMARY, exact: bool = False) -> DataFrame:
    """Per form: frequency, distinct lines, distinct units.

    Summing by (form, unit) first makes the unit count a plain count in the second, much smaller,
    shuffle; distinct lines need no shuffle of their own, because a line is one row.
    """
    words = lexical_words(F.col("text"), script) if exact else compare_words(F.col("text"), script)
    weighted = _weighted_forms(lines, words, "text_unit_id")
    per_unit = weighted.groupBy("form", "text_unit_id").agg(F.sum("n").alias("n"), F.sum("l").alias("l"))
    return per_unit.groupBy("form").agg(
        F.sum("n").alias("frequency"), F.sum("l").alias("distinct_lines"), F.count("*").alias("distinct_units")
    )


def ranked_forms(
    lines: DataFrame, script: Script = PRIMARY, exact: bool = False, limit: int | None = None, collation: str | None = None
) -> DataFrame:
    """Forms by falling frequency.  Ties in code-point order, or in the order of ``collation``."""
    counts = form_counts(lines, script, exact)
    tie = F.collate("form", collation) if collation else F.col("form")
    ranked = counts.orderBy(F.col("frequency").desc(), tie.asc(), F.col("form").asc())
    return ranked if limit is None else ranked.limit(limit)


def ranked_forms_page(
    lines: DataFrame, script: Script = PRIMARY, letter: str = "", limit: int = 100, offset: int = 0
) -> DataFrame:
    """A page of exact forms, each row carrying the number of forms in the whole list."""
    words = lexical_words(F.col("text"), script)
    if letter:
        words = F.filter(words, lambda w: F.startswith(w, F.lit(letter)))
    weighted = _weighted_forms(lines, words)
    counts = weighted.groupBy("form").agg(F.sum("n").alias("frequency"), F.sum("l").alias("distinct_lines"))
    page = counts.orderBy(F.col("frequency").desc(), "form").offset(offset).limit(limit)
    return page.withColumn("total", counts.agg(F.count("*")).scalar())


def grouped_frequency(lines: DataFrame, forms: Sequence[str], script: Script = PRIMARY) -> DataFrame:
    """One row per wanted form, zeros included, and one row for the group.

    Distinct lines and units do not add up over forms, so the group row is its own aggregate.
    """
    wanted = list(dict.fromkeys(normalize("NFC", f) for f in forms if f))
    held = lines.select(
        "text_unit_id", F.filter(compare_words(F.col("text"), script), lambda w: w.isin(wanted)).alias("w")
    ).filter(F.size("w") > 0)
    seen = held.select(F.explode("w").alias("form")).groupBy("form").agg(F.count("*").alias("frequency"))
    spark = lines.sparkSession
    listed = spark.createDataFrame([(f,) for f in wanted], "form string")
    nothing = F.lit(None).cast("bigint")
    per_form = listed.join(seen, "form", "left").select(
        F.lit("form").alias("row_kind"),
        "form",
        F.coalesce("frequency", F.lit(0)).alias("frequency"),
        nothing.alias("distinct_lines"),
        nothing.alias("distinct_units"),
    )
    group = held.agg(
        F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("frequency"),
        F.count("*").alias("distinct_lines"),
        F.count_distinct("text_unit_id").alias("distinct_units"),
    ).select(F.lit("group").alias("row_kind"), F.lit(None).cast("string").alias("form"), "*")
    return per_form.unionByName(group)


def related_form_frequency(lines: DataFrame, forms: Sequence[str], script: Script = PRIMARY) -> DataFrame:
    """Every included form stays visible next to the combined raw count."""
    wanted = [normalize("NFC", f) for f in forms]
    held = lines.select("text_unit_id", compare_words(F.col("text"), script).alias("w"))
    kept = held.select("text_unit_id", F.filter("w", lambda w: w.isin(wanted)).alias("text_words"))
    weighted = _weighted_forms(kept, F.col("text_words"), "text_unit_id")
    per_form = weighted.groupBy("form").agg(
        F.sum("n").alias("raw_frequency"),
        F.sum("l").alias("distinct_lines"),
        F.count_distinct("text_unit_id").alias("distinct_units"),
    )
    listed = lines.sparkSession.createDataFrame([(f,) for f in wanted], "form string")
    filled = listed.join(per_form, "form", "left").na.fill(0)
    return filled.withColumn("combined_raw_frequency", filled.agg(F.sum("raw_frequency")).scalar())


def prefix_forms(lines: DataFrame, prefix: str, script: Script = PRIMARY, limit: int | None = 12) -> DataFrame:
    """Most frequent compare forms that start with the query."""
    found = lines.select(
        F.explode(F.filter(compare_words(F.col("text"), script), lambda w: F.startswith(w, F.lit(prefix)))).alias("form")
    )
    ranked = found.groupBy("form").agg(F.count("*").alias("frequency")).orderBy(F.col("frequency").desc(), "form")
    return ranked if limit is None else ranked.limit(limit)


def lines_with_form(lines: DataFrame, form: str, script: Script = PRIMARY) -> DataFrame:
    return lines.filter(F.array_contains(compare_words(F.col("text"), script), form))


def concordance(
    lines: DataFrame, form: str, script: Script = PRIMARY, limit: int | None = 50, offset: int = 0
) -> DataFrame:
    """One ordered page of the lines that hold a form; see ``concordance_total`` for the count."""
    ordered = lines_with_form(lines, form, script).orderBy("source_work_id", "page_no", "line_order", "line_id")
    return ordered.offset(offset).limit(limit) if limit is not None else ordered


def concordance_total(lines: DataFrame, form: str, script: Script = PRIMARY) -> DataFrame:
    return lines_with_form(lines, form, script).agg(F.count("*").alias("total"))


def forms_by_work(lines: DataFrame, script: Script = PRIMARY) -> DataFrame:
    """Number of different exact forms per work, as a count over distinct pairs (no hot task)."""
    pairs = lines.select(
        "source_work_id", F.explode(F.array_distinct(lexical_words(F.col("text"), script))).alias("form")
    ).distinct()
    return pairs.groupBy("source_work_id").agg(F.count("*").alias("distinct_forms"))
