"""Substring join: (query, text) pairs where the text contains the query, as an equi-join.

Every needle is represented by the rarest of its character grams; only texts that hold this gram
meet the needle, and ``contains`` decides.  Nothing is compared all-with-all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

GRAM = 3


def grams(value: Column, size: int) -> Column:
    """Distinct overlapping pieces of ``size`` characters, found in one pass by a look-ahead."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


# Up to this many needles meet the texts where these are read; more meet the ids of texts.
IN_ROW = 200_000


def substring_join(
    queries: DataFrame, texts: DataFrame, needle: str, hay: str, text_id: str, stored: bool = False, in_row: int = IN_ROW
) -> DataFrame:
    """Inner join of ``queries`` and ``texts`` on contains(hay, needle).

    ``text_id`` identifies a row of ``texts``.  Needles shorter than a gram use grams of their own
    length; which of the three lengths occur is asked first, so texts are cut no finer than needed.
    With ``stored`` the texts are written first: for short ones that cost more to make than to read.

    The needles, their grams and the chosen gram of each are stored: they are small next to the texts, their size is
    known before the texts are cut, and no plan holds the steps that made them.  The texts are cut twice, to weigh the
    grams and to meet the chosen ones, because the grams of all texts are far more than the texts.  A pair of a text and a
    needle of its grams is decided in the row of the text, so that only hits leave it; where the needles are too many for
    that, pairs of ids are brought to the texts.
    """
    asked = cut_lineage(queries.filter(F.col(needle) != ""), "needles")
    size = F.least(F.length(needle), F.lit(GRAM))
    sizes = sorted(r[0] for r in asked.select(size.alias("n")).distinct().collect())
    if not sizes:
        return texts.join(asked, F.lit(False))
    if stored:
        texts = cut_lineage(texts, "texts")
    by_size = F.when(size == sizes[0], grams(F.col(needle), sizes[0]))
    for n in sizes[1:]:
        by_size = by_size.when(size == n, grams(F.col(needle), n))
    distinct = asked.select(needle).distinct()
    wanted = cut_lineage(distinct.select(needle, F.explode(by_size).alias("_gram")), "needle-grams")
    cut = F.concat(*[grams(F.col(hay), n) for n in sizes])
    # grams of different lengths differ; the outer form, as Spark would cut every text once more to ask whether it has any
    held = lambda *kept: texts.select(*kept, F.explode_outer(cut).alias("_gram"))
    weights = held(text_id).join(wanted.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_df"))
    rarest = (
        wanted.join(weights, "_gram", "left")
        .groupBy(needle)
        .agg(F.min_by("_gram", F.struct(F.coalesce("_df", F.lit(0)), "_gram")).alias("_gram"))
    )
    chosen = cut_lineage(rarest, "needle-chosen")
    if chosen.count() <= in_row:
        found = held("*").join(chosen, "_gram").filter(F.contains(hay, needle)).drop("_gram")
    else:
        found = held(text_id).join(chosen, "_gram").select(needle, text_id).join(texts, text_id).filter(F.contains(hay, needle))
    return found.join(asked, needle)


HEAD = 12


def prefix_join(queries: DataFrame, texts: DataFrame, prefix: str, hay: str) -> DataFrame:
    """Inner join of ``queries`` and ``texts`` on startswith(hay, prefix), by equality of up to ``HEAD`` opening characters.

    ``texts`` should hold each form once: it is opened to its beginnings, but only to those that some query has.
    """
    asked = queries.filter(F.col(prefix) != "").withColumn("_head", F.substring(prefix, 1, HEAD))
    heads = asked.select("_head").distinct()
    sizes = F.sequence(F.lit(1), F.least(F.length(hay), F.lit(HEAD)))
    begun = F.transform(sizes, lambda n: F.substring(F.col(hay), F.lit(1), n))
    opened = texts.filter(F.col(hay) != "").withColumn("_head", F.explode(begun)).join(heads, "_head", "left_semi")
    return asked.join(opened, "_head").filter(F.startswith(hay, F.col(prefix))).drop("_head")
