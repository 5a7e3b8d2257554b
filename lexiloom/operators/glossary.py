"""Glossary look-ups for a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import PRIMARY, Script, has_script, nfc
from ..session import cut_lineage
from .containment import prefix_join, substring_join


GROUP = ("headword", "meaning_en", "grammar_en", "etymology_en")


def glossary(queries: DataFrame, terms: DataFrame, entries: DataFrame, script: Script = PRIMARY) -> DataFrame:
    """Grouped dictionary hits per query with a relevance rank 0..2; queries without any in the terms
    fall back on the entries.  Romanised and English queries match inside, primary-script ones by prefix.
    """
    asked = queries.select("query_id", F.lower(nfc(F.trim("query"))).alias("needle"), has_script(F.col("query"), script).alias("is_primary"))
    asked = cut_lineage(asked.distinct(), "glossary-queries")
    latin, primary = asked.filter(~F.col("is_primary")), asked.filter("is_primary")
    # whether a term is met does not depend on its lines: they are counted once, not for every query
    keyed = terms.withColumn("row_id", F.sha2(F.to_json(F.struct(*GROUP, "transliteration")), 256))
    lined = keyed.groupBy("row_id", *GROUP, "transliteration").agg(F.min("term_id").alias("term_id"), F.count_distinct("line_id").alias("lines"))
    spelled = cut_lineage(lined.withColumn("spellings", F.count("*").over(W.partitionBy(*GROUP))), "glossary-terms")
    fields = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in ("transliteration", "meaning_en", "etymology_en")])
    # the unit separator keeps a needle from matching across two fields
    texts = spelled.withColumn("hay", F.array_join(fields, "\x1f"))
    inside = substring_join(latin, texts, "needle", "hay", "row_id")
    heads = spelled.withColumn("hay", F.lower("headword"))
    met = prefix_join(primary, heads.select("hay").distinct(), "needle", "hay")
    opening = met.join(heads, "hay")
    asked_for = ["query_id", "needle", "is_primary", *GROUP]
    found = inside.unionByName(opening).select(*asked_for, "row_id", "transliteration", "term_id", "lines", "spellings")
    alone = found.filter("spellings = 1").select(*asked_for, F.col("term_id").alias("id"), "transliteration", F.col("lines").alias("frequency"))
    # a query may meet some spellings of a group only, and these may share lines
    several = found.filter("spellings > 1").join(keyed.select("row_id", "line_id").distinct(), "row_id", "left")
    together = several.groupBy(*asked_for).agg(
        F.min("term_id").alias("id"), F.min("transliteration").alias("transliteration"), F.count_distinct("line_id").alias("frequency")
    )
    shown = ["query_id", "needle", "is_primary", "id", "headword", "transliteration", "frequency"]
    grouped = cut_lineage(alone.select(*shown).unionByName(together.select(*shown)), "glossary-hits")
    spoken = F.lower("transliteration")
    ranked = grouped.select(
        "query_id",
        "id",
        "headword",
        "transliteration",
        "frequency",
        F.when(F.col("is_primary"), "primary").when(F.contains(spoken, F.col("needle")), "roman").otherwise("english-concept").alias("match_kind"),
        F.when((F.lower("headword") == F.col("needle")) | (spoken == F.col("needle")), 0)
        .when(F.startswith(spoken, F.col("needle")), 1)
        .otherwise(2)
        .alias("relevance"),
    )
    unmet = latin.join(grouped.select("query_id").distinct(), "query_id", "left_anti")
    listed = entries.withColumn("hay", F.concat_ws("\x1f", F.lower("headword"), F.lower("content")))
    spare = substring_join(unmet, listed, "needle", "hay", "entry_id").select(
        "query_id",
        F.col("entry_id").alias("id"),
        "headword",
        F.lit("").alias("transliteration"),
        F.lit(0).cast("bigint").alias("frequency"),
        F.when(F.startswith(F.lower("headword"), F.col("needle")), "roman").otherwise("english-concept").alias("match_kind"),
        F.lit(3).alias("relevance"),
    )
    return ranked.unionByName(spare)


def resolve_candidates(queries: DataFrame, forms: DataFrame, script: Script = PRIMARY) -> DataFrame:
    """A primary-script query is its own candidate; a romanised one looks up forms by transliteration."""
    trimmed = queries.select("query_id", F.trim("query").alias("q"))
    own = trimmed.filter(F.col("q").rlike(f"^[{script.block}]+$")).select("query_id", nfc(F.col("q")).alias("form"))
    other = trimmed.filter(~F.col("q").rlike(f"^[{script.block}]+$") & (F.col("q") != "")).withColumn("key", F.lower("q"))
    keyed = forms.select(F.lower("transliteration").alias("key"), F.col("written_form").alias("form")).distinct()
    return own.unionByName(other.join(keyed, "key").select("query_id", "form"))
