"""Reviewed themes: an alias triggers a theme, its terms find annotation layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_term, excerpt, fold_space, plain_text

# Fixed values of theme search.
BASE, PER_TERM, OWN_WORD, MINIMUM, SHOWN = 650, 70, 120, 700, 8
THEME_TYPES = ("literal_translation_en", "interpretive_transcreation_en", "commentary_en", "poetical_dimension_en")

# Fixed values: (theme, aliases, search terms).
THEMES = (
    ("ego", ("ego", "egotism", "pride", "self centred", "self-centered", "haumai"),
     ("ego", "egotism", "pride", "self-centred", "self-centered", "haumai")),
    ("diet", ("diet", "food", "eating", "meat", "vegetarian", "vegetarianism"), ("diet", "food", "eating", "meat", "vegetarian")),
    ("compassion", ("compassion", "compassionate", "mercy"), ("compassion", "compassionate", "mercy")),
    ("contentment", ("contentment", "contented", "satisfaction"), ("contentment", "contented", "satisfaction")),
    ("calmness", ("calm", "calmness", "stillness", "inner peace"), ("calm", "stillness", "peace")),
    ("humility", ("humility", "humble"), ("humility", "humble")),
    ("courage", ("courage", "courageous", "fearless", "fearlessness"), ("courage", "courageous", "fearless", "fearlessness")),
    ("gender", ("gender", "women", "woman"), ("gender", "women", "woman", "feminine", "masculine")),
    ("afterlife", ("afterlife", "heaven", "hell"), ("afterlife", "heaven", "hell")),
)


def theme_table(spark: SparkSession, themes=THEMES) -> DataFrame:
    rows = [(t, list(a), list(s)) for t, a, s in themes]
    return spark.createDataFrame(rows, "theme string, aliases array<string>, terms array<string>")


def triggered(queries: DataFrame, themes: DataFrame) -> DataFrame:
    """Queries of Latin letters, spaces and hyphens that are an alias."""
    folded = fold_space(F.lower("query"))
    plain = ~F.col("query").rlike(r"[^A-Za-z\s-]") & (folded != "")
    aliases = themes.select("theme", "terms", F.explode("aliases").alias("alias"))
    return queries.filter(plain).withColumn("alias", folded).join(aliases, "alias").drop("alias")


def evidence(layers: DataFrame, themes: DataFrame) -> DataFrame:
    """(theme, layer) with the whole-word terms found.

    A term meets only layers that hold its first word; hot words are pre-reduced to one row per layer.
    """
    plain = layers.filter(F.col("content_type").isin(list(THEME_TYPES)) & F.col("text_unit_id").isNotNull()).withColumn(
        "plain", plain_text(F.col("content"))
    )
    runs = F.array_distinct(F.regexp_extract_all(F.lower("plain"), F.lit("[a-z]+"), F.lit(0)))
    terms = themes.select("theme", F.explode("terms").alias("term")).withColumn(
        "opening", F.regexp_extract(F.lower("term"), "[a-z]+", 0)
    )
    words = plain.select("layer_id", F.explode(runs).alias("opening"))
    pairs = words.join(terms, "opening").join(plain.select("layer_id", "plain"), "layer_id")
    found = pairs.filter(contains_term(F.col("plain"), F.col("term")))
    per_layer = found.groupBy("theme", "layer_id").agg(F.collect_set("term").alias("matched"))
    return per_layer.join(plain.select("layer_id", "text_unit_id", "content_type", "plain"), "layer_id")


def theme_search(queries: DataFrame, layers: DataFrame, themes: DataFrame, pages: DataFrame, limit: int = SHOWN) -> DataFrame:
    """Best layer per unit for every triggered query, ``limit`` per query.

    ``pages``: text_unit_id, first_page; breaks ties of equal scores.
    """
    fired = triggered(queries, themes).select("query_id", "theme", F.trim(F.lower("query")).alias("asked"))
    # the answer depends on the folded query only, so it is found once per different query
    found = evidence(layers, themes).join(pages, "text_unit_id").join(fired.select("theme", "asked").distinct(), "theme")
    own = F.when(contains_term(F.col("plain"), F.col("asked")), OWN_WORD).otherwise(0)
    scored = found.select(
        "asked", "theme", "layer_id", "text_unit_id", "first_page", (F.lit(BASE) + F.size("matched") * PER_TERM + own).alias("score")
    ).filter(F.col("score") >= MINIMUM)
    order = F.struct(-F.col("score"), "first_page", "layer_id")
    best = scored.groupBy("asked", "theme", "text_unit_id").agg(
        F.min_by(F.struct("layer_id", "score", "first_page"), order).alias("h")
    ).select("asked", "theme", "text_unit_id", "h.*")
    ranked = W.partitionBy("asked").orderBy(F.col("score").desc(), "first_page", "layer_id")
    top = best.withColumn("position", F.row_number().over(ranked)).filter(F.col("position") <= limit)
    # only the rows shown fetch their text again
    terms = themes.select("theme", "terms")
    texts = layers.select("layer_id", "content").join(top.select("layer_id").distinct(), "layer_id", "left_semi")
    plain = texts.select("layer_id", plain_text(F.col("content")).alias("plain"))
    shown = top.join(plain, "layer_id").join(terms, "theme")
    matched = F.filter("terms", lambda t: contains_term(F.col("plain"), t))
    cut = shown.withColumn("excerpt", excerpt(F.col("plain"), matched)).drop("plain", "terms")
    return cut.join(fired.select("query_id", "asked"), "asked").drop("asked")
