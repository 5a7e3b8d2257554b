"""Provider deliveries: wide rows to attributed layers, glossary, coverage of the mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PRIMARY, Script, has_script, leading_int, nfc

# Which layer a field of a wide row holds, per language.
LAYER_FIELDS = {
    "SubSectionContent": {"english": "transliteration", "panjabi": "reference_primary"},
    "SubSectionLiteralTranslation": {"english": "literal_translation_en", "panjabi": "literal_translation_pa"},
    "SubSectionMeaningInterpretive": {"english": "interpretive_transcreation_en", "panjabi": "interpretive_transcreation_pa"},
    "SubSectionCommentary": {"english": "commentary_en", "panjabi": "commentary_pa"},
    "SubSectionPoeticalDimension": {"english": "poetical_dimension_en", "panjabi": "poetical_dimension_pa"},
    "Overview": {"english": "overview_en", "panjabi": "overview_pa"},
}


def layer_rows(subsections: DataFrame) -> DataFrame:
    """One row per non-blank (field, language) of a wide row that has a layer type."""
    entries = []
    for field, types in LAYER_FIELDS.items():
        kind = F.lit(None).cast("string")
        for language, name in types.items():
            kind = F.when(F.col("BaniLanguage") == language, name).otherwise(kind)
        entries.append(F.struct(kind.alias("content_type"), F.col(field).alias("content")))
    keys = ["BaniCode", "SectionId", "SubSectionId", "SectionSequence", "SubSectionSequence", "BaniLanguage"]
    rows = subsections.select(*keys, F.inline(F.array(*entries)))
    return rows.filter(F.col("content_type").isNotNull() & (F.trim("content") != ""))


def tagged_layers(rows: DataFrame, provider: str, release: str, attribution: str, prefix: str = "layer") -> DataFrame:
    """Layers as annotation rows; provider, release, attribution and status travel with each."""
    key = [F.col(c).cast("string") for c in ("BaniCode", "SectionId", "SubSectionId")]
    return rows.select(
        F.concat_ws(":", F.lit(prefix), *key, "content_type").alias("layer_id"),
        F.concat_ws(":", F.lit(prefix), *key).alias("group_id"),
        F.lit(provider).alias("provider"),
        F.lit(release).alias("provider_release_id"),
        "content_type",
        "content",
        F.lit(attribution).alias("attribution_label"),
        F.lit("unmapped_provider_subsection").alias("mapping_status"),
    )


def reference_text(subsections: DataFrame) -> DataFrame:
    """Every wide row with the primary-script text of its (code, section, subsection).

    The last such row wins when a key is delivered twice (``RowID`` order).
    """
    keys = ["BaniCode", "SectionId", "SubSectionId"]
    primary = (
        subsections.filter(F.col("BaniLanguage") == "panjabi")
        .groupBy(*keys)
        .agg(F.max_by("SubSectionContent", "RowID").alias("paired"))
    )
    own = F.when(F.col("BaniLanguage") == "panjabi", F.col("SubSectionContent")).otherwise(F.col("paired"))
    return subsections.join(primary, keys, "left").withColumn("reference_text", own).drop("paired")


def section_metadata(details: DataFrame) -> DataFrame:
    """(code, section) -> first page, author, heading; the section's author before the whole's."""
    sections = details.select("BaniCode", F.col("Author").alias("a"), F.col("Rag").alias("heading"), F.inline("Sections"))
    return sections.select(
        "BaniCode",
        "SectionId",
        F.nullif(leading_int(F.col("PageNumberStart")), F.lit(0)).alias("first_page"),
        F.coalesce("Author", "a").alias("author"),
        "heading",
    )


def pair_languages(rows: DataFrame, key: str, fields: list[str], order: str, first: str = "english", second: str = "panjabi") -> DataFrame:
    """One row per key with both languages side by side, each standing in for the other."""
    picked = rows.groupBy(key).agg(
        *[F.max_by(F.struct(*fields), F.when(F.col("language") == lang, F.col(order))).alias(name)
          for lang, name in ((first, "_a"), (second, "_b"))],
        F.count_if(F.col("language") == first).alias("_na"),
        F.count_if(F.col("language") == second).alias("_nb"),
    )
    a, b = F.when(F.col("_na") > 0, F.col("_a")), F.when(F.col("_nb") > 0, F.col("_b"))
    en, pa = F.coalesce(a, b), F.coalesce(b, a)
    return picked.filter("_na > 0 OR _nb > 0").select(
        key, *[en[f].alias(f"{f}_en") for f in fields], *[pa[f].alias(f"{f}_pa") for f in fields]
    )


def glossary_entries(dictionary: DataFrame, significant: DataFrame) -> DataFrame:
    """Dictionary rows and significant words as entries with JSON content."""
    keep = {"ignoreNullFields": "false"}
    first = dictionary.select(
        F.concat_ws(":", F.lit("dictionary"), "language", "term_id").alias("entry_id"),
        "headword",
        F.to_json(F.struct("language", F.col("meaning_en").alias("meaning"), F.col("grammar_en").alias("grammar"),
                           F.col("etymology_en").alias("etymology")), keep).alias("content"),
        F.lit("provider_published").alias("review_status"),
    )
    second = significant.select(
        F.concat_ws(":", F.lit("significant"), "language", "word_id").alias("entry_id"),
        "headword",
        F.to_json(F.struct("language", "description"), keep).alias("content"),
        F.lit("provider_published").alias("review_status"),
    )
    return first.unionByName(second).filter(F.col("headword").isNotNull() & (F.trim("headword") != ""))


def term_forms(dictionary: DataFrame, script: Script = PRIMARY) -> DataFrame:
    """Only headwords with a character of the primary script."""
    return dictionary.filter(has_script(F.col("headword"), script)).select(
        "term_id", F.col("headword").alias("written_form"), nfc(F.col("headword")).alias("comparison_form")
    )


def published(catalogue: DataFrame, details: DataFrame, key: str = "code") -> DataFrame:
    return details.join(catalogue.filter("is_published"), key, "left_semi")


def group_id() -> Column:
    """A layer id without its type suffix."""
    return F.expr("substring(layer_id, 1, length(layer_id) - length(content_type) - 1)")


def mapping_coverage(layers: DataFrame) -> DataFrame:
    """One row: layers mapped and not, units reached, groups left.

    Distinct counts are taken over (unit) and (group) rows of a first aggregate, not in one task.
    """
    mapped = F.col("text_unit_id").isNotNull()
    keyed = layers.select("text_unit_id", F.when(~mapped, group_id()).alias("open_group"))
    once = keyed.groupBy("text_unit_id", "open_group").agg(F.count("*").alias("n"))
    return once.agg(
        F.sum("n").alias("total_layers"),
        F.sum(F.when(mapped, F.col("n")).otherwise(0)).alias("mapped_layers"),
        F.sum(F.when(mapped, 0).otherwise(F.col("n"))).alias("unmapped_layers"),
        F.count_if(mapped).alias("mapped_units"),
        F.count("open_group").alias("unmapped_groups"),
    )


def unmapped_groups(layers: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of groups without a unit, a row per layer, in (group, type) order."""
    keyed = layers.withColumn("group_id", group_id())
    page = (
        keyed.filter("text_unit_id IS NULL")
        .groupBy("group_id")
        .agg(F.min("mapping_status").alias("group_status"))
        .orderBy("group_id")
        .offset(offset)
        .limit(limit)
    )
    return keyed.join(page, "group_id").orderBy("group_id", "content_type", "layer_id")


def layer_types(layers: DataFrame) -> DataFrame:
    """Sorted list of layer types per unit; the set is bounded by the number of types."""
    kinds = layers.filter("text_unit_id IS NOT NULL").groupBy("text_unit_id").agg(F.collect_set("content_type").alias("s"))
    return kinds.select("text_unit_id", F.array_join(F.array_sort("s"), ",").alias("layer_types"))


def visible_layers(layers: DataFrame, chosen: list[str], preference: list[str]) -> DataFrame:
    """Chosen types where a unit has any of them, else its first layer by preference."""
    wanted = F.col("content_type").isin(chosen)
    rank = F.lit(len(preference))
    for n, kind in reversed(list(enumerate(preference))):
        rank = F.when(F.col("content_type") == kind, n).otherwise(rank)
    per_unit = layers.groupBy("text_unit_id").agg(
        F.bool_or(wanted).alias("_any"), F.min_by("layer_id", F.struct(rank, "layer_id")).alias("_first")
    )
    joined = layers.join(per_unit, "text_unit_id")
    shown = F.when(F.col("_any"), wanted).otherwise(F.col("layer_id") == F.col("_first"))
    return joined.filter(shown).drop("_any", "_first")
