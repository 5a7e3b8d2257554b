"""The given Parquet tables seen as the corpus model.

documents -> works (lang), text units (doc), lines (split on newline), contributors (source);
labels -> nullable section headings; benchmark -> provider reference text; pages -> annotation layers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_space

LINES_PER_PAGE = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Redistribute whole rows when the files give fewer tasks than there are cores.

    Line and token work is heavy per row; a table of many row groups is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("lang")
    return (
        table(spark, sf_dir, "documents")
        .select(lang)
        .distinct()
        .select(
            F.concat(F.lit("source:"), lang).alias("source_work_id"),
            lang.alias("upstream_id"),
            F.upper(lang).alias("title"),
            F.lit("verse_corpus").alias("profile"),
        )
    )


def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.col("source")
    return (
        table(spark, sf_dir, "documents")
        .select(source)
        .distinct()
        .select(
            F.concat(F.lit("contributor:"), source).alias("contributor_id"),
            source.alias("name"),
            F.lit("contributor").alias("contributor_type"),
        )
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("unit:"), doc).alias("text_unit_id"),
        doc.alias("upstream_id"),
        F.concat(F.lit("source:"), "lang").alias("source_work_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.when(F.col("doc_id") % 5 == 0, "section").otherwise("shabad").alias("unit_type"),
        F.col("doc_id").alias("unit_order"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("Unit "), doc)).alias("title"),
    )


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.concat_ws(":", F.lit("attribution"), doc, "source").alias("attribution_id"),
        F.concat(F.lit("contributor:"), "source").alias("contributor_id"),
        F.lit("textUnit").alias("target_type"),
        F.concat(F.lit("unit:"), doc).alias("target_id"),
    )


def lines(spark: SparkSession, sf_dir: str, headings: bool = False) -> DataFrame:
    """One row per line; ``heading`` only on request, because it costs a join."""
    docs = spread(table(spark, sf_dir, "documents"))
    if headings:
        quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
        docs = docs.join(quality, "doc_id", "left")
    split = docs.select("*", F.posexplode(F.split("text", "\n")).alias("line_order", "line_text"))
    doc = F.col("doc_id").cast("string")
    key = F.concat_ws(":", doc, F.col("line_order").cast("string"))
    columns = [
        F.concat(F.lit("line:"), key).alias("line_id"),
        key.alias("upstream_id"),
        F.concat(F.lit("source:"), "lang").alias("source_work_id"),
        F.concat(F.lit("unit:"), doc).alias("text_unit_id"),
        F.concat(F.lit("contributor:"), "source").alias("contributor_id"),
        "line_order",
        (F.floor(F.col("line_order") / LINES_PER_PAGE) + 1).cast("int").alias("page_no"),
        F.col("line_text").alias("text"),
    ]
    if headings:
        columns += [
            F.col("quality").cast("string").alias("heading_id"),
            F.when(F.col("quality").isNotNull(), F.concat(F.lit("Heading "), F.col("quality").cast("string"))).alias(
                "heading"
            ),
        ]
    return split.select(*columns)


def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider reference text: one row per line of a benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(F.split("text", "\n")).alias("line_index", "reference_text")
    )
    return items.select(
        F.concat_ws(":", F.lit("record"), F.col("item_id").cast("string"), F.col("line_index").cast("string")).alias(
            "record_id"
        ),
        "item_id",
        "line_index",
        "reference_text",
    )


# Fixed value: the layer types of an annotated unit that the pages are spread over.
LAYER_TYPES = ("literal_translation_en", "interpretive_transcreation_en", "commentary_en", "poetical_dimension_en")


def layer_type(page_id: Column) -> Column:
    choice = page_id % len(LAYER_TYPES)
    column = F.when(choice == 0, LAYER_TYPES[0])
    for n, name in enumerate(LAYER_TYPES[1:], 1):
        column = column.when(choice == n, name)
    return column


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation layers: a page annotates the document of the same number divided by two.

    Pages whose number is a multiple of five stay unmapped.
    """
    page = F.col("page_id")
    kind = layer_type(page)
    return spread(table(spark, sf_dir, "pages")).select(
        F.concat_ws(":", F.lit("layer"), F.lit("p"), F.floor(page / 4).cast("string"), kind).alias("layer_id"),
        kind.alias("content_type"),
        F.when(page % 5 != 0, F.concat(F.lit("unit:"), F.floor(page / 2).cast("string"))).alias("text_unit_id"),
        F.col("html").alias("content"),
        F.lit("Provider archive").alias("attribution_label"),
        F.when(page % 5 != 0, "mapped_to_canonical_text_unit")
        .otherwise("unmapped_provider_subsection")
        .alias("mapping_status"),
    )


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries: every benchmark line, whole."""
    return reference_lines(spark, sf_dir).select(F.col("record_id").alias("query_id"), fold_space(F.col("reference_text")).alias("query"))


def phrase_table(spark: SparkSession, sf_dir: str, n_words: int) -> DataFrame:
    """Short queries: all distinct runs of ``n_words`` consecutive words of the benchmark lines, their own ids."""
    words = F.filter(F.split(fold_space(F.col("reference_text")), " "), lambda w: w != "")
    line = reference_lines(spark, sf_dir).select(words.alias("words")).filter(F.size("words") >= n_words)
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - n_words + 1), lambda i: F.array_join(F.slice("words", i, n_words), " "))
    return line.select(F.explode(runs).alias("query")).distinct().select(F.col("query").alias("query_id"), "query")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider dictionary: the second word of every conversation turn, located at the unit of the
    same number; the turn itself is the meaning."""
    word = F.try_element_at(F.split(fold_space(F.col("text")), " "), F.lit(2))
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.lit("term"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("term_id"),
        F.concat(F.lit("unit:"), F.col("conv_id").cast("string")).alias("text_unit_id"),
        F.col("role").alias("language"),
        F.regexp_replace(word, r"[.,]", "").alias("headword"),
        F.lower(F.regexp_replace(word, r"[.,]", "")).alias("transliteration"),
        F.col("text").alias("meaning_en"),
        F.col("role").alias("grammar_en"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("etymology_en"),
    ).filter(F.col("headword").isNotNull() & (F.col("headword") != ""))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose text is a line of the reference text, with the record they came from."""
    reference = reference_lines(spark, sf_dir).select("record_id", "item_id", F.col("reference_text").alias("text"))
    return lines(spark, sf_dir).join(reference, "text").select(
        F.col("record_id").alias("alignment_id"), "line_id", "text_unit_id", (F.col("item_id") % 2 == 0).alias("has_translation")
    )


SUBSECTION_LINES = 6


def subsections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide provider rows: each run of six lines of a document is one row, the lines its six fields; all lines are read."""
    lines = F.split("text", "\n")
    firsts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(SUBSECTION_LINES))
    runs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", lines.alias("lines"), F.posexplode(firsts).alias("run", "first"))
    part = lambda n: F.get("lines", F.col("first") + n)
    language = F.when(F.col("lang") == "en", "english").when(F.col("lang") == "fr", "panjabi").otherwise(F.col("lang"))
    row = F.col("doc_id") * 100_000 + F.col("run")
    subsection = F.floor(F.col("doc_id") / 2) * 100_000 + F.col("run")
    return runs.select(
        row.alias("RowID"),
        F.col("source").alias("BaniCode"),
        language.alias("BaniLanguage"),
        F.floor(F.col("doc_id") / 100).alias("SectionId"),
        subsection.alias("SubSectionId"),
        F.floor(F.col("doc_id") / 100).alias("SectionSequence"),
        subsection.alias("SubSectionSequence"),
        part(0).alias("SubSectionContent"),
        part(1).alias("SubSectionLiteralTranslation"),
        part(2).alias("SubSectionMeaningInterpretive"),
        part(3).alias("SubSectionCommentary"),
        part(4).alias("SubSectionPoeticalDimension"),
        part(5).alias("Overview"),
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections over the lines, by source and (every second unit) by language; the last line
    of a page carries the passage translation."""
    base = lines(spark, sf_dir).withColumn("doc", F.substring("text_unit_id", 6, 20).cast("bigint"))
    kind = F.when(F.col("line_order") % 10 == 9, "passage").when(F.col("line_order") % 3 == 0, "line").otherwise("none")

    def collection(rows: DataFrame, code: Column, prefix: str) -> DataFrame:
        return rows.select(
            F.concat(F.lit(prefix), F.substring("line_id", 5, 60)).alias("alignment_id"),
            code.alias("collection_code"),
            F.col("doc").alias("section_id"),
            F.col("page_no").alias("subsection_id"),
            "line_order",
            "line_id",
            "text_unit_id",
            kind.alias("scope"),
            F.when(kind == "none", "").otherwise(F.concat(F.lit("T. "), "text")).alias("translation"),
        )

    first = collection(base, F.substring("contributor_id", 13, 20), "a")
    second = collection(base.filter("doc % 2 = 0"), F.substring("source_work_id", 8, 20), "b")
    return first.unionByName(second)


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    by_source = docs.select(F.col("source").alias("collection_code"), F.lit("composition").alias("collection_type")).distinct()
    by_lang = docs.select(F.col("lang").alias("collection_code"), F.lit("ceremonial").alias("collection_type")).distinct()
    return by_source.unionByName(by_lang).withColumn("collection_order", F.length("collection_code"))
