"""Reading views: named readings, provider collections, translations and terms on lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUBSECTION = ("collection_code", "section_id", "subsection_id")


def inherited_passages(alignments: DataFrame) -> DataFrame:
    """Every line of a subsection with the subsection's passage translation.

    One passage per subsection is taken (smallest id), so lines and passages do not multiply.
    """
    passages = alignments.filter("scope = 'passage'").groupBy(*SUBSECTION).agg(
        F.min(F.struct("alignment_id", F.col("line_id").alias("anchor"), "translation")).alias("p")
    )
    sizes = alignments.groupBy(*SUBSECTION).agg(F.count_distinct("line_id").alias("member_count"))
    named = passages.join(sizes, list(SUBSECTION))
    return alignments.select(*SUBSECTION, "line_id").join(named, list(SUBSECTION)).select(
        "line_id",
        F.col("p.alignment_id").alias("passage_id"),
        F.col("p.anchor").alias("anchor_line_id"),
        "member_count",
        "collection_code",
        F.col("p.translation").alias("translation"),
        F.lit("passage").alias("scope"),
    )


def translations(alignments: DataFrame) -> DataFrame:
    """Line-scope translations and inherited passages, one row per candidate."""
    own = alignments.filter("scope <> 'passage' AND translation <> ''").select(
        "line_id",
        F.col("alignment_id").alias("passage_id"),
        F.col("line_id").alias("anchor_line_id"),
        F.lit(1).cast("bigint").alias("member_count"),
        "collection_code",
        "translation",
        "scope",
    )
    return own.unionByName(inherited_passages(alignments))


def best_translation(candidates: DataFrame, collections: DataFrame, preferred: str = "") -> DataFrame:
    """Per line: the preferred collection, else a composition, else any, in collection order."""
    ranked = candidates.join(collections, "collection_code")
    choice = F.when(F.col("collection_code") == preferred, 0).when(F.col("collection_type") == "composition", 1).otherwise(2)
    rest = [c for c in candidates.columns if c != "line_id"]
    order = F.struct(choice, "collection_order", "collection_code", "passage_id")
    return ranked.groupBy("line_id").agg(F.min_by(F.struct(*rest), order).alias("t")).select("line_id", "t.*")


def distinct_terms(terms: DataFrame) -> DataFrame:
    """First of the equal (headword, meaning) pairs of a line."""
    rest = [c for c in terms.columns if c not in ("line_id", "headword", "meaning_en")]
    first = terms.groupBy("line_id", "headword", "meaning_en").agg(F.min_by(F.struct(*rest), "term_id").alias("t"))
    return first.select("line_id", "headword", "meaning_en", "t.*")


def enriched_lines(lines: DataFrame, best: DataFrame, second: DataFrame) -> DataFrame:
    """Lines with their best translation and the second provider's; terms stay a table of their own."""
    return lines.join(best, "line_id", "left").join(second, "line_id", "left")


def shown_translation(source: str) -> Column:
    """Which text a reader sees: 'off', 'second', or 'first' with the second where the first has none;
    a passage shows at its anchor only."""
    if source == "off":
        return F.lit(None).cast("string")
    if source == "second":
        return F.col("second_translation")
    has = F.coalesce(F.col("translation") != "", F.lit(False))
    visible = (F.col("scope") != "passage") | (F.col("line_id") == F.col("anchor_line_id"))
    return F.when(has & visible, F.col("translation")).when(~has, F.col("second_translation"))


def reading_view(readings: DataFrame, crosswalk: DataFrame, lines: DataFrame, contributors: DataFrame) -> DataFrame:
    """Ordered lines of named readings; a line without a match gets an id of its own."""
    mapped = readings.join(crosswalk.select("reading_id", "line_order", "line_id"), ["reading_id", "line_order"], "left")
    known = lines.select("line_id", "source_work_id", "text_unit_id", "page_no", "contributor_id")
    joined = mapped.join(known, "line_id", "left").join(contributors.select("contributor_id", "name"), "contributor_id", "left")
    own = F.concat_ws(":", F.lit("reading-line"), "reading_id", F.col("line_order").cast("string"))
    return joined.select(
        "reading_id",
        "line_order",
        F.coalesce("line_id", own).alias("line_id"),
        F.coalesce("text_unit_id", F.lit("")).alias("text_unit_id"),
        F.coalesce("page_no", F.lit(0)).alias("page_no"),
        "text",
        F.coalesce("name", F.lit("")).alias("contributor_name"),
    ).orderBy("reading_id", "line_order")


def collection_view(alignments: DataFrame, lines: DataFrame, code: str) -> DataFrame:
    """Lines of a collection in provider order; a line that is supplied twice stays twice."""
    rows = alignments.filter(F.col("collection_code") == code)
    return rows.join(lines.select("line_id", "text"), "line_id").select(
        "alignment_id", "section_id", "subsection_id", "line_order", "line_id", "text"
    ).orderBy("section_id", "subsection_id", "line_order", "alignment_id")


def section_starts(view: DataFrame) -> DataFrame:
    """Marks the first row of every section in provider order."""
    order = F.struct("subsection_id", "line_order", "alignment_id")
    first = view.groupBy("section_id").agg(F.min_by("alignment_id", order).alias("_first"))
    return view.join(first, "section_id").withColumn(
        "header_level", F.when(F.col("alignment_id") == F.col("_first"), 2).otherwise(0)
    ).drop("_first")


def collection_summaries(collections: DataFrame, alignments: DataFrame) -> DataFrame:
    """Sections and translated anchor lines per collection, each side aggregated before the join."""
    sections = alignments.select("collection_code", "section_id").distinct().groupBy("collection_code").agg(
        F.count("*").alias("section_count")
    )
    translated = alignments.filter("translation <> ''").select("collection_code", "line_id").distinct().groupBy(
        "collection_code"
    ).agg(F.count("*").alias("translated_line_count"))
    joined = collections.join(sections, "collection_code", "left").join(translated, "collection_code", "left")
    return joined.na.fill(0, ["section_count", "translated_line_count"])


def reading_summaries(readings: DataFrame, translated: DataFrame) -> DataFrame:
    """Every reading with its number of translated lines and whether it has any."""
    hits = readings.join(translated.select("line_id").distinct(), "line_id", "left_semi")
    counted = hits.groupBy("reading_id").agg(F.count("*").alias("translated_lines"))
    all_readings = readings.groupBy("reading_id").agg(F.count("*").alias("verse_count"))
    joined = all_readings.join(counted, "reading_id", "left").withColumn("translated_lines", F.coalesce("translated_lines", F.lit(0)))
    return joined.withColumn("available", F.col("translated_lines") > 0)


def units_per_section(alignments: DataFrame) -> DataFrame:
    """Distinct units an alignment reaches per (collection, section)."""
    pairs = alignments.select("collection_code", "section_id", "text_unit_id").distinct()
    return pairs.groupBy("collection_code", "section_id").agg(F.count("*").alias("mapped_unit_count"))


def related_forms(forms: DataFrame, seeds: DataFrame) -> DataFrame:
    """Other written forms under the glossary entries of the wanted forms.

    forms: entry_id, written_form, comparison_form.  Only the seeds' entries are expanded.
    """
    asked = seeds.select(F.col("form").alias("seed")).distinct()
    entries = forms.join(asked, forms["comparison_form"] == asked["seed"]).select("entry_id", "seed").distinct()
    found = entries.join(forms.select("entry_id", F.col("written_form").alias("form")), "entry_id")
    return found.filter((F.col("form") != F.col("seed")) & (F.col("form") != "")).select("seed", "form").distinct()


def topped_up_forms(curated: DataFrame, frequent: DataFrame, limit: int) -> DataFrame:
    """Curated forms, filled up with frequent ones not among them.  Both: form; frequent: frequency too."""
    first = curated.select("form", F.lit(0).alias("tier"), F.lit(0).cast("bigint").alias("frequency"))
    more = frequent.join(curated.select("form"), "form", "left_anti").select("form", F.lit(1).alias("tier"), "frequency")
    return first.unionByName(more).orderBy("tier", F.col("frequency").desc(), "form").limit(limit)


def nearest_rank(rows: DataFrame, group: str, value: str, p: float, accuracy: int = 10000) -> DataFrame:
    """Exact nearest-rank percentile per group.

    A sketch brackets the rank; only the values inside the bracket, a few in ``accuracy``, are ranked.
    """
    low, high = max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)
    clean = rows.filter(F.col(value).isNotNull()).select(group, value)
    frame = clean.groupBy(group).agg(
        F.percentile_approx(value, F.array(F.lit(low), F.lit(high)), accuracy).alias("b"), F.count("*").alias("n")
    )
    placed = clean.join(frame.select(group, "b"), group)
    below = placed.filter(F.col(value) < F.col("b")[0]).groupBy(group).agg(F.count("*").alias("below"))
    inside = placed.filter(F.col(value).between(F.col("b")[0], F.col("b")[1])).groupBy(group, value).agg(F.count("*").alias("c"))
    running = W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = inside.withColumn("upto", F.sum("c").over(running)).join(frame.select(group, "n"), group).join(below, group, "left")
    reached = ranked.filter(F.col("upto") + F.coalesce("below", F.lit(0)) >= F.ceil(F.col("n") * p))
    return reached.groupBy(group).agg(F.min(value).alias("percentile"))
