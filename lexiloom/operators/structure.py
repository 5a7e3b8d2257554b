"""Works, units, contributors, headings: summaries and the joins around a line."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READING_ORDER = ("page_no", "line_order", "line_id")


def nested_count(rows: DataFrame, keys: Sequence[str], inner: str, *extra: Column) -> DataFrame:
    """Per ``keys``: distinct ``inner`` values and all rows.

    Two plain group-bys instead of a distinct count: the first spreads a hot key over its inner
    values, the second only adds up.
    """
    first = rows.groupBy(*keys, inner).agg(F.count("*").alias("_rows"), *extra)
    return first.groupBy(*keys).agg(
        F.count(inner).alias("unit_count"),
        F.sum("_rows").alias("line_count"),
        *[F.min(c).alias(c) for c in first.columns if c not in (*keys, inner, "_rows")],
    )


def unit_previews(lines: DataFrame) -> DataFrame:
    """First line of every unit over all of its lines."""
    return lines.groupBy("text_unit_id").agg(F.min_by("text", F.struct(*READING_ORDER)).alias("preview"))


def unit_summaries(units: DataFrame, lines: DataFrame, contributors: DataFrame, scope: Column | None = None) -> DataFrame:
    """Summary per unit.  ``scope`` restricts the counted lines; the preview sees all of them."""
    named = lines.join(contributors.select("contributor_id", "name"), "contributor_id", "left")
    chosen = F.lit(True) if scope is None else scope
    pick = lambda c: F.when(chosen, F.col(c))
    grouped = named.groupBy("text_unit_id").agg(
        F.min(pick("contributor_id")).alias("contributor_id"),
        F.min(pick("name")).alias("contributor_name"),
        F.min(pick("page_no")).alias("first_page"),
        F.max(pick("page_no")).alias("last_page"),
        F.count_if(chosen).alias("line_count"),
        F.min(pick("heading")).alias("heading"),
        F.min_by("text", F.struct(*READING_ORDER)).alias("preview"),
    )
    kept = grouped.filter(F.col("line_count") > 0)
    return units.select("text_unit_id", "source_work_id", "unit_order", "title").join(kept, "text_unit_id").select(
        "text_unit_id",
        "source_work_id",
        "unit_order",
        F.coalesce("title", F.lit("Unit")).alias("title"),
        F.coalesce("contributor_id", F.lit("")).alias("contributor_id"),
        F.coalesce("contributor_name", F.lit("Unknown contributor")).alias("contributor_name"),
        F.coalesce("first_page", F.lit(1)).alias("first_page"),
        F.coalesce("last_page", F.lit(1)).alias("last_page"),
        "line_count",
        F.coalesce("heading", F.lit("Unclassified")).alias("heading"),
        F.coalesce("preview", F.lit("")).alias("preview"),
    )


def contributor_units(
    units: DataFrame, lines: DataFrame, contributors: DataFrame, contributor_ids: Sequence[str], work: str = "all"
) -> DataFrame:
    scope = F.col("contributor_id").isin(list(contributor_ids))
    if work != "all":
        units = units.filter(F.col("source_work_id") == work)
    return unit_summaries(units, lines, contributors, scope).orderBy("first_page", "unit_order", "text_unit_id")


def heading_units(
    units: DataFrame, lines: DataFrame, contributors: DataFrame, heading: str, work: str = "all", contributor: str = ""
) -> DataFrame:
    scope = F.coalesce(F.col("heading") == heading, F.lit(False))
    if contributor:
        scope = scope & (F.col("contributor_id") == contributor)
    if work != "all":
        units = units.filter(F.col("source_work_id") == work)
    return unit_summaries(units, lines, contributors, scope).orderBy("first_page", "unit_order", "text_unit_id")


def contributor_structure(
    contributors: DataFrame, attributions: DataFrame, units: DataFrame, lines: DataFrame, kind: str = "shabad"
) -> DataFrame:
    """Per contributor, zeros included: units of one kind, attributed units, lines."""
    attributed = (
        attributions.filter(F.col("target_type") == "textUnit")
        .select("contributor_id", F.col("target_id").alias("text_unit_id"))
        .distinct()
        .join(units.select("text_unit_id", "unit_type"), "text_unit_id")
        .groupBy("contributor_id")
        .agg(F.count_if(F.col("unit_type") == kind).alias("kind_count"), F.count("*").alias("attributed_unit_count"))
    )
    written = lines.groupBy("contributor_id").agg(F.count("*").alias("line_count"))
    joined = contributors.join(attributed, "contributor_id", "left").join(written, "contributor_id", "left")
    return joined.na.fill(0, ["kind_count", "attributed_unit_count", "line_count"])


def heading_summaries(lines: DataFrame, work: str = "all", placeholder: str = "No heading") -> DataFrame:
    scoped = lines if work == "all" else lines.filter(F.col("source_work_id") == work)
    named = scoped.filter(F.col("heading").isNotNull() & (F.col("heading") != "") & (F.col("heading") != placeholder))
    found = nested_count(named, ("heading_id", "heading"), "text_unit_id", F.min("page_no").alias("first_page"))
    return found.withColumn("heading_id", F.coalesce("heading_id", "heading")).orderBy("first_page", "heading")


def heading_contributors(lines: DataFrame, contributors: DataFrame) -> DataFrame:
    """Units per contributor within every heading of every work."""
    keys = ("source_work_id", "heading", "contributor_id")
    counted = nested_count(lines.filter(F.col("heading").isNotNull()), keys, "text_unit_id").drop("line_count")
    return counted.join(contributors.select("contributor_id", "name"), "contributor_id")


def contributor_summaries(
    lines: DataFrame, contributors: DataFrame, combined: Mapping[str, tuple[str, str]] | None = None, work: str = "all"
) -> DataFrame:
    """Units and lines per contributor; ``combined`` maps an id to the (id, name) it is shown under.

    Distinct units are counted per original id and then added, as the original does.
    """
    scoped = lines if work == "all" else lines.filter(F.col("source_work_id") == work)
    counted = nested_count(scoped, ("contributor_id",), "text_unit_id").join(
        contributors.select("contributor_id", "name", "contributor_type"), "contributor_id"
    )
    if not combined:
        return counted
    for field, position in (("contributor_id", 0), ("name", 1)):
        value = F.col(field)
        for old, new in combined.items():
            value = F.when(F.col("contributor_id") == old, new[position]).otherwise(value)
        counted = counted.withColumn(f"_{field}", value)
    merged = F.col("_contributor_id") != F.col("contributor_id")
    counted = counted.withColumn("_type", F.when(merged, "author").otherwise(F.col("contributor_type")))
    return counted.groupBy(
        F.col("_contributor_id").alias("contributor_id"), F.col("_name").alias("name"), F.col("_type").alias("contributor_type")
    ).agg(F.sum("unit_count").alias("unit_count"), F.sum("line_count").alias("line_count"))


def work_summaries(works: DataFrame, lines: DataFrame) -> DataFrame:
    last = lines.groupBy("source_work_id").agg(F.max("page_no").alias("max_page"))
    joined = works.select("source_work_id", "title").join(last, "source_work_id", "left")
    return joined.withColumn("max_page", F.coalesce("max_page", F.lit(1)))


def corpus_info(lines: DataFrame, token_counts: Column, metadata: DataFrame) -> DataFrame:
    """One row: line and token counts next to the release metadata."""
    counts = lines.agg(F.count("*").alias("n"), F.coalesce(F.sum(token_counts), F.lit(0)).alias("m"))
    pairs = counts.select(F.inline(F.array(
        F.struct(F.lit("line_count").alias("key"), F.col("n").cast("string").alias("value")),
        F.struct(F.lit("occurrence_count").alias("key"), F.col("m").cast("string").alias("value")),
    ))).unionByName(metadata.select("key", "value"))
    as_map = pairs.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    return as_map.select(
        F.coalesce(F.col("m")["build_kind"], F.lit("unknown")).alias("build_kind"),
        F.coalesce(F.col("m")["corpus_release_id"], F.lit("")).alias("corpus_release_id"),
        F.col("m")["line_count"].cast("bigint").alias("line_count"),
        F.col("m")["occurrence_count"].cast("bigint").alias("occurrence_count"),
    )


def lookup_in_order(rows: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Requested rows in request order: repeats stay, unknown ids go.  ``requests``: (request_id, ids)."""
    wanted = requests.select("request_id", F.posexplode("ids").alias("position", key))
    return wanted.join(rows, key).orderBy("request_id", "position")


def count_per_parent(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Children per parent, zero included."""
    counted = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def in_curated_order(rows: DataFrame, key: str, sequence: Sequence[str]) -> DataFrame:
    """Adds ``curated_rank``; unlisted keys get 999 and come last.  The list is fixed and short."""
    ranks = F.create_map(*[F.lit(x) for n, name in enumerate(sequence) for x in (name, n)])
    return rows.withColumn("curated_rank", F.coalesce(F.try_element_at(ranks, F.col(key)), F.lit(999)))


# Display groups of contributor types.
CONTRIBUTOR_GROUPS = ("guru", "bhagat", "bhatt")


def contributor_group(kind: Column) -> Column:
    value = F.when(F.contains(F.lower(kind), F.lit(CONTRIBUTOR_GROUPS[0])), CONTRIBUTOR_GROUPS[0])
    for name in CONTRIBUTOR_GROUPS[1:]:
        value = value.when(F.contains(F.lower(kind), F.lit(name)), name)
    return value.otherwise("other")


def classify_contributor(name: Column) -> Column:
    """First matching rule wins; a missing name is a plain contributor."""
    return (
        F.when(name.rlike("(?i)guru"), "guru")
        .when(name.rlike("(?i)bhagat|sheikh|sant"), "bhagat")
        .when(name.rlike("(?i)bhatt"), "bhatt")
        .otherwise("contributor")
    )


def rekey_work(rows: DataFrame, old: str, new: str) -> DataFrame:
    moved = F.when(F.col("source_work_id") == old, new).otherwise(F.col("source_work_id"))
    return rows.withColumn("source_work_id", moved)


def portable_id(work: Column, upstream: Column, own: Column) -> Column:
    return F.when(upstream.isNotNull() & (upstream != ""), F.concat_ws(":", work, upstream)).otherwise(own)
