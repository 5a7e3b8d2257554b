"""Search facets as filters and semi joins on the line table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Facets:
    work: str = "all"
    heading: str = ""
    contributors: tuple[str, ...] = ()
    annotated_only: bool = False
    coverage: str = ""  # "", any, translation, word-analysis, extended
    layer_types: tuple[str, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class Annotations:
    """members: (line_id, has_translation); terms: (line_id); layers: (text_unit_id, content_type)."""

    members: DataFrame
    terms: DataFrame
    layers: DataFrame


def scope(rows: DataFrame, work: str) -> DataFrame:
    """No predicate at all for 'all', so nothing is left for the optimizer to fold."""
    return rows if work == "all" else rows.filter(F.col("source_work_id") == work)


def facet_filter(lines: DataFrame, facets: Facets, annotations: Annotations | None = None) -> DataFrame:
    rows = scope(lines, facets.work)
    if facets.heading:
        rows = rows.filter(F.col("heading") == facets.heading)
    if facets.contributors:
        rows = rows.filter(F.col("contributor_id").isin(list(facets.contributors)))
    if not (facets.annotated_only or facets.coverage or facets.layer_types):
        return rows
    if annotations is None:
        raise ValueError("a facet on annotations needs the annotation tables")
    coverage = facets.coverage or "any"
    if coverage == "translation":
        return rows.join(annotations.members.filter("has_translation"), "line_id", "left_semi")
    if coverage == "word-analysis":
        return rows.join(annotations.terms, "line_id", "left_semi")
    if coverage == "extended" or facets.layer_types:
        layers = annotations.layers
        if facets.layer_types:
            layers = layers.filter(F.col("content_type").isin(list(facets.layer_types)))
        return rows.join(layers, "text_unit_id", "left_semi")
    return any_annotation(rows, annotations)


def any_annotation(lines: DataFrame, annotations: Annotations) -> DataFrame:
    """Line is a member, or has a term, or its unit has a layer; distinct keys keep rows single."""
    by_line = annotations.members.select("line_id").union(annotations.terms.select("line_id")).distinct()
    by_unit = annotations.layers.select("text_unit_id").distinct()
    flagged = lines.join(by_line.withColumn("_line", F.lit(True)), "line_id", "left").join(
        by_unit.withColumn("_unit", F.lit(True)), "text_unit_id", "left"
    )
    return flagged.filter(F.col("_line").isNotNull() | F.col("_unit").isNotNull()).drop("_line", "_unit")


def coverage_flags(lines: DataFrame, annotations: Annotations, second: DataFrame) -> DataFrame:
    """Three flags per line: provider translation, terms, second provider's translation."""
    out = lines.select("line_id")
    for name, keys in (
        ("has_translation", annotations.members.filter("has_translation")),
        ("has_terms", annotations.terms),
        ("has_second_translation", second),
    ):
        marked = keys.select("line_id").distinct().withColumn(name, F.lit(True))
        out = out.join(marked, "line_id", "left").withColumn(name, F.col(name).isNotNull())
    return out
