"""Release identity, merge, filter, upsert and replace of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import positions
from .validate import ValidationError

BUCKETS = 4096


def row_digest(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the named columns: sorted names, nulls written out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def table_digest(rows: DataFrame, key: str, *columns: str, buckets: int = BUCKETS) -> DataFrame:
    """One row: digest of all rows, independent of their order and placement.

    Rows are hashed into buckets, each bucket's digests are joined in order, then the buckets'.  The
    bucket comes from the digest, so no key can fill one; their number bounds the second level.
    """
    hashed = rows.select(row_digest(key, *columns).alias("d"))
    bucket = F.pmod(F.xxhash64("d"), F.lit(buckets))
    folded = hashed.groupBy(bucket.alias("b"), F.substring("d", 1, 4).alias("p")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("d"), F.count("*").alias("n")
    )
    second = folded.groupBy("b").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ","), 256).alias("d"),
        F.sum("n").alias("n"),
    )
    return second.agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ","), 256).alias("checksum"),
        F.sum("n").alias("rows"),
    )


def release_id(digest: DataFrame, prefix: str, date: str | None = None) -> DataFrame:
    """Same rows, same id; a date is passed in, never taken from the clock."""
    parts = [F.lit(prefix)] + ([F.lit(date[:10])] if date else []) + [F.substring("checksum", 1, 16)]
    return digest.select(F.concat_ws("-", *parts).alias("release_id"), "checksum", "rows")


def snapshot_manifest(files: DataFrame, key: str, content: str, count: Column) -> DataFrame:
    """Per file: checksum and number of records."""
    return files.select(key, F.sha2(F.col(content), 256).alias("checksum"), count.alias("record_count"))


def merge_conflicts(parts: DataFrame, key: str) -> DataFrame:
    """Keys that occur with different content."""
    columns = [c for c in parts.columns if c != key]
    variants = parts.select(key, row_digest(*columns).alias("d")).distinct()
    return variants.groupBy(key).agg(F.count("*").alias("variants")).filter("variants > 1")


def merge(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union by key; equal duplicates collapse, unequal ones raise."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    clash = [r[key] for r in merge_conflicts(union, key).limit(5).collect()]
    if clash:
        raise ValidationError(f"conflicting records: {clash}")
    return union.dropDuplicates([key])


def filter_corpus(works, units, lines, contributors, attributions, wanted: Sequence[str]) -> dict[str, DataFrame]:
    """The chosen works and whatever they still refer to."""
    kept_works = works.filter(F.col("source_work_id").isin(list(wanted)))
    kept_units = units.filter(F.col("source_work_id").isin(list(wanted)))
    unit_ids = kept_units.select("text_unit_id")
    kept_lines = lines.filter(F.col("source_work_id").isin(list(wanted))).join(unit_ids, "text_unit_id", "left_semi")
    kept_attr = attributions.join(unit_ids.withColumnRenamed("text_unit_id", "target_id"), "target_id", "left_semi")
    people = kept_lines.select("contributor_id").union(kept_attr.select("contributor_id")).distinct()
    return {
        "works": kept_works,
        "units": kept_units,
        "lines": kept_lines,
        "attributions": kept_attr,
        "contributors": contributors.join(people, "contributor_id", "left_semi"),
    }


def upsert(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key, by a partial aggregate: a key with very many versions is thinned before
    the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return latest.select(*keys, "r.*")


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows win."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*existing.columns))


def replace_subset(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the groups named in ``new`` are replaced as a whole."""
    groups = new.select(key).distinct()
    return existing.join(groups, key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def first_seen(rows: DataFrame, key: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First record per key in ingest order."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("r")).select(key, "r.*")


def recent(rows: DataFrame, owner: str, key: str, time: str, kept: int, tie: str) -> DataFrame:
    """Latest row per (owner, key), newest ``kept`` per owner."""
    latest = upsert(rows, [owner, key], [time, tie])
    order = W.partitionBy(owner).orderBy(F.col(time).desc(), F.col(tie).desc())
    return latest.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= kept)


def accepted_order(rows: DataFrame, group: str, value: Column, order: Sequence[str]) -> DataFrame:
    """Declared number where it is one, else the running number of the row in its group, ordered by ``order``."""
    declared = rows.withColumn("_declared", value.try_cast("double"))
    placed = positions(declared, group, order, "_running")
    return placed.withColumn("effective_order", F.coalesce("_declared", (F.col("_running") + 1).cast("double"))).drop("_declared", "_running")
