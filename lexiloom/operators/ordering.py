"""Positions of rows in large groups, without a task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def positions(rows: DataFrame, group: str, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Adds the 0-based position of a row in its group, in the order of ``order`` (nulls first; ties in any order, but distinct).

    Rows are cut into ranges of (group, order) of about the same size and written once, so that the cut is the same for
    everyone who reads it.  A position is that within the range plus the rows of the group in earlier ranges; of these there
    is one count per range, so a group with most rows is as many tasks as it has ranges.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(width, group, *order).withColumn("_range", F.spark_partition_id())
    kept = cut_lineage(ranged, "ranges")
    counts = kept.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy(group, "_range").orderBy(*order)
    local = kept.withColumn("_local", F.row_number().over(inside) - 1)
    joined = local.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(name, F.col("_start") + F.col("_local")).drop("_range", "_local", "_group", "_r", "_start")
