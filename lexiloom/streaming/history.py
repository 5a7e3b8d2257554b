"""Running reading history: latest visit per (user, unit), newest hundred per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.release import recent, upsert

KEPT = 100


def record_visits(spark: SparkSession, visits: DataFrame, target: str, checkpoint: str) -> None:
    """``visits``: a stream of user_id, unit, ts, event_id.

    Each batch is reduced to one row per key and written to its own folder; state is never rewritten,
    and a repeated batch overwrites itself.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        latest = upsert(batch, ["user_id", "unit"], ["ts", "event_id"])
        latest.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = visits.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current_history(spark: SparkSession, target: str, kept: int = KEPT) -> DataFrame:
    rows = spark.read.parquet(target).drop("batch")
    return recent(rows, "user_id", "unit", "ts", kept, "event_id")
