"""Incremental ingest of landed pages: only new files are read, pages are taken once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.snapshots import PAGE, canonical_lines, flatten_pages, require_ids, split_gaps

COPY = "page_key string, file string, body string"
TAKEN = "file string"


def landed_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).json(path)
    return pages.withColumn("file", F.col("_metadata.file_path"))


def _first_copy(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The copy with the smallest (file, body) of a page not taken before; copies are looked at one batch at a time."""
    if state.exists:
        return
    best = None
    for part in parts:
        if len(part):
            one = min(zip(part["file"], part["body"]))
            best = one if best is None else min(best, one)
    if best is not None:
        state.update((best[0],))
        yield pd.DataFrame({"page_key": [key[0]], "file": [best[0]], "body": [best[1]]})


def taken_once(pages: DataFrame) -> DataFrame:
    """Every page once over the whole stream: of the copies in one batch that of the smallest file, later copies never.

    What was taken is state of the stream, one small row per page, so a batch costs what it holds and earlier pages are not
    read.  On a cluster keep it on disk (RocksDB as ``spark.sql.streaming.stateStore.providerClass``).  A page without
    source or number is known by its file.
    """
    named = F.col("source.sourceId").isNotNull() & F.col("source.pageNo").isNotNull()
    key = F.when(named, F.to_json(F.struct("source.sourceId", "source.pageNo"))).otherwise(F.col("file"))
    copies = pages.select(key.alias("page_key"), "file", F.to_json(F.struct("source", "page")).alias("body"))
    return copies.groupBy("page_key").applyInPandasWithState(_first_copy, COPY, TAKEN, "append", GroupStateTimeout.NoTimeout)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Runs over everything landed since the last run, then stops.

    A batch is evaluated once: its pages are written to a folder of their own, and lines and gaps are made from what was
    written.  A batch that is repeated after a failure overwrites its folders.
    """
    body = "source " + PAGE["source"].dataType.simpleString() + ", page " + PAGE["page"].dataType.simpleString()

    def take(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        place = f"{target}/pages/batch={batch_id}"
        batch.write.mode("overwrite").parquet(place)
        written = session.read.schema(COPY).parquet(place)
        pages = written.select("file", F.from_json("body", body).alias("b")).select("file", "b.source", "b.page")
        verses = require_ids(flatten_pages(pages))
        kept, gaps = split_gaps(canonical_lines(verses), "text")
        kept.write.mode("overwrite").parquet(f"{target}/lines/batch={batch_id}")
        gaps.write.mode("overwrite").parquet(f"{target}/gaps/batch={batch_id}")

    query = (
        taken_once(landed_pages(spark, source))
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
