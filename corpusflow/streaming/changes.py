"""Change events as a stream, and tables kept up to date by it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.tables import refresh_by_events
from ..schemas import EVENT


def event_stream(spark: SparkSession, folder: str, since: str | None = None, kinds: Sequence[str] | None = ("added", "updated", "removed"), files_per_batch: int = 100) -> DataFrame:
    """Events of a store's folder `events`, run by run as they arrive."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).option("basePath", folder).parquet(folder)
    rows = rows if since is None else rows.where(F.col("run_id") > since)
    return rows if kinds is None else rows.where(F.col("event").isin(*kinds))


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by kind and window of their time; state of windows older than `late` is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event").agg(F.count(F.lit(1)).alias("n"))


def refresh(events: DataFrame, load: Callable[[], DataFrame], fresh: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], None], checkpoint: str, key: str = "doc_id") -> DataStreamWriter:
    """Once over all that has arrived: each batch of events replaces its documents' rows in a table.

    load gives the table, fresh makes new rows of the changed documents, save writes the whole. A batch that is delivered
    again replaces the same rows by the same, so its effect is that of one.
    """

    def batch(changes: DataFrame, _: int) -> None:
        last = changes.groupBy(key).agg(F.max_by("event", F.struct("run_id", "ts")).alias("event")).persist()
        save(refresh_by_events(load(), last, fresh(last.where("event <> 'removed'")), key))
        last.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
