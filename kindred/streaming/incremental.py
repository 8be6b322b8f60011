"""Incremental scans as streams: new files are upserted into the entries table batch by batch; windows of event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kindred.operators.lineage import own_folder
from kindred.sources import store


def read_items(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def upsert_stream(items: DataFrame, table: str, checkpoint: str, order: str = "mtime", every: str | None = None) -> StreamingQuery:
    """Each batch replaces the entries of its ids in the sharded table (``store.load`` reads it); of rows with one id the latest counts.

    The manifest keeps the last batch's number, so a batch that is repeated after a failure is written once. Only touched shards are
    rewritten. A table whose manifest names shards that are gone raises an error instead of starting anew. Runs over what is there, or
    with ``every`` (an interval) until it is stopped; a later run goes on where the checkpoint is.
    """

    def write(batch: DataFrame, number: int) -> None:
        if number > 0 and not store.exists(batch.sparkSession, f"{table}/_manifest.json"):
            raise FileNotFoundError(f"the checkpoint is at batch {number}, but there is no table at {table}")
        latest = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
        store.save(latest, table, batch=number)

    writer = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(begin, event_type, n, total) of events (ts, event_type, value) by windows of event time; works on streams and tables."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = (events.withWatermark("ts", delay) if events.isStreaming else events).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def run_to_table(spark: SparkSession, rows: DataFrame, name: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of a stream over what is there, written as Parquet by the executors and read again."""
    folder = own_folder(spark, name)
    run = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    return then(out) if then is not None else out
