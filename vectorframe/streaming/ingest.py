"""Continuous ingest: micro-batches appended to a table, visible at once, and a stream of its log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(engine, database: str, table: str, stream: DataFrame, checkpoint: str, upsert: bool = False, interval: str | None = None, rebuild_every: int | None = None) -> StreamingQuery:
    """Append each micro-batch of ``stream`` (the table's columns) by the engine's bulk insert.

    A batch that is delivered again is recognised by its number and left out. With
    ``rebuild_every``, the table is rebuilt after that many batches.
    """

    def append(batch: DataFrame, number: int) -> None:
        if engine.batch_done(database, table, checkpoint, number):
            return
        engine.insert_frame(database, table, batch, upsert=upsert, batch=(checkpoint, number))
        if rebuild_every and (number + 1) % rebuild_every == 0:
            engine.rebuild(database, table)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def changes(spark: SparkSession, log_uri: str) -> DataFrame:
    """The write-ahead log of a table as a file stream of (id, type, payload)."""
    return spark.readStream.schema("id long, type string, payload string").json(log_uri)
