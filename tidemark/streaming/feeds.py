"""Change feeds and requests as streams: each once, applied to a table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.change_feed import ChangeTable, changes


def once(stream: DataFrame, keys: list[str], at: str, lateness: str) -> DataFrame:
    """Each key once; redelivery is remembered as long as the watermark says."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def apply_changes(stream: DataFrame, folder: str, checkpoint: str):
    """Append a feed's changes to the ``ChangeTable`` in a folder, a batch each; replayed batches have no effect.

    stream: stream_name, record_key, operation, source_sequence, after_image.
    """

    def write(batch: DataFrame, number: int) -> None:
        feed = changes(batch, "stream_name", "record_key", "operation", "source_sequence", "after_image")
        ChangeTable(batch.sparkSession, folder).append(feed, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_of(spark, folder: str) -> DataFrame:
    """The table that stands after all batches so far."""
    return ChangeTable(spark, folder).state()
