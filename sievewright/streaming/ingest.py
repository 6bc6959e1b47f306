"""Streams into an index: every micro-batch is appended, and compaction follows when it is due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import BitmapIndex
from ..sources.storage import Store


def ingest(stream: DataFrame, index: BitmapIndex, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the rows of a stream. A batch that comes again after a failure is told by its stream and number and left out.

    The stream is known by the id in its checkpoint: another stream, or a new checkpoint, counts for itself. Number and rows
    are one commit.
    """
    folder = Store(index.spark, checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        index.append(batch, folder.read_json("metadata")["id"], number)
        if index.manifest["pending_rows"] >= index.manifest["threshold"]:
            index.compact()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
