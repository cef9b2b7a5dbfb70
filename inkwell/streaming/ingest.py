"""Structured Streaming into a stored index: each micro-batch is one epoch, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.store import IndexWriter


def ingest(stream: DataFrame, writer: IndexWriter, checkpoint: str, mode: str = "update", **trigger) -> StreamingQuery:
    """Updates (or inserts) of a stream of documents; a batch delivered again changes nothing."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            writer.batch(**{mode: batch}, batch_id=batch_id)

    trigger = trigger or {"availableNow": True}
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class Progress(StreamingQueryListener):
    """Counts of what a stream has done."""

    def __init__(self):
        self.batches = self.rows = 0
        self.ended = False

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended = True
