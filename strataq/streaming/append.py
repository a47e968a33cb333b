"""Feeding a dataset from a stream: every micro-batch is one append.

After a restart, open the writer with ``resume=True`` and run the stream on the same
checkpoint: neither loses nor repeats a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strataq.sources.segment import SegmentWriter


def append_batches(writer: SegmentWriter):
    """Function for ``DataStreamWriter.foreachBatch``.  The writer notes the number of
    each batch on disk with the append itself, so a batch that is delivered again is
    left out, by the same writer or by one that resumes after a restart."""
    return writer.append


def run_once(stream: DataFrame, writer: SegmentWriter, checkpoint: str) -> None:
    """Append everything that is available now, then stop."""
    query = stream.writeStream.foreachBatch(append_batches(writer)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
