"""Read extraction over a stream: the tests of candidate reads hold no state, so they run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..operators.reference import good_candidates


def clean_stream(reads: DataFrame, time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Streaming reads (id, seq, ...) that aren't of low complexity; ids that come again within the watermark go, if a time column is named."""
    df = reads.withWatermark(time, late).dropDuplicatesWithinWatermark(["id"]) if time else reads
    return df.where(~dna.low_complexity(F.col("seq")))


def candidate_batches(reads: DataFrame, ref: DataFrame, sink, need: int = 27, k: int = 9, checkpoint: str | None = None):
    """Reads that hit the reference, micro-batch by micro-batch: sink(df, epoch) gets those of an epoch. Returns the started query."""
    writer = clean_stream(reads).writeStream.foreachBatch(lambda df, epoch: sink(good_candidates(df, ref, need, k), epoch))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()
