"""Streaming forms of the append-only results and of duration summaries; an extension, as results arrive while a run lasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofmill.sources.sinks import append_results


def first_results(stream: DataFrame, key: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """Each id's first result; state is dropped once the watermark has passed it."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def append_stream(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append results micro-batch by micro-batch; ids that are saved already are left out, so a replayed batch adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_results(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_latency(stream: DataFrame, time: str, value: str, by: list[str], window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Count, sum and maximum per tumbling window: what partial aggregation keeps in bounded state."""
    rows = stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), *by)
    return rows.agg(F.count(value).alias("count"), F.sum(value).alias("total"), F.max(value).alias("max")).select(F.col("w.start").alias("window_start"), *by, "count", "total", "max")
