"""Sessions of events in a stream: runs of a key's rows without a longer gap, merged across batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_totals(events: DataFrame, key: str, at: str, gap: str, late: str, *totals: Column) -> DataFrame:
    """key, start, end (exclusive: last time plus the gap) and totals of each session; for streams and for batches alike.

    A stream gives a session when the watermark (`late` behind the latest row) has passed its end, so rows that are late by
    less than that still join it or bring two sessions together; later rows are dropped. State is the open sessions. Rows with
    a null key or time are left out."""
    rows = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    if events.isStreaming:
        rows = rows.withWatermark(at, late)
    made = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(*totals)
    return made.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in made.columns if c not in (key, "w")])


def drained(stream: DataFrame, out: str, checkpoint: str):
    """Append what there is of a stream to a Parquet table."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
