"""Models and label counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(rows: DataFrame, model, sink, checkpoint: str):
    """Starts a query that gives `sink` each micro-batch's evaluated rows; group_item must come with the stream."""
    return rows.writeStream.foreachBatch(lambda batch, number: sink(model.evaluate(batch), number)).option("checkpointLocation", checkpoint).start()


def label_counts(events: DataFrame, time_col: str = "ts", label_col: str = "event_type", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Vertices by window and label; rows later than `late` are left out of windows that have closed. Works on tables too."""
    by = events.withWatermark(time_col, late) if events.isStreaming else events
    return by.groupBy(F.window(time_col, window).alias("w"), F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "label", "n")
