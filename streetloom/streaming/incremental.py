"""Streams of detections: counts of cells and days as they arrive, hotspots after each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hotspots
from ..operators.analytics import utc_day
from ..operators.store import attribute


def cell_counts(stream: DataFrame) -> DataFrame:
    """Running count and last time of each cell (update or complete mode); points on edges count as in batches."""
    x = attribute(stream).where("cell is not null")
    return x.groupBy("cell").agg(F.count("*").alias("detection_count"), F.max("detected_at").alias("last_scanned"))


def daily(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Count of each day; a day is final when the watermark has passed it."""
    x = stream.withColumn("at", F.timestamp_seconds("detected_at")).withWatermark("at", late)
    return x.groupBy(F.window("at", "1 day")).agg(F.count("*").alias("count")).select(utc_day(F.unix_seconds("window.start")).alias("date"), "count")


def refresh_hotspots(stream: DataFrame, store: str, target: str, as_of: int, checkpoint: str):
    """After each batch: the batch is appended to ``store``, hotspots are made anew from it and written to ``target``.

    A batch that is repeated after a failure goes to the same folder, so nothing counts twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{store}/batch={number}")
        rows = df.sparkSession.read.parquet(store)
        hotspots.snapshot(rows, hotspots.cluster(rows), as_of).write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
