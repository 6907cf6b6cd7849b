"""Domain tables projected from the generic tables by integer arithmetic, and plain table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-31 00:00:00 UTC
AS_OF = 1706659200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    x1, y1 = ((e * 37) % 900).cast("double") / 1000.0, ((e * 53) % 900).cast("double") / 1000.0
    views = F.array(*[F.lit(v) for v in ("front", "right", "back", "left", "up", "down")])
    models = F.array(*[F.lit(v) for v in ("detector-a", "detector-b", "detector-c")])
    return table(spark, sf_dir, "events").select(
        "event_id",
        e.cast("string").alias("id"),
        F.concat(F.lit("pano-"), F.col("user_id").cast("string")).alias("image_id"),
        (F.lit(18.40) + ((e * 7919) % 3000).cast("double") / 10000.0).alias("lat"),
        (F.lit(73.70) + ((e * 104729) % 3500).cast("double") / 10000.0).alias("lng"),
        F.col("event_type").alias("label"),
        F.least(F.col("value") / 200.0, F.lit(1.0)).alias("confidence"),
        (((e * 31) % 1000).cast("double") / 100.0).alias("waste_area_pct"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("detected_at"),
        F.element_at(views, (e % 6 + 1).cast("int")).alias("view_id"),
        F.element_at(models, (e % 3 + 1).cast("int")).alias("model_used"),
        "user_id",
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + (10 + (e * 13) % 90).cast("double") / 1000.0).alias("x2"),
        (y1 + (10 + (e * 17) % 90).cast("double") / 1000.0).alias("y2"),
    )


#: The same projection for the SQL side.
DET_SQL = """det AS (SELECT event_id, CAST(event_id AS VARCHAR) AS id, 'pano-' || user_id AS image_id,
  18.40::DOUBLE + CAST((event_id*7919) % 3000 AS DOUBLE) / 10000.0::DOUBLE AS lat, 73.70::DOUBLE + CAST((event_id*104729) % 3500 AS DOUBLE) / 10000.0::DOUBLE AS lng,
  event_type AS label, least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS confidence, CAST((event_id*31) % 1000 AS DOUBLE) / 100.0::DOUBLE AS waste_area_pct,
  CAST(floor(epoch(ts)) AS BIGINT) AS detected_at, ['front','right','back','left','up','down'][CAST(event_id % 6 + 1 AS INT)] AS view_id,
  ['detector-a','detector-b','detector-c'][CAST(event_id % 3 + 1 AS INT)] AS model_used, user_id,
  CAST((event_id*37) % 900 AS DOUBLE) / 1000.0::DOUBLE AS x1, CAST((event_id*53) % 900 AS DOUBLE) / 1000.0::DOUBLE AS y1,
  CAST((event_id*37) % 900 AS DOUBLE) / 1000.0::DOUBLE + CAST(10 + (event_id*13) % 90 AS DOUBLE) / 1000.0::DOUBLE AS x2,
  CAST((event_id*53) % 900 AS DOUBLE) / 1000.0::DOUBLE + CAST(10 + (event_id*17) % 90 AS DOUBLE) / 1000.0::DOUBLE AS y2 FROM events)"""


def panoramas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image: place and time of its first detection, sequence by user."""
    first = F.struct("event_id", "lat", "lng", "detected_at")
    x = detections(spark, sf_dir).groupBy("image_id", "user_id").agg(F.min(first).alias("f"))
    return x.select(
        F.col("image_id").alias("id"), "f.lat", "f.lng", (F.col("f.detected_at") * 1000).alias("captured_at"),
        F.concat(F.lit("creator-"), (F.col("user_id") % 7).cast("string")).alias("creator"), (F.col("user_id") % 11 != 0).alias("is_pano"),
        F.concat(F.lit("seq-"), (F.col("user_id") % 40).cast("string")).alias("sequence"), "user_id",
    )


PANO_SQL = """pano AS (SELECT image_id AS id, arg_min(lat, event_id) AS lat, arg_min(lng, event_id) AS lng, arg_min(detected_at, event_id) * 1000 AS captured_at,
  'creator-' || (user_id % 7) AS creator, user_id % 11 <> 0 AS is_pano, 'seq-' || (user_id % 40) AS sequence, user_id FROM det GROUP BY image_id, user_id)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, idx, confidence and box."""
    return detections(spark, sf_dir).select(F.col("image_id").alias("image"), F.col("event_id").alias("idx"), "confidence", "x1", "y1", "x2", "y2")


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of three of four detections, moved a little."""
    d = (F.col("event_id") % 7).cast("double") / 1000.0
    return detections(spark, sf_dir).where("event_id % 4 <> 0").select(
        F.col("image_id").alias("image"), F.col("event_id").alias("idx"), (F.col("x1") + d).alias("x1"), (F.col("y1") + d).alias("y1"), (F.col("x2") + d).alias("x2"), (F.col("y2") + d).alias("y2")
    )


PRED_SQL = "pred AS (SELECT image_id AS image, event_id AS idx, confidence, x1, y1, x2, y2 FROM det)"
TRUTH_SQL = """truth AS (SELECT image_id AS image, event_id AS idx, x1 + CAST(event_id % 7 AS DOUBLE) / 1000.0::DOUBLE AS x1, y1 + CAST(event_id % 7 AS DOUBLE) / 1000.0::DOUBLE AS y1,
  x2 + CAST(event_id % 7 AS DOUBLE) / 1000.0::DOUBLE AS x2, y2 + CAST(event_id % 7 AS DOUBLE) / 1000.0::DOUBLE AS y2 FROM det WHERE event_id % 4 <> 0)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of reviews: several revisions of each view, as a review folder would grow them."""
    e = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in ("litter", "clean", "skip", "unreviewed")]), (e % 4 + 1).cast("int"))
    return detections(spark, sf_dir).select(
        F.concat("image_id", F.lit("_"), "view_id").alias("view"), e.alias("revision"), status.alias("status"),
        F.when(e % 5 != 0, F.array(F.array("x1", "y1", "x2", "y2"))).otherwise(F.array().cast("array<array<double>>")).alias("boxes"),
        F.concat(F.lit("reviewer-"), (e % 3).cast("string")).alias("reviewer"), F.when(e % 2 == 0, "seen").otherwise(" ").alias("notes"),
    )


REVIEW_SQL = """review AS (SELECT image_id || '_' || view_id AS view, event_id AS revision, ['litter','clean','skip','unreviewed'][CAST(event_id % 4 + 1 AS INT)] AS status,
  CASE WHEN event_id % 5 <> 0 THEN [[x1, y1, x2, y2]] ELSE [] END AS boxes, 'reviewer-' || (event_id % 3) AS reviewer, CASE WHEN event_id % 2 = 0 THEN 'seen' ELSE ' ' END AS notes FROM det)"""
