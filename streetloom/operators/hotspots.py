"""Hotspots: clusters around the newest detections, scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CLUSTER_RADIUS_M, MAX_CLUSTER_INPUT, SCORE_WEIGHTS
from .graph import cut, leaders, numbered
from .spatial import radius_join


def cluster(detections: DataFrame, radius_m: float = CLUSTER_RADIUS_M, newest: int | None = MAX_CLUSTER_INPUT) -> DataFrame:
    """(id, leader): newest first (then by id), a row leads a cluster unless an earlier leader is within the radius.

    ``newest`` is the size of the service's own window; None clusters everything.
    """
    d = detections.select("id", "lat", "lng", "detected_at")
    if newest is not None:
        d = d.orderBy(F.desc("detected_at"), "id").limit(newest)
    d = cut(d)
    # rows of one place have the same neighbours, so the earliest of them stands for all
    rank = F.struct((-F.col("detected_at")).alias("t"), F.col("id").alias("i"))
    places = cut(d.groupBy("lat", "lng").agg(F.min(rank).alias("rank")))
    a = places.select(F.col("rank").alias("ra"), "lat", "lng")
    b = places.select(F.col("rank").alias("rb"), "lat", "lng")
    links = radius_join(a, b, radius_m, keep=F.col("rb") < F.col("ra")).select(F.col("ra.i").alias("a"), F.col("rb.i").alias("b"), "rb")
    found = leaders(places.select(F.col("rank.i").alias("node"), "rank"), links, directed=True)
    at = places.select(F.col("rank.i").alias("node"), "lat", "lng").join(found, "node").select("lat", "lng", "leader")
    return d.join(at, ["lat", "lng"]).select("id", "leader")


def score(area: Column, n: Column, confidence: Column, newest: Column, images: Column, as_of: int) -> Column:
    """Weighted sum of capped shares; recency fades over 90 days, and a missing time counts as 90 days."""
    w = SCORE_WEIGHTS
    age = F.when(newest > 0, (F.lit(as_of) - newest) / 86400.0).otherwise(F.lit(90.0))
    one = F.lit(1.0)
    return (
        F.lit(w["area"]) * F.least(F.coalesce(area, F.lit(0.0)) / 20.0, one)
        + F.lit(w["observations"]) * F.least(n / 20.0, one)
        + F.lit(w["confidence"]) * confidence
        + F.lit(w["recency"]) * F.greatest(F.lit(0.0), 1.0 - age / 90.0)
        + F.lit(w["repeat"]) * F.least(images / 5.0, one)
    )


def priority(s: Column) -> Column:
    return F.when(s > 0.7, "high").when(s > 0.4, "medium").otherwise("low")


def summaries(detections: DataFrame, clusters: DataFrame, as_of: int) -> DataFrame:
    """One row per cluster: place, counts, score and priority."""
    x = detections.join(clusters, "id").groupBy("leader").agg(
        F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.avg("confidence").alias("avg_confidence"), F.count("*").alias("detection_count"),
        F.countDistinct("image_id").alias("images"), F.max("waste_area_pct").alias("area"), F.max("detected_at").alias("newest"), F.min("detected_at").alias("first_seen"),
        F.max(F.when(F.col("id") == F.col("leader"), F.col("detected_at"))).alias("lead_at"),
    )
    s = score(F.col("area"), F.col("detection_count"), F.col("avg_confidence"), F.col("newest"), F.col("images"), as_of)
    return x.withColumn("score", s).withColumn("priority", priority(F.col("score")))


def snapshot(detections: DataFrame, clusters: DataFrame, as_of: int, exact: bool = False) -> DataFrame:
    """The full table of hotspots, named by the order of their leaders; rounding happens here only, and with ``exact``
    the values before it are in a struct of that name.

    Ranks are counted by ranges, so any number of clusters can be named.
    """
    x = numbered(summaries(detections, clusters, as_of), [F.desc("lead_at"), F.asc("leader")], "place")
    text = F.format_string("%d waste observations near (%.4f, %.4f)", "detection_count", "lat", "lng")
    return x.select(
        F.concat(F.lit("hotspot-"), F.col("place").cast("string")).alias("id"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.lit(CLUSTER_RADIUS_M).alias("radius_m"),
        "priority", F.round("score", 4).alias("score"), "detection_count", F.col("newest").alias("last_seen"), "first_seen", F.round("avg_confidence", 4).alias("avg_confidence"), text.alias("description"),
        *([F.struct("lat", "lng", "score", "avg_confidence").alias("exact")] if exact else []),
    )


def near(hotspots: DataFrame, lat: float, lng: float, radius_m: float = CLUSTER_RADIUS_M) -> DataFrame:
    """The best hotspot within the radius of a place."""
    from ..functions.geo import haversine_m

    d = haversine_m(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    return hotspots.where(d <= radius_m).orderBy(F.desc("score"), "id").limit(1)


def ranked(hotspots: DataFrame) -> DataFrame:
    """Hotspots as the service lists them: by falling score, then by id."""
    return hotspots.orderBy(F.desc("score"), "id")
