"""Finding panoramas: candidates away from test places, summaries of sequences and surveys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_bounds
from .spatial import nearest_distance, radius_join
from .store import latest


def unique(found: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each id, the last in ``order``."""
    return latest(found, ["id"], order)


def candidates(found: DataFrame, test_points: DataFrame, reviewed: DataFrame, test_sequences: DataFrame, min_distance_m: float = 300) -> DataFrame:
    """``found`` with ``nearest_test_m`` and ``reason``: why a panorama is no candidate (first rule wins), or ``safe``."""
    x = nearest_distance(found, test_points, F.col("id"))
    x = x.join(reviewed.select("id").distinct().withColumn("_r", F.lit(True)), "id", "left")
    x = x.join(test_sequences.select("sequence").distinct().withColumn("_s", F.lit(True)), "sequence", "left")
    reason = F.when(F.col("_r"), "already reviewed").when(F.col("_s"), "test sequence").when(F.col("nearest_m") < min_distance_m, f"within {min_distance_m:g} m of a test panorama").otherwise("safe")
    return x.withColumn("reason", reason).withColumnRenamed("nearest_m", "nearest_test_m").drop("_r", "_s")


def sequence_summary(panoramas: DataFrame) -> DataFrame:
    """Panoramas, creator of the first and years of each sequence, the longest first."""
    year = F.year(F.timestamp_millis("captured_at"))
    x = panoramas.groupBy("sequence").agg(F.count("*").alias("panoramas"), F.min_by("creator", F.struct("captured_at", "id")).alias("creator"), F.sort_array(F.collect_set(year)).alias("years"))
    return x.orderBy(F.desc("panoramas"), "sequence")


def surveyed(panoramas: DataFrame, areas: DataFrame, radius_m: float = 1500) -> DataFrame:
    """Panoramas within the radius (whole metres) of each area, with ``area`` and ``metres``."""
    places = areas.select("area", F.col("a_lat").alias("lat"), F.col("a_lng").alias("lng"))
    inside = panoramas.where(in_bounds(F.col("lat"), F.col("lng")) & F.col("is_pano"))
    x = radius_join(places, inside, radius_m + 0.5).withColumn("metres", F.rint("distance_m").cast("long"))
    return x.where(F.col("metres") <= radius_m).drop("lat", "lng", "distance_m")


def survey_union(panoramas: DataFrame, areas: DataFrame, radius_m: float = 1500) -> DataFrame:
    """Each panorama that some area finds once, under the first area by name."""
    x = surveyed(panoramas, areas, radius_m)
    return x.groupBy("id").agg(F.min_by(F.struct("area", "metres"), "area").alias("f"), F.count("*").alias("areas")).select("id", "f.*", "areas")


def first_seen(ids: DataFrame, key: str, position: str) -> DataFrame:
    """Each key once, where it comes first, in that order."""
    return ids.groupBy(key).agg(F.min(position).alias(position)).orderBy(position)


def places_found(raw: DataFrame) -> DataFrame:
    """Geocoder rows ``(place_id, display_name, lat, lon)``, numbers as text, as places inside the service area."""
    x = raw.select(F.col("place_id").cast("string").alias("id"), F.col("display_name").alias("name"), F.expr("try_cast(lat as double)").alias("lat"), F.expr("try_cast(lon as double)").alias("lng"))
    return x.where(in_bounds(F.col("lat"), F.col("lng")))


def search_key(text: Column) -> Column:
    """The key under which a place search is kept."""
    return F.concat(F.lit("search:"), F.trim(F.lower(text)))


def survey(panoramas: DataFrame, areas: DataFrame, radius_m: float = 1500, limit: int = 500) -> DataFrame:
    """Per area: panoramas within the radius, whether the count may be capped, and creators; ``areas(area, a_lat, a_lng)`` is a short list."""
    x = surveyed(panoramas, areas, radius_m)
    found = x.groupBy("area").agg(F.count("*").alias("found"), F.countDistinct("sequence").alias("sequences"), F.min("metres").alias("nearest_m"))
    y = areas.select("area").join(found, "area", "left").na.fill(0, ["found", "sequences"])
    return y.withColumn("possibly_capped", F.col("found") >= limit)


def sample_grid(spark, west: float, south: float, east: float, north: float, step: float) -> DataFrame:
    """Search points every ``step`` degrees, edges included."""
    ny, nx = int((north - south) / step + 1e-9) + 1, int((east - west) / step + 1e-9) + 1
    y = spark.range(ny).select((F.lit(south) + F.col("id") * step).alias("lat"))
    return y.crossJoin(F.broadcast(spark.range(nx).select((F.lit(west) + F.col("id") * step).alias("lng"))))


def with_defaults(raw: DataFrame) -> DataFrame:
    """Catalogue records as panoramas: missing fields get defaults, coordinates come from GeoJSON order."""
    point = F.coalesce("computed_geometry", "geometry")
    return raw.select(
        F.col("id").cast("string").alias("id"), F.col("p")[1].alias("lat"), F.col("p")[0].alias("lng"), F.col("captured_at"), F.coalesce("creator.username", F.lit("")).alias("creator"),
        F.coalesce("is_pano", F.lit(False)).alias("is_pano"), F.coalesce("thumb_1024_url", F.lit("")).alias("thumbnail"), "sequence",
    ) if "p" in raw.columns else with_defaults(raw.withColumn("p", point.getField("coordinates")))
