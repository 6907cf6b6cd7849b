"""Dashboard reads over detections, hotspots and the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import HIGH_CONFIDENCE, MEDIUM_CONFIDENCE

LEVELS = ("high", "medium", "low")


def severity(confidence: Column) -> Column:
    return F.when(confidence >= HIGH_CONFIDENCE, "high").when(confidence >= MEDIUM_CONFIDENCE, "medium").otherwise("low")


def severity_with_area(confidence: Column, area: Column) -> Column:
    """Confidence or area decides; no area is area 0."""
    a = F.coalesce(area, F.lit(0.0))
    return F.when((confidence >= HIGH_CONFIDENCE) | (a > 5), "high").when((confidence >= MEDIUM_CONFIDENCE) | (a > 2), "medium").otherwise("low")


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def with_severity(df: DataFrame, level: str | None) -> DataFrame:
    """Rows of one severity; an unknown level filters nothing."""
    return df.where(F.col("severity") == level) if level in LEVELS else df


def severity_counts() -> list[Column]:
    """One count per level, 0 where there is none."""
    return [F.count_if(F.col("severity") == x).alias(x) for x in LEVELS]


def utc_day(seconds: Column) -> Column:
    """The date in UTC as text, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")


def short_day(date: Column) -> Column:
    """Month and day of a date as charts label them."""
    return F.substring(date, 6, 5)


def shown_date(millis: Column) -> Column:
    """The day of a photograph as the viewer shows it: day, short month, year, in UTC."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / 86_400_000).cast("int"))
    return F.date_format(day, "d MMM yyyy")


def shown_percent(share: Column) -> Column:
    """A share of 1 in whole per cent."""
    return F.format_string("%d%%", F.floor(share * 100 + 0.5).cast("long"))


def css_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box from 0 to 1 as the left, top, width and height of its frame in per cent."""
    return F.struct(*[(v * 100).alias(n) for n, v in (("left", x1), ("top", y1), ("width", x2 - x1), ("height", y2 - y1))])


def latest_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The jobs started last, newest first."""
    return jobs.orderBy(F.desc("started_at"), "id").limit(limit)


def daily_counts(df: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    return df.where(F.col("detected_at") >= as_of - days * 86400).groupBy(utc_day(F.col("detected_at")).alias("date")).agg(F.count("*").alias("count"))


def coverage(cells: DataFrame) -> DataFrame:
    """Scanned and all cells, and the scanned share in per cent (of at least one cell)."""
    x = cells.agg(F.count_if("scanned").alias("areas_scanned"), F.count("*").alias("areas_total"))
    share = F.col("areas_scanned") / F.when(F.col("areas_total") == 0, 1).otherwise(F.col("areas_total")) * 100
    return x.withColumn("coverage_pct", F.round(share, 1))


def stats(detections: DataFrame, hotspots: DataFrame, cells: DataFrame, as_of: int) -> DataFrame:
    """One row with everything that the dashboard shows; detections are read twice, for totals and for days."""
    a = detections.agg(F.count("*").alias("total_detections"), F.countDistinct("image_id").alias("total_scans"), *severity_counts())
    h = hotspots.agg(F.count("*").alias("hotspot_count"), F.count_if(F.col("priority") == "high").alias("high_priority"))
    d = daily_counts(detections, as_of).agg(F.array_sort(F.collect_list(F.struct("date", "count"))).alias("daily_counts"))
    return a.crossJoin(h).crossJoin(coverage(cells).drop("coverage_pct")).crossJoin(d)  # one row each


def model_usage(df: DataFrame) -> DataFrame:
    return df.groupBy("model_used").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "model_used")


def feature_collection(hotspots: DataFrame) -> DataFrame:
    """Hotspots as one GeoJSON text (a snapshot for a map, as large as what the map shows)."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"),
        F.struct("id", "score", "priority", "detection_count").alias("properties"),
    )
    return hotspots.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array_sort(F.collect_list(F.struct("id", feature.alias("f")))).getField("f").alias("features"))).alias("geojson"))
