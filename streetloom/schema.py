"""Schemas and domain constants.

Undefined measures are null, never 0 or 1; times are epoch seconds or milliseconds in UTC.
"""

from __future__ import annotations

# Fixed values of the domain.
WEST, SOUTH, EAST, NORTH = 73.70, 18.40, 74.05, 18.70
GRID_STEP = 0.0045
EARTH_RADIUS_M = 6_371_000.0
CLUSTER_RADIUS_M = 100.0
SCORE_WEIGHTS = {"area": 0.3, "observations": 0.25, "confidence": 0.2, "recency": 0.15, "repeat": 0.1}
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.7, 0.5
CROSS_VIEW_IOU = 0.45
TILE_IOU, TILE_COVER, TILE_EDGE = 0.5, 0.8, 2
MATCH_IOU = 0.5
SIZE_BUCKETS = (("<8", 0, 8), ("8-16", 8, 16), ("16-32", 16, 32), (">=32", 32, None))
PARITY_IOU, PARITY_PX = 0.99, 1.0
KEEP_VISIBLE, MIN_LABEL_PX = 0.6, 3
INPUT_PX = 640
VIEWS = ("front", "right", "back", "left", "up", "down")
METRES_PER_DEGREE = 111_320.0
MAX_CLUSTER_INPUT = 2000

# Schemas as DDL: readers and createDataFrame take them as they are, and no session is needed to import this.
DETECTIONS = (
    "id string, image_id string, lat double, lng double, label string, confidence double, waste_area_pct double, severity string, "
    "box array<double>, model_used string, detected_at bigint, view_id string"
)
HOTSPOTS = (
    "id string, lat double, lng double, radius_m double, priority string, score double, detection_count bigint, last_seen bigint, "
    "first_seen bigint, avg_confidence double, description string"
)
GRIDS = ("id string, lat_min double, lat_max double, lng_min double, lng_max double, detection_count bigint, scanned boolean, last_scanned bigint")
SCAN_JOBS = ("id string, status string, area_name string, total_images bigint, processed bigint, detections_found bigint, started_at bigint, completed_at bigint")
PANORAMAS = ("id string, lat double, lng double, captured_at bigint, creator string, is_pano boolean, thumbnail string, sequence string")
REVIEW = ("status string, boxes array<array<double>>, reviewer string, notes string, revision bigint, sha256 string, reviewed_at timestamp")
REVIEW_QUEUE = ("image_id bigint, file_name string, split string, `group` string, reasons string, status string, annotation_complete string, tags string, notes string")
COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int,license:int,flickr_url:string>>, "
    "annotations array<struct<id:bigint,image_id:bigint,bbox:array<double>>>, licenses array<struct<id:int,name:string,url:string>>"
)
EVALUATION = (
    "image string, tp bigint, fp bigint, fn bigint, latency_ms double, predictions array<struct<box:array<double>,confidence:double>>, "
    "truths array<struct<box:array<double>,short_side_px:double,size_bucket:string>>, matches array<struct<prediction:int,truth:int,iou:double>>"
)


def empty(spark, schema: str):
    """A table without rows, as after a fresh start."""
    return spark.createDataFrame([], schema)
