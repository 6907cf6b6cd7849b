"""Evaluation and box queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.stats import wilson
from ..operators import detect, diagnose, evaluate
from .places import VIEWS_SQL, reprojected_sql
from ..sources.fixtures import DET_SQL, PRED_SQL, TRUTH_SQL, detections, predictions, truths
from .base import leaders_sql, one_to_one_sql, query

WITH = f"WITH {DET_SQL}, {PRED_SQL}, {TRUTH_SQL}"
CORNERS = ("x1", "y1", "x2", "y2")


def iou_sql(a: str, b: str) -> str:
    inter = f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    area = lambda v: f"(greatest(0, {v}.x2 - {v}.x1) * greatest(0, {v}.y2 - {v}.y1))"
    return f"(CASE WHEN {area(a)} + {area(b)} - {inter} > 0 THEN {inter} / ({area(a)} + {area(b)} - {inter}) ELSE 0 END)"


#: The matching of predictions and truths, as ``m``.
PAIRS_SQL = f"pr AS (SELECT p.image, p.idx AS prediction, t.idx AS truth, p.confidence, {iou_sql('p', 't')} AS iou FROM pred p JOIN truth t ON p.image = t.image WHERE {iou_sql('p', 't')} >= 0.5)"
MATCH_SQL = f"{PAIRS_SQL}, {one_to_one_sql('pr', 'confidence DESC, prediction, iou DESC, truth')}"
MATCHED = f"WITH RECURSIVE {DET_SQL}, {PRED_SQL}, {TRUTH_SQL}, {MATCH_SQL}"


def cols(prefix: str = "") -> list:
    return [F.col(f"{prefix}{c}") for c in CORNERS]


@query(f"{WITH} SELECT p.image, p.idx AS prediction, t.idx AS truth, CAST(floor({iou_sql('p', 't')} * 1e6) AS BIGINT) AS iou_micro FROM pred p JOIN truth t ON p.image = t.image WHERE {iou_sql('p', 't')} > 0")
def box_iou_pairs(spark, d):
    x = evaluate.pairs(predictions(spark, d), truths(spark, d))
    return x.select("image", "prediction", "truth", F.floor(F.col("iou") * 1e6).cast("long").alias("iou_micro"))


@query(f"{WITH} SELECT a.image, a.idx AS a, b.idx AS b FROM pred a JOIN pred b ON a.image = b.image AND a.idx < b.idx WHERE {iou_sql('a', 'b')} > 0.3")
def near_duplicate_boxes(spark, d):
    p = predictions(spark, d)
    a = p.select("image", F.col("idx").alias("a"), *[F.col(c).alias(f"a_{c}") for c in CORNERS])
    b = p.select("image", F.col("idx").alias("b"), *[F.col(c).alias(f"b_{c}") for c in CORNERS])
    return a.join(b, "image").where("a < b").where(B.iou(cols("a_"), cols("b_")) > 0.3).select("image", "a", "b")


@query(
    f"WITH {DET_SQL} SELECT id, CAST(floor(greatest(0, CASE WHEN event_id % 3 = 0 THEN (x1*640 - 8) / 640 WHEN event_id % 3 = 1 THEN x1*640/640 ELSE x1 - 0.5 END) * 1e6 + 0.5) AS BIGINT) AS left_micro, "
    "CAST(floor(least(1, CASE WHEN event_id % 3 = 0 THEN (x1*640 + 8) / 640 WHEN event_id % 3 = 1 THEN x2*640/640 ELSE x2 + 0.5 END) * 1e6 + 0.5) AS BIGINT) AS right_micro FROM det"
)
def box_normalise(spark, d):
    """Three formats by the detection's number: centre and size, corners, ready array."""
    e, none = F.col("event_id") % 3, F.lit(None).cast("double")
    x1, y1, x2, y2 = cols()
    pred = F.struct(
        F.when(e == 0, x1 * 640).alias("x"), F.when(e == 0, y1 * 640).alias("y"), F.when(e == 0, F.lit(16.0)).alias("width"), F.when(e == 0, F.lit(16.0)).alias("height"),
        F.when(e == 1, x1 * 640).alias("x1"), F.when(e == 1, y1 * 640).alias("y1"), F.when(e == 1, x2 * 640).alias("x2"), F.when(e == 1, y2 * 640).alias("y2"),
        F.when(e == 2, F.array(x1 - 0.5, y1, x2 + 0.5, y2)).otherwise(F.array(none)).alias("bbox"),
    )
    x = detections(spark, d).withColumn("b", B.normalised(pred, F.lit(640.0), F.lit(640.0)))
    return x.select("id", F.floor(F.col("b")[0] * 1e6 + 0.5).cast("long").alias("left_micro"), F.floor(F.col("b")[2] * 1e6 + 0.5).cast("long").alias("right_micro"))


@query(f"WITH {DET_SQL}, s AS (SELECT least((x2 - x1) * 640, (y2 - y1) * 480) * 640.0::DOUBLE / 640 AS side FROM det) SELECT CASE WHEN side < 8 THEN '<8' WHEN side < 16 THEN '8-16' WHEN side < 32 THEN '16-32' ELSE '>=32' END AS size_bucket, count(*) AS count FROM s GROUP BY 1")
def size_buckets(spark, d):
    x1, y1, x2, y2 = cols()
    side = B.short_side_px((x2 - x1) * 640, (y2 - y1) * 480, F.lit(640.0), F.lit(480.0))
    return detections(spark, d).groupBy(B.size_bucket(side).alias("size_bucket")).agg(F.count("*").alias("count"))


@query(
    "WITH s AS (SELECT p_partkey, CAST(100 + p_partkey % 1900 AS DOUBLE) AS w, CAST(100 + (p_partkey * 7) % 1900 AS DOUBLE) AS h FROM part), k AS (SELECT *, least(640 / w, 640 / h) AS scale FROM s) "
    "SELECT p_partkey, CAST(floor(scale * 1e6) AS BIGINT) AS scale_micro, CAST(floor((640 - round_even(w * scale, 0)) / 2) AS INT) AS pad_left, CAST(floor((640 - round_even(h * scale, 0)) / 2) AS INT) AS pad_top FROM k"
)
def letterbox(spark, d):
    x = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (100 + F.col("p_partkey") % 1900).cast("double").alias("w"), (100 + (F.col("p_partkey") * 7) % 1900).cast("double").alias("h"))
    k = B.letterbox(F.col("w"), F.col("h"))
    return x.select("p_partkey", F.floor(k["scale"] * 1e6).cast("long").alias("scale_micro"), k["left"].alias("pad_left"), k["top"].alias("pad_top"))


@query(f"WITH {DET_SQL}, r AS (SELECT id, image_id, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, event_id) AS rank FROM det WHERE confidence BETWEEN 0.3 AND 1) SELECT id, image_id, 'litter-' || rank AS name FROM r WHERE rank <= 100")
def decode_filter_topk(spark, d):
    x = detect.confident(detections(spark, d), 0.3)
    x = detect.top_k(x, ["image_id"], [F.desc("confidence"), F.asc("event_id")], 100)
    return x.select("id", "image_id", F.concat(F.lit("litter-"), F.col("rank").cast("string")).alias("name"))


@query(
    f"WITH {DET_SQL} SELECT id, CAST(floor(greatest(0, least(1, (x1 * 640 - 20) / 0.8::DOUBLE / 700)) * 1e6 + 0.5) AS BIGINT) AS x_micro FROM det"
)
def unletterbox(spark, d):
    v = B.unletterbox(F.col("x1") * 640, F.lit(20), F.lit(0.8), F.lit(700))
    return detections(spark, d).select("id", F.floor(v * 1e6 + 0.5).cast("long").alias("x_micro"))


def _tiles(spark, d):
    x = detections(spark, d)
    px = {c: F.col(c) * 1000 for c in CORNERS}
    cut = detect.is_cut(px["x1"], px["y1"], px["x2"], px["y2"], F.lit(0.0), F.lit(0.0), F.lit(640.0), F.lit(640.0), F.lit(1024.0), F.lit(1024.0))
    return x.select("image_id", "id", "confidence", cut.alias("cut"), *[px[c].alias(c) for c in CORNERS])


@query(f"WITH {DET_SQL} SELECT id, 640 - x2 * 1000 <= 2 OR 640 - y2 * 1000 <= 2 AS cut FROM det")
def tile_cut_flags(spark, d):
    return _tiles(spark, d).select("id", "cut")


_TILE_PX = "t AS MATERIALIZED (SELECT image_id, id, confidence, 640 - x2 * 1000 <= 2 OR 640 - y2 * 1000 <= 2 AS cut, x1 * 1000 AS x1, y1 * 1000 AS y1, x2 * 1000 AS x2, y2 * 1000 AS y2 FROM det)"
_INTER = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_SMALL = "least(greatest(0, a.x2 - a.x1) * greatest(0, a.y2 - a.y1), greatest(0, b.x2 - b.x1) * greatest(0, b.y2 - b.y1))"


@query(
    f"WITH RECURSIVE {DET_SQL}, {_TILE_PX}, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY cut, confidence DESC, id) AS node FROM t), "
    f"e AS MATERIALIZED (SELECT a.node AS a, b.node AS b, b.node AS rb FROM o a JOIN o b ON a.image_id = b.image_id AND b.node < a.node AND ({iou_sql('a', 'b')} >= 0.5 OR {_INTER} >= 0.8::DOUBLE * {_SMALL} AND {_SMALL} > 0 AND {_INTER} / {_SMALL} >= 0.8)), "
    f"{leaders_sql()} SELECT image_id, id, cut FROM o JOIN s USING (node) WHERE lead"
)
def tile_nms(spark, d):
    """Greedy suppression in each image."""
    return detect.tile_nms(_tiles(spark, d), ["image_id"]).select("image_id", "id", "cut")


#: What of another view's box ``k`` is seen where box ``a`` lies overlaps it by 0.45.
_SEEN = f"(({iou_sql('k', 'a')}) >= 0.45 AND k.x2 > k.x1 AND k.y2 > k.y1)"


def cross_view_sql(boxes: str, p: str = "") -> str:
    """Suppression over the views of ``boxes(id, image_id, view_id, confidence, x1..y2)``: kept ones in ``{p}kept``."""
    return f"""{reprojected_sql(boxes, f"{p}seen")}, {p}o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY confidence DESC, id) AS node FROM {boxes}),
{p}e AS MATERIALIZED (SELECT a.node AS a, b.node AS b, b.node AS rb FROM {p}o a JOIN {p}o b ON a.image_id = b.image_id AND b.node < a.node AND a.view_id <> b.view_id JOIN {p}seen k ON k.id = b.id AND k.target = a.view_id WHERE {_SEEN}),
{leaders_sql(p)}, {p}kept AS MATERIALIZED (SELECT {p}o.* FROM {p}o JOIN {p}s USING (node) WHERE lead)"""


@query(f"WITH RECURSIVE {DET_SQL}, {VIEWS_SQL}, {cross_view_sql('det')} SELECT image_id, id, view_id FROM kept")
def cross_view_nms(spark, d):
    """Greedy suppression over the views of each panorama."""
    x = detections(spark, d).select("image_id", "id", "view_id", "confidence", *CORNERS)
    return detect.cross_view_nms(x).select("image_id", "id", "view_id")


#: Rows of a detector in the pixels of its padded input, a few of them of another class, as image shares.
_RAW_SQL = """raw AS MATERIALIZED (SELECT id, image_id, view_id, confidence, lat, lng, greatest(0, least(1, (x1 * 640 - 20) / 0.8::DOUBLE / 700)) AS x1, greatest(0, least(1, (y1 * 640 - 10) / 0.8::DOUBLE / 700)) AS y1,
  greatest(0, least(1, (x2 * 640 - 20) / 0.8::DOUBLE / 700)) AS x2, greatest(0, least(1, (y2 * 640 - 10) / 0.8::DOUBLE / 700)) AS y2, event_id FROM det WHERE confidence BETWEEN 0.3 AND 1 AND event_id % 9 <> 0),
top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, view_id ORDER BY confidence DESC, id) AS k FROM raw WHERE x2 > x1 AND y2 > y1) WHERE k <= 100)"""


@query(
    f"WITH RECURSIVE {DET_SQL}, {VIEWS_SQL}, {_RAW_SQL}, {cross_view_sql('top')}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, id) AS rank, round(abs(x2 - x1) * abs(y2 - y1) * 100, 2) AS area FROM kept) "
    "SELECT image_id || '-litter-' || rank AS name, image_id, view_id, id AS source, lat, lng, CASE WHEN confidence >= 0.7 OR area > 5 THEN 'high' WHEN confidence >= 0.5 OR area > 2 THEN 'medium' ELSE 'low' END AS severity FROM n"
)
def panorama_analysis(spark, d):
    """Detector rows of all views of each panorama, decoded, merged, numbered and judged."""
    x = detections(spark, d)
    px = [(F.col(c) * 640).alias(c) for c in CORNERS]
    raw = x.select("image_id", "view_id", "id", "confidence", (F.col("event_id") % 9 == 0).cast("int").alias("cls"), *px)
    frame = {"left": F.lit(20), "top": F.lit(10), "scale": F.lit(0.8), "width": F.lit(700), "height": F.lit(700)}
    places = x.select("id", "lat", "lng")
    found = detect.analyse(raw, frame, 0.3).join(places, "id")
    return found.select("name", "image_id", "view_id", F.col("id").alias("source"), "lat", "lng", "severity")


@query(f"{MATCHED} SELECT image, prediction, truth, CAST(floor(iou * 1e6) AS BIGINT) AS iou_micro FROM m")
def greedy_match(spark, d):
    """One-to-one matches."""
    x = evaluate.match(predictions(spark, d), truths(spark, d))
    return x.select("image", "prediction", "truth", F.floor(F.col("iou") * 1e6).cast("long").alias("iou_micro"))


def _clipped(v: str) -> str:
    return ", ".join(f"least(greatest({v}.{c}, 0.05::DOUBLE), 0.85::DOUBLE) AS {c}" for c in CORNERS)


def _parity_pairs(left: str, right: str, p: str) -> str:
    """Pairs of two runs by falling overlap, those that do not overlap by falling indexes, and per image what they come to, as ``{p}t``."""
    corner = "greatest(" + ", ".join(f"abs(a.{c} - b.{c}) * 640.0::DOUBLE" for c in CORNERS) + ")"
    free = lambda run, side: f"(SELECT image, idx, row_number() OVER (PARTITION BY image ORDER BY idx DESC) AS k FROM {run} WHERE NOT EXISTS (SELECT 1 FROM {p}m WHERE {p}m.image = {run}.image AND {p}m.{side} = {run}.idx))"
    return f"""{p}pr AS MATERIALIZED (SELECT a.image, a.idx AS prediction, b.idx AS truth, {iou_sql('a', 'b')} AS iou FROM {left} a JOIN {right} b ON a.image = b.image AND {iou_sql('a', 'b')} > 0),
{one_to_one_sql(f'{p}pr', 'iou DESC, prediction DESC, truth DESC', p)},
{p}all AS (SELECT image, prediction, truth, iou FROM {p}m UNION ALL SELECT x.image, x.idx, y.idx, 0 FROM {free(left, 'prediction')} x JOIN {free(right, 'truth')} y USING (image, k)),
{p}c AS (SELECT l.image, iou, {corner} AS corner, abs(a.confidence - b.confidence) AS diff FROM {p}all l JOIN {left} a ON a.image = l.image AND a.idx = l.prediction JOIN {right} b ON b.image = l.image AND b.idx = l.truth),
{p}t AS MATERIALIZED (SELECT image, count(*) AS pairs, min(iou) AS min_iou, max(corner) AS corner, max(diff) AS diff, bool_and(iou >= 0.99 OR corner <= 1) AS close, bool_and(iou >= 0.99) AS overlap FROM {p}c GROUP BY 1)"""


@query(
    f"WITH RECURSIVE {DET_SQL}, {PRED_SQL}, a0 AS (SELECT * FROM pred), b0 AS (SELECT image, idx, confidence, " + ", ".join(f"{c} + CAST(idx % 7 AS DOUBLE) / 10000.0::DOUBLE AS {c}" for c in CORNERS) + f" FROM pred WHERE idx % 31 <> 0), "
    f"a1 AS (SELECT image, idx, confidence, {_clipped('a0')} FROM a0), b1 AS (SELECT image, idx, confidence, {_clipped('b0')} FROM b0), {_parity_pairs('a1', 'b1', 'c')}, {_parity_pairs('a0', 'b0', 'u')}, "
    "n AS (SELECT image, (SELECT count(*) FROM a0 WHERE a0.image = i.image) AS n_left, (SELECT count(*) FROM b0 WHERE b0.image = i.image) AS n_right FROM (SELECT DISTINCT image FROM a0) i) "
    "SELECT n.image, n_left, n_right, coalesce(ct.pairs, 0) AS pairs, CAST(floor(coalesce(ct.min_iou, 1) * 1e6) AS BIGINT) AS min_iou_micro, CAST(floor(coalesce(ct.corner, 0) * 1e6 + 0.5) AS BIGINT) AS max_corner_micro, "
    "CAST(floor(coalesce(ct.diff, 0) * 1e6 + 0.5) AS BIGINT) AS max_diff_micro, greatest(n_left, n_right) - coalesce(ct.pairs, 0) AS unpaired, n_left = n_right AND coalesce(ct.close, true) AS passed, "
    "n_left = n_right AND coalesce(ut.pairs, 0) = n_left AND coalesce(ut.overlap, true) AS passed_strict FROM n LEFT JOIN ct ON ct.image = n.image LEFT JOIN ut ON ut.image = n.image"
)
def parity_report(spark, d):
    """Two runs whose boxes differ by at most six ten-thousandths and a few are missing in one, clipped to the image in the input."""
    left = predictions(spark, d)
    right = left.where("idx % 31 <> 0").select("image", "idx", "confidence", *[(F.col(c) + (F.col("idx") % 7).cast("double") / 10000.0).alias(c) for c in CORNERS])
    bounds = left.select("image", *[F.lit(v).alias(n) for n, v in (("bx1", 0.05), ("by1", 0.05), ("bx2", 0.85), ("by2", 0.85))]).distinct()
    x = evaluate.parity(left, right, 640.0, bounds)
    micro = lambda c, r: F.floor(F.col(c) * 1e6 + r).cast("long")
    return x.select(
        "image", "n_left", "n_right", "pairs", micro("min_iou", 0.0).alias("min_iou_micro"), micro("max_corner_px", 0.5).alias("max_corner_micro"),
        micro("max_confidence_diff", 0.5).alias("max_diff_micro"), "unpaired", "passed", "passed_strict",
    )


def _records(spark, d):
    p, t = predictions(spark, d), truths(spark, d)
    return evaluate.records(p.select("image"), p, t, evaluate.match(p, t))


#: Records of the matching, one for each image with a prediction.
MATCH_REC_SQL = """mrec AS (SELECT i.image, coalesce(k.tp, 0) AS tp, i.p - coalesce(k.tp, 0) AS fp, coalesce(t.t, 0) - coalesce(k.tp, 0) AS fn, coalesce(t.t, 0) AS truths
  FROM (SELECT image, count(*) AS p FROM pred GROUP BY 1) i LEFT JOIN (SELECT image, count(*) AS tp FROM m GROUP BY 1) k USING (image) LEFT JOIN (SELECT image, count(*) AS t FROM truth GROUP BY 1) t USING (image))"""


def _summary_sql(rec: str) -> str:
    return (
        f"SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) FILTER (WHERE truths = 0) AS clean_images, CAST(coalesce(sum(fp) FILTER (WHERE truths = 0), 0) AS BIGINT) AS clean_false_alarms, "
        f"count(*) FILTER (WHERE truths = 0 AND fp > 0) AS clean_images_hit, CAST(sum(tp) AS DOUBLE) / CAST(sum(tp) + sum(fp) AS DOUBLE) AS precision, CAST(sum(tp) AS DOUBLE) / CAST(sum(tp) + sum(fn) AS DOUBLE) AS recall FROM {rec}"
    )


@query(f"{MATCHED}, {MATCH_REC_SQL}, y AS ({_summary_sql('mrec')}), l AS (SELECT median(value) AS med FROM events) SELECT y.*, CAST(floor(l.med * 1e6 + 0.5) AS BIGINT) AS median_latency_micro FROM y, l")
def eval_summary(spark, d):
    """The whole evaluation of a detector in one row, with the median latency of its runs."""
    runs = evaluate.latency(spark.read.parquet(f"{d}/events.parquet").select(F.col("value").alias("latency_ms")))
    return evaluate.summary(_records(spark, d)).crossJoin(runs.select(F.floor(F.col("median_ms") * 1e6 + 0.5).cast("long").alias("median_latency_micro")))  # one row each


#: Records that need no matching, so that SQL can repeat what is made of them.
REC_SQL = "rec AS (SELECT image_id AS image, count(*) FILTER (WHERE event_id % 3 = 0) AS tp, count(*) FILTER (WHERE event_id % 3 = 1) AS fp, count(*) FILTER (WHERE event_id % 3 = 2) AS fn, count(*) FILTER (WHERE event_id % 3 <> 1) AS truths FROM det GROUP BY 1)"


def _plain_records(spark, d):
    e = F.col("event_id") % 3
    return detections(spark, d).groupBy(F.col("image_id").alias("image")).agg(F.count_if(e == 0).alias("tp"), F.count_if(e == 1).alias("fp"), F.count_if(e == 2).alias("fn"), F.count_if(e != 1).alias("truths"))


@query(f"WITH {DET_SQL}, {REC_SQL} {_summary_sql('rec')}")
def summary_of_records(spark, d):
    return evaluate.summary(_plain_records(spark, d))


@query(f"WITH {DET_SQL}, {REC_SQL}, i AS (SELECT image, tp, tp + fn AS n, 1.96::DOUBLE AS z FROM rec), p AS (SELECT *, tp / n AS p FROM i WHERE n > 0), w AS (SELECT image, (p + z*z/(2*n)) / (1 + z*z/n) AS c, z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n) AS h FROM p) SELECT image, CAST(floor((c - h) * 1e6 + 0.5) AS BIGINT) AS low_micro, CAST(floor((c + h) * 1e6 + 0.5) AS BIGINT) AS high_micro FROM w")
def wilson_ci(spark, d):
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    x = _plain_records(spark, d).where("tp + fn > 0")
    return x.select("image", F.floor(low * 1e6 + 0.5).cast("long").alias("low_micro"), F.floor(high * 1e6 + 0.5).cast("long").alias("high_micro"))


@query(
    f"{MATCHED}, b(bucket_order, size_bucket) AS (VALUES (0, '<8'), (1, '8-16'), (2, '16-32'), (3, '>=32')), z AS (SELECT image, idx, least((x2 - x1) * 640, (y2 - y1) * 640) AS side FROM truth), "
    "k AS (SELECT CASE WHEN side < 8 THEN '<8' WHEN side < 16 THEN '8-16' WHEN side < 32 THEN '16-32' ELSE '>=32' END AS size_bucket, count(*) AS labels, count(m.truth) AS found FROM z LEFT JOIN m ON m.image = z.image AND m.truth = z.idx GROUP BY 1) "
    "SELECT bucket_order, size_bucket, coalesce(labels, 0) AS labels, coalesce(found, 0) AS found, found / labels AS recall FROM b LEFT JOIN k USING (size_bucket)"
)
def recall_by_size(spark, d):
    t = truths(spark, d).withColumn("size_bucket", B.size_bucket(B.short_side_px((F.col("x2") - F.col("x1")) * 640, (F.col("y2") - F.col("y1")) * 640, F.lit(640.0), F.lit(640.0))))
    return evaluate.recall_by_size(t, evaluate.match(predictions(spark, d), t))


def _mixed_sql(v: str, seed: int) -> str:
    for k, c in ((1_103_515_245, 12_345 + seed), (1_664_525, 1_013_904_223)):
        x = f"((({v}) % 2147483648 * {k} + {c}) % 2147483648)"
        v = f"xor({x}, {x} >> 15)"
    return v


@query(
    f"WITH {DET_SQL}, {REC_SQL}, g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY image) - 1 AS i, tp, fp, fn FROM rec), n AS (SELECT count(*) AS n FROM g), "
    f"dr AS (SELECT r // n AS round, ({_mixed_sql('r', 0)}) % n AS i FROM n, unnest(range(2000 * n)) t(r)), x AS (SELECT round, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn FROM dr JOIN g USING (i) GROUP BY 1), "
    "v AS (SELECT 'precision' AS metric, tp / (tp + fp) AS v FROM x WHERE tp + fp > 0 UNION ALL SELECT 'recall', tp / (tp + fn) FROM x WHERE tp + fn > 0) "
    "SELECT metric, CAST(floor(quantile_cont(v, 0.025) * 1e6 + 0.5) AS BIGINT) AS low_micro, CAST(floor(quantile_cont(v, 0.975) * 1e6 + 0.5) AS BIGINT) AS high_micro, count(*) AS rounds FROM v GROUP BY 1"
)
def bootstrap_ci(spark, d):
    """Resampled intervals."""
    x = evaluate.bootstrap(_plain_records(spark, d), F.col("image"))
    return x.select("metric", *[F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(f"{c}_micro") for c in ("low", "high")], "rounds")


LEVELS = [round(0.05 * i, 2) for i in range(1, 20)]
SWEEP_SQL = f"""lv AS (SELECT unnest({LEVELS})::DOUBLE AS threshold), sw0 AS (SELECT threshold, (SELECT count(*) FROM m WHERE confidence >= threshold) AS tp, (SELECT count(*) FROM pred WHERE confidence >= threshold) AS p, (SELECT count(*) FROM truth) AS t FROM lv),
sw AS (SELECT threshold, tp, p - tp AS fp, t - tp AS fn, CASE WHEN p > 0 THEN tp / p END AS precision, CASE WHEN t > 0 THEN tp / t END AS recall FROM sw0)"""


@query(f"{MATCHED}, {SWEEP_SQL} SELECT * FROM sw")
def threshold_sweep(spark, d):
    return evaluate.sweep(predictions(spark, d), truths(spark, d), LEVELS)


@query(
    f"{MATCHED}, {SWEEP_SQL}, f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM sw) "
    "SELECT coalesce(min(threshold) FILTER (WHERE precision >= 0.85), arg_max(threshold, {'f': coalesce(f1, 0), 't': -threshold})) AS threshold, min(threshold) FILTER (WHERE precision >= 0.85) IS NOT NULL AS reached FROM f"
)
def choose_threshold(spark, d):
    return evaluate.choose_threshold(evaluate.sweep(predictions(spark, d), truths(spark, d), LEVELS))


#: Best overlap, prediction and category of every truth, as ``miss``.
MISS_SQL = f"""ov AS MATERIALIZED (SELECT t.image, t.idx AS truth, p.idx AS prediction, p.confidence, {iou_sql('p', 't')} AS iou FROM truth t JOIN pred p ON p.image = t.image),
sp AS (SELECT image, prediction, count(DISTINCT truth) AS spanned FROM ov WHERE iou > 0.1 GROUP BY 1, 2),
be AS (SELECT image, truth, max(iou) AS best, arg_max(prediction, {{'i': iou, 'c': confidence, 'p': prediction}}) FILTER (WHERE iou > 0) AS prediction, count(*) FILTER (WHERE iou > 0.1) AS covered FROM ov GROUP BY 1, 2),
miss AS MATERIALIZED (SELECT t.image, t.idx AS truth, coalesce(best, 0) AS best, CASE WHEN m.truth IS NOT NULL THEN 'matched' WHEN coalesce(best, 0) < 0.1 THEN 'no prediction nearby' WHEN coalesce(spanned, 0) > 1 OR covered > 1 THEN 'cluster mismatch' ELSE 'near-miss localisation' END AS category
  FROM truth t LEFT JOIN be b ON b.image = t.image AND b.truth = t.idx LEFT JOIN sp ON sp.image = b.image AND sp.prediction = b.prediction LEFT JOIN m ON m.image = t.image AND m.truth = t.idx)"""


def _misses(spark, d):
    p, t = predictions(spark, d), truths(spark, d)
    return evaluate.near_misses(p, t, evaluate.match(p, t))


@query(f"{MATCHED}, {MISS_SQL} SELECT category, count(*) AS count FROM miss GROUP BY 1")
def near_miss_categories(spark, d):
    return _misses(spark, d).groupBy("category").agg(F.count("*").alias("count"))


@query(f"{MATCHED}, {MISS_SQL}, c AS (SELECT count(*) AS n FROM miss) SELECT c.n > 0 AS checks, (SELECT count(*) FROM truth) = c.n AS categorised, c.n > 0 AND (SELECT count(*) FROM truth) = c.n AS gate FROM c")
def diagnosis_gate(spark, d):
    """Every truth falls into one category, and the other checks hold."""
    from ..operators import serving

    c = _misses(spark, d).groupBy("category").agg(F.count("*").alias("count"))
    checks = c.agg((F.sum("count") > 0).alias("passed"))
    return serving.diagnosis_gate(checks, c, truths(spark, d).count())


@query(f"WITH {DET_SQL}, s AS (SELECT floor(x1 * 1000 + 0.5) AS side FROM det) SELECT count(*) AS boxes, CAST(floor(quantile_cont(side, 0.1) * 10 + 0.5) AS BIGINT) AS p10, CAST(floor(quantile_cont(side, 0.5) * 10 + 0.5) AS BIGINT) AS p50, CAST(floor(quantile_cont(side, 0.9) * 10 + 0.5) AS BIGINT) AS p90, CAST(floor(avg(CASE WHEN side < 32 THEN 1 ELSE 0 END) * 1e6 + 0.5) AS BIGINT) AS under_32_micro FROM s")
def box_stats_percentiles(spark, d):
    x = diagnose.box_stats(detections(spark, d).select(F.floor(F.col("x1") * 1000 + 0.5).cast("double").alias("side")))
    p = lambda i: F.floor(F.col("p")[i] * 10 + 0.5).cast("long")
    return x.select("boxes", p(0).alias("p10"), p(1).alias("p50"), p(2).alias("p90"), F.floor(F.col("under_32") * 1e6 + 0.5).cast("long").alias("under_32_micro"))


@query(f"WITH {DET_SQL}, c AS (SELECT label AS category, view_id AS size_bucket FROM det) SELECT category, coalesce(size_bucket, 'all') AS size_bucket, count(*) AS count FROM c GROUP BY GROUPING SETS ((category), (category, size_bucket))")
def category_grouping_sets(spark, d):
    x = detections(spark, d).select(F.col("label").alias("category"), F.col("view_id").alias("size_bucket"))
    return diagnose.category_counts(x).select("category", F.coalesce("size_bucket", F.lit("all")).alias("size_bucket"), "count")


@query(f"{MATCHED}, {MISS_SQL} SELECT count(*) FILTER (WHERE best >= 0.3) AS at_30, count(*) FILTER (WHERE best >= 0.5) AS at_50 FROM miss")
def looser_matching(spark, d):
    return diagnose.reach(_misses(spark, d), [0.3, 0.5])


@query(
    f"WITH {DET_SQL}, n AS (SELECT image_id, count(*) FILTER (WHERE event_id % 4 <> 0) AS n FROM det GROUP BY 1) SELECT count(*) AS images, CAST(floor(avg(n) * 1e6 + 0.5) AS BIGINT) AS mean_micro, CAST(median(n) * 2 AS BIGINT) AS twice_median, max(n) AS max_boxes, count(*) FILTER (WHERE n = 0) AS empty_images FROM n"
)
def boxes_per_image(spark, d):
    x = diagnose.boxes_per_image(truths(spark, d), predictions(spark, d).select("image"))
    return x.select("images", F.floor(F.col("mean_boxes") * 1e6 + 0.5).cast("long").alias("mean_micro"), (F.col("median_boxes") * 2).cast("long").alias("twice_median"), "max_boxes", "empty_images")


@query(f"WITH {DET_SQL} SELECT model_used, CAST(floor(median(confidence) * 1e6 + 0.5) AS BIGINT) AS median_micro, count(*) AS runs FROM det GROUP BY 1")
def latency_by_model(spark, d):
    x = evaluate.latency(detections(spark, d).select("model_used", F.col("confidence").alias("latency_ms")), ["model_used"])
    return x.select("model_used", F.floor(F.col("median_ms") * 1e6 + 0.5).cast("long").alias("median_micro"), "runs")


@query(f"WITH {DET_SQL} SELECT user_id % 20 AS run, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS epoch, CAST(event_id % 97 AS DOUBLE) AS fitness, CAST(event_id % 83 AS DOUBLE) AS val_loss FROM det")
def training_results(spark, d):
    """Results stored as one array a measure, as rows."""
    e = F.array_sort(F.collect_list("event_id"))
    x = detections(spark, d).groupBy((F.col("user_id") % 20).alias("run")).agg(e.alias("e"))
    rest = lambda m: F.transform("e", lambda v: (v % m).cast("double"))
    x = x.select("run", rest(97).alias("fitness"), rest(83).alias("val_loss"))
    return diagnose.result_rows(x, "run", ["fitness", "val_loss"])


@query(
    f"""WITH {DET_SQL}, c AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS epoch, CAST(event_id % 97 AS DOUBLE) AS fitness, CAST(event_id % 89 AS DOUBLE) AS train_loss, CAST(event_id % 83 AS DOUBLE) AS val_loss FROM det),
    k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS back FROM c),
    g AS (SELECT run, count(*) AS epochs, arg_max(epoch, {{'f': fitness, 'e': -epoch}}) AS best_epoch, max(fitness) AS best_fitness, regr_slope(fitness, epoch) FILTER (WHERE back <= 10) AS slope,
      avg(val_loss) FILTER (WHERE back <= 3) AS v3, min(val_loss) AS v0, avg(train_loss) FILTER (WHERE back <= 3) AS t3, avg(train_loss) FILTER (WHERE back BETWEEN 4 AND 6) AS t6 FROM k GROUP BY 1)
    SELECT run, epochs, best_epoch, best_fitness, CASE WHEN epochs >= 3 THEN CAST(floor(slope * 1e6 + 0.5) AS BIGINT) END AS slope_micro, epochs >= 6 AND v3 > 1.05 * v0 AS val_rising, coalesce(epochs >= 6 AND t3 < t6, false) AS train_falling,
      CASE WHEN epochs >= 100 THEN 'limit' WHEN epochs - 1 - best_epoch >= 10 THEN 'early stopping' ELSE 'interrupted' END AS stopped FROM g"""
)
def curve_summary(spark, d):
    """Every user's events as the curve of a run, whole."""
    from pyspark.sql import Window as W

    x = detections(spark, d).select(
        F.col("user_id").alias("run"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("epoch"), (F.col("event_id") % 97).cast("double").alias("fitness"),
        (F.col("event_id") % 89).cast("double").alias("train_loss"), (F.col("event_id") % 83).cast("double").alias("val_loss"),
    )
    y = diagnose.curve_summary(x, 10, 100)
    return y.select("run", "epochs", "best_epoch", "best_fitness", F.floor(F.col("slope_last_10") * 1e6 + 0.5).cast("long").alias("slope_micro"), "val_rising", "train_falling", "stopped")
