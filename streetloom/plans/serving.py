"""Queries of the rules around a detector."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serving
from ..sources.fixtures import DET_SQL, PANO_SQL, detections, panoramas, table
from .base import query

WITH = f"WITH {DET_SQL}"

#: Sweeps by checkpoint: every detection counts at all levels (twentieths) up to its confidence.
CURVE_SQL = """lev AS (SELECT 'ck-' || (event_id % 6) AS checkpoint, event_id, unnest(range(1, least(19, CAST(floor(confidence * 20) AS BIGINT)) + 1)) AS k FROM det),
tot AS (SELECT 'ck-' || (event_id % 6) AS checkpoint, count(*) FILTER (WHERE event_id % 4 <> 0) AS n, count(*) FILTER (WHERE event_id % 4 <> 0 AND event_id % 5 = 0) AS small,
  count(*) FILTER (WHERE event_id % 4 <> 0 AND event_id % 7 = 0) AS ln, count(*) FILTER (WHERE event_id % 4 <> 0 AND event_id % 35 = 0) AS lsmall FROM det GROUP BY 1),
px AS (SELECT checkpoint, k, count(*) FILTER (WHERE event_id % 4 <> 0) AS tp, count(*) AS all_, count(*) FILTER (WHERE event_id % 4 <> 0 AND event_id % 5 = 0) AS sm,
  count(*) FILTER (WHERE event_id % 4 <> 0 AND event_id % 7 = 0) AS ltp, count(*) FILTER (WHERE event_id % 7 = 0) AS lall, count(*) FILTER (WHERE event_id % 4 <> 0 AND event_id % 35 = 0) AS lsm FROM lev GROUP BY 1, 2),
proxy AS (SELECT checkpoint, k / 20.0::DOUBLE AS threshold, tp, n - tp AS fn, tp / all_::DOUBLE AS precision, tp / nullif(n, 0)::DOUBLE AS recall, sm / greatest(1, small)::DOUBLE AS small_recall FROM px JOIN tot USING (checkpoint)),
local AS (SELECT checkpoint, k / 20.0::DOUBLE AS threshold, ltp AS tp, ln - ltp AS fn, ltp / nullif(lall, 0)::DOUBLE AS precision, ltp / nullif(ln, 0)::DOUBLE AS recall, lsm / greatest(1, lsmall)::DOUBLE AS small_recall
  FROM px JOIN tot USING (checkpoint) WHERE checkpoint <> 'ck-5')"""


def _pick(name: str) -> str:
    f1 = "CASE WHEN coalesce(precision, 0) + coalesce(recall, 0) > 0 THEN 2 * coalesce(precision, 0) * coalesce(recall, 0) / (coalesce(precision, 0) + coalesce(recall, 0)) ELSE 0 END"
    return f"SELECT checkpoint, coalesce(min(threshold) FILTER (WHERE precision >= 0.85), first(threshold ORDER BY {f1} DESC, threshold)) AS threshold FROM {name} GROUP BY 1"


SCORED_SQL = f"""{CURVE_SQL}, pc AS ({_pick("proxy")}), lc AS ({_pick("local")}), rg AS (SELECT checkpoint, arg_min(tp + fn, threshold) AS regions FROM local GROUP BY 1),
ch AS (SELECT pc.checkpoint, CASE WHEN regions >= 20 THEN lc.threshold ELSE pc.threshold END AS threshold, CASE WHEN regions IS NULL THEN 'proxy' WHEN regions >= 20 THEN 'validation' ELSE 'validation at proxy threshold' END AS source
  FROM pc LEFT JOIN rg USING (checkpoint) LEFT JOIN lc USING (checkpoint)),
scored AS (SELECT checkpoint, source, threshold, precision, recall AS score_recall, small_recall FROM ch JOIN (SELECT *, FALSE AS l FROM proxy UNION ALL SELECT *, TRUE FROM local) r USING (checkpoint, threshold) WHERE l = (source <> 'proxy'))"""


def _curves(spark, d):
    e, hit = F.col("event_id"), F.col("event_id") % 4 != 0
    x = detections(spark, d).select("event_id", "confidence", F.concat(F.lit("ck-"), (e % 6).cast("string")).alias("checkpoint"))
    some = {"": F.lit(True), "l": e % 7 == 0}
    totals = x.groupBy("checkpoint").agg(*[F.count_if(hit & c).alias(f"{k}n") for k, c in some.items()], *[F.count_if(hit & c & (e % 5 == 0)).alias(f"{k}small") for k, c in some.items()])
    top = F.least(F.lit(19), F.floor(F.col("confidence") * 20).cast("int"))
    levels = x.where(top >= 1).select("checkpoint", "event_id", F.explode(F.sequence(F.lit(1), top)).alias("k"))
    counts = levels.groupBy("checkpoint", "k").agg(
        *[F.count_if(hit & c).alias(f"{k}tp") for k, c in some.items()], *[F.count_if(c).alias(f"{k}all") for k, c in some.items()], *[F.count_if(hit & c & (e % 5 == 0)).alias(f"{k}sm") for k, c in some.items()]
    )
    x = counts.join(totals, "checkpoint")

    def curve(p):
        tp, n = F.col(f"{p}tp"), F.col(f"{p}n")
        return x.select(
            "checkpoint", (F.col("k") / 20.0).alias("threshold"), tp.alias("true_positives"), (n - tp).alias("false_negatives"), F.try_divide(tp.cast("double"), F.col(f"{p}all")).alias("precision"),
            F.try_divide(tp.cast("double"), n).alias("recall"), (F.col(f"{p}sm") / F.greatest(F.lit(1), F.col(f"{p}small"))).alias("small_recall"),
        )

    return curve(""), curve("l").where("checkpoint <> 'ck-5'")


@query(f"{WITH}, {SCORED_SQL} SELECT * FROM scored")
def checkpoint_scores(spark, d):
    return serving.scored_checkpoints(*_curves(spark, d))


@query(
    f"{WITH}, {SCORED_SQL}, b AS (SELECT coalesce(max(coalesce(score_recall, 0)), 0) AS base FROM scored WHERE checkpoint = 'ck-0') SELECT checkpoint, source, threshold, precision, score_recall, small_recall, coalesce(score_recall, 0) - base AS gain, "
    "coalesce(score_recall, 0) - base < 0.05 AS stop FROM scored, b WHERE checkpoint <> 'ck-0' ORDER BY coalesce(score_recall, 0) DESC, coalesce(small_recall, 0) DESC, checkpoint LIMIT 1"
)
def checkpoint_choice(spark, d):
    return serving.select_checkpoint(serving.scored_checkpoints(*_curves(spark, d)), "ck-0")


@query(f"{WITH}, {CURVE_SQL} SELECT checkpoint, threshold, coalesce(precision >= 0.7 AND recall >= 0.7, FALSE) AS met FROM proxy")
def acceptance_gate(spark, d):
    return _curves(spark, d)[0].select("checkpoint", "threshold", serving.target_met(F.col("precision"), F.col("recall"), 0.7).alias("met"))


@query(
    "WITH m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'v' || p_size END AS version, p_partkey % 5 <> 0 AS trained, CASE WHEN p_partkey % 11 = 0 THEN 'short' ELSE sha256(p_name) END AS sha256, "
    "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey % 100) / 100.0::DOUBLE END AS th, p_partkey % 3 = 0 AS tiled, 500 + p_partkey % 1800 AS face, CASE WHEN p_partkey % 2 = 0 THEN 640 ELSE 512 END AS tile, p_partkey % 700 AS stride FROM part), "
    "r AS (SELECT DISTINCT sha256(p_name) AS sha256 FROM part WHERE p_partkey % 13 = 0) "
    "SELECT m.k AS id, concat_ws(';', CASE WHEN NOT trained THEN 'untrained' END, CASE WHEN version = '' THEN 'version' END, CASE WHEN length(m.sha256) <> 64 THEN 'hash' END, CASE WHEN r.sha256 IS NOT NULL THEN 'rejected' END, "
    "CASE WHEN NOT coalesce(th, 0.35) BETWEEN 0.05 AND 0.95 THEN 'threshold' END, CASE WHEN tiled AND NOT (tile = 640 AND face > 640 AND face <= 2048 AND stride > 0 AND stride <= tile) THEN 'tiling' END) AS problems FROM m LEFT JOIN r ON m.sha256 = r.sha256"
)
def manifest_rules(spark, d):
    k = F.col("p_partkey")
    m = table(spark, d, "part").select(
        k.alias("id"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("v"), F.col("p_size").cast("string"))).alias("version"), (k % 5 != 0).alias("trained"), F.array(F.lit("litter")).alias("classes"),
        F.lit("yolo26-end2end").alias("format"), F.lit(640).alias("input_size"), F.when(k % 11 == 0, "short").otherwise(F.sha2("p_name", 256)).alias("sha256"),
        F.when(k % 4 != 0, (k % 100) / 100.0).alias("confidence_threshold"),
        F.when(k % 3 == 0, F.struct((500 + k % 1800).alias("face_size"), F.when(k % 2 == 0, 640).otherwise(512).alias("tile"), (k % 700).alias("stride"))).alias("tiling"),
    )
    rejected = table(spark, d, "part").where("p_partkey % 13 = 0").select(F.sha2("p_name", 256).alias("sha256"))
    return serving.manifest_problems(m, rejected).select("id", F.array_join("problems", ";").alias("problems"))


@query(
    "WITH s AS (SELECT event_id AS id, lower(trim([' Usable', 'difficult', 'UNUSABLE ', '', 'other'][CAST(event_id % 5 + 1 AS INT)], ' ')) AS status, CASE WHEN event_id % 2 = 0 THEN 'dark' ELSE ' ' END AS notes, event_id % 3 = 0 AS complete FROM events) "
    "SELECT id, status, complete, concat_ws(';', CASE WHEN status NOT IN ('', 'usable', 'difficult', 'unusable') THEN 'status' END, CASE WHEN status = 'unusable' AND trim(notes, ' ') = '' THEN 'unusable needs a note' END) AS problems FROM s"
)
def sheet_rules(spark, d):
    e = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in (" Usable", "difficult", "UNUSABLE ", "", "other")]), (e % 5 + 1).cast("int"))
    sheet = table(spark, d, "events").select(e.alias("id"), status.alias("status"), F.when(e % 2 == 0, "dark").otherwise(" ").alias("notes"), F.when(e % 3 == 0, " Yes").otherwise("no").alias("annotation_complete"))
    return serving.sheet_problems(sheet).select("id", "status", "complete", F.array_join("problems", ";").alias("problems"))


@query(
    f"{WITH}, r AS (SELECT *, image_id || '_' || view_id AS view, CASE model_used WHEN 'detector-b' THEN 1 WHEN 'detector-c' THEN 2 END AS rank FROM det WHERE model_used <> 'detector-a'), "
    "f AS (SELECT *, min(rank) OVER (PARTITION BY view) AS best FROM r), "
    "a AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN waste_area_pct ELSE round(abs(x2 - x1) * abs(y2 - y1) * 100, 2) END AS area FROM f WHERE rank = best) "
    "SELECT event_id, view, model_used, area AS waste_area_pct, CASE WHEN confidence >= 0.7 OR area > 5 THEN 'high' WHEN confidence >= 0.5 OR area > 2 THEN 'medium' ELSE 'low' END AS severity FROM a"
)
def detector_fallback(spark, d):
    x = detections(spark, d).withColumns({"view": F.concat_ws("_", "image_id", "view_id"), "waste_area_pct": F.when(F.col("event_id") % 4 == 0, F.col("waste_area_pct"))})
    found = serving.enriched(serving.first_answers(x, "view", ["detector-b", "detector-c"]))
    return found.select("event_id", "view", "model_used", "waste_area_pct", "severity")


def _views(spark, d):
    return serving.views_to_label(panoramas(spark, d).withColumns({"width": F.lit(2048), "height": F.lit(1024)}))


VIEW_SQL = f"""{DET_SQL}, {PANO_SQL}, v AS (SELECT id || '_' || view_id || '.jpg' AS file_name, id AS image_id, view_id, CAST(make_timestamp(captured_at * 1000) AS DATE) AS capture_date, creator AS contributor, sequence
  FROM pano, (SELECT unnest(['front', 'right', 'back', 'left', 'up', 'down']) AS view_id))"""


@query(f"WITH {VIEW_SQL} SELECT file_name, image_id, view_id, capture_date, contributor, sequence, 2048 AS width, 'unreviewed' AS review_status FROM v")
def view_export(spark, d):
    return _views(spark, d).select("file_name", "image_id", "view_id", "capture_date", "contributor", "sequence", F.col("panorama_size")[0].alias("width"), "review_status")


@query(
    f"WITH {VIEW_SQL}, p AS (SELECT image_id, min(contributor) AS contributor, min(sequence) AS sequence, md5('42:' || image_id) AS h FROM v GROUP BY 1), q AS (SELECT *, row_number() OVER (PARTITION BY contributor ORDER BY h, image_id) > 1 AS later FROM p), "
    "c AS (SELECT *, row_number() OVER (ORDER BY later, CASE WHEN NOT later THEN contributor END, h, image_id) <= 2 AS calibration FROM q), "
    "g AS (SELECT image_id, FALSE AS calibration, ['ann', 'bo', 'cy'][CAST((row_number() OVER (ORDER BY sequence, image_id) - 1) % 3 + 1 AS INT)] AS member FROM c WHERE NOT calibration UNION ALL SELECT image_id, TRUE, unnest(['ann', 'bo', 'cy']) FROM c WHERE calibration) "
    "SELECT member, file_name, image_id, calibration FROM v JOIN g USING (image_id)"
)
def label_pack_views(spark, d):
    return serving.label_packs(_views(spark, d), ["ann", "bo", "cy"])


@query(f"{WITH} SELECT event_id, sha256('{{\"image_id\":\"' || image_id || '\",\"version\":\"cube-100-v1' || CASE WHEN event_id % 2 = 0 THEN '' ELSE '-tile1024-640s384' END || '\",\"view_id\":\"' || view_id || '\"}}') AS key FROM det")
def analysis_keys(spark, d):
    tiling = F.when(F.col("event_id") % 2 == 1, F.struct(F.lit(1024).alias("face_size"), F.lit(640).alias("tile"), F.lit(384).alias("stride")))
    return detections(spark, d).withColumn("version", serving.analysis_version(tiling)).select("event_id", serving.cache_key("view_id", "image_id", "version").alias("key"))
