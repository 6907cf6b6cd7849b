"""Review queries and the streaming one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluate, review
from ..operators.graph import cut, numbered
from ..sources.fixtures import DET_SQL, REVIEW_SQL, detections, reviews, table
from ..streaming import incremental
from .base import one_to_one_sql, query
from .dashboard import AT_SQL, GRID_SQL
from .evaluation import iou_sql

WITH = f"WITH {DET_SQL}, {REVIEW_SQL}"


@query(
    f"{WITH} SELECT view, revision, concat_ws(';', CASE WHEN (status = 'litter') <> (len(boxes) > 0) THEN 'boxes do not fit the status' END, CASE WHEN status = 'skip' AND trim(notes) = '' THEN 'skip needs notes' END, "
    "CASE WHEN len(boxes) > 0 AND NOT (boxes[1][1] >= 0 AND boxes[1][2] >= 0 AND boxes[1][3] <= 1 AND boxes[1][4] <= 1 AND boxes[1][1] < boxes[1][3] AND boxes[1][2] < boxes[1][4]) THEN 'box' END) AS violations FROM review"
)
def review_rules(spark, d):
    return review.violations(reviews(spark, d)).select("view", "revision", F.array_join("violations", ";").alias("violations"))


@query(f"{WITH} SELECT view, max(revision) AS revision, arg_max(status, revision) AS status, arg_max(reviewer, revision) AS reviewer FROM review GROUP BY 1")
def review_latest(spark, d):
    return review.current(reviews(spark, d)).select("view", "revision", "status", "reviewer")


@query(f"{WITH}, l AS (SELECT view, arg_max(status, revision) AS status FROM review GROUP BY 1) SELECT count(*) FILTER (WHERE status IN ('litter', 'clean')) AS reviewed, count(*) FILTER (WHERE status = 'skip') AS skipped, count(*) AS total FROM l")
def review_progress(spark, d):
    return review.progress(review.current(reviews(spark, d)))


@query(f"{WITH}, l AS (SELECT view, arg_max(status, revision) AS status, arg_max(boxes, revision) AS boxes FROM review GROUP BY 1) SELECT view, CASE WHEN len(boxes) = 0 THEN '' ELSE printf('0 %.8f %.8f %.8f %.8f', (boxes[1][1] + boxes[1][3]) / 2, (boxes[1][2] + boxes[1][4]) / 2, boxes[1][3] - boxes[1][1], boxes[1][4] - boxes[1][2]) END AS labels FROM l WHERE status IN ('litter', 'clean')")
def review_export(spark, d):
    r = review.current(reviews(spark, d))
    v = r.select("view", F.lit("s").alias("sequence"), F.lit(True).alias("original"))
    return review.exportable(r, v).select("view", "labels")


@query(
    f"{WITH}, p AS (SELECT view, 'm' || (revision % 2) AS member, arg_max(status, revision) AS status, arg_max(revision, revision) AS k FROM review GROUP BY 1, 2), t AS (SELECT view, max(status) AS status FROM review WHERE revision % 11 = 0 GROUP BY 1), "
    "x AS (SELECT p.*, t.status AS old, length(p.view) % 2 AS side FROM p LEFT JOIN t USING (view)) SELECT CASE WHEN k % 13 = 0 THEN 'rejected' WHEN status = 'unreviewed' THEN 'skipped' WHEN k % 17 = 0 THEN 'calibration' WHEN member <> 'm' || side THEN 'rejected' WHEN old IS NOT NULL THEN CASE WHEN old = status THEN 'unchanged' ELSE 'conflict' END ELSE 'merged' END AS result, count(*) AS count FROM x GROUP BY 1"
)
def pack_merge(spark, d):
    r = reviews(spark, d).withColumn("member", F.concat(F.lit("m"), (F.col("revision") % 2).cast("string")))
    p = r.groupBy("view", "member").agg(F.max_by("status", "revision").alias("status"), F.max("revision").alias("k"))
    key = F.concat_ws("/", "view", "member").alias("view")
    pack = p.select(key, "member", "status", F.lit(0).alias("boxes"), F.when(F.col("k") % 13 == 0, "new").otherwise("old").alias("sha"))
    known = p.select(key, F.lit("old").alias("sha"), F.concat(F.lit("m"), (F.length("view") % 2).cast("string")).alias("assigned"), (F.col("k") % 17 == 0).alias("calibration"))
    t = reviews(spark, d).where("revision % 11 = 0").groupBy("view").agg(F.max("status").alias("status"))
    target = p.select("view", "member").join(t, "view").select(key, "status", F.lit(0).alias("boxes"))
    return review.merge_packs(pack, target, known).groupBy("result").agg(F.count("*").alias("count"))


_ANSWERS = "an AS MATERIALIZED (SELECT 'v' || (event_id // 9) AS view, 'r' || (event_id % 3) AS reviewer, event_id AS idx, CASE WHEN event_id % 7 = 0 THEN 'skip' ELSE 'litter' END AS status, x1 + (event_id % 3) * 0.001::DOUBLE AS x1, y1, x2, y2 FROM det), "
#: Answers to the same objects: each reviewer of a view draws the boxes of all its events, a little apart.
_AGREE = f"""bx AS MATERIALIZED (SELECT a.view, r.reviewer, a.idx, a.x1 + CAST(substr(r.reviewer, 2) AS INT) * 0.002::DOUBLE * (a.idx % 5) AS x1, a.y1, a.x2, a.y2 FROM an a JOIN (SELECT DISTINCT view, reviewer FROM an) r USING (view) WHERE (a.idx + ascii(r.reviewer[2])) % 4 <> 0),
who AS MATERIALIZED (SELECT a.view, a.reviewer AS a, b.reviewer AS b FROM (SELECT DISTINCT view, reviewer FROM bx) a JOIN (SELECT DISTINCT view, reviewer FROM bx) b ON a.view = b.view AND a.reviewer < b.reviewer),
pr AS MATERIALIZED (SELECT w.view || '|' || w.a || '|' || w.b AS image, p.idx AS prediction, t.idx AS truth, {iou_sql('p', 't')} AS iou FROM who w JOIN bx p ON p.view = w.view AND p.reviewer = w.a JOIN bx t ON t.view = w.view AND t.reviewer = w.b WHERE {iou_sql('p', 't')} >= 0.5),
{one_to_one_sql('pr', 'iou DESC, prediction DESC, truth DESC')},
ag AS MATERIALIZED (SELECT view, a, b, 2 * coalesce(n, 0) / (na + nb) AS f1 FROM (SELECT w.*, (SELECT count(*) FROM bx WHERE bx.view = w.view AND reviewer = a) AS na, (SELECT count(*) FROM bx WHERE bx.view = w.view AND reviewer = b) AS nb, (SELECT count(*) FROM m WHERE image = w.view || '|' || w.a || '|' || w.b) AS n FROM who w))"""


def _answers(spark, d):
    e = F.col("event_id")
    a = detections(spark, d).select(
        F.concat(F.lit("v"), F.floor(e / 9).cast("string")).alias("view"), F.concat(F.lit("r"), (e % 3).cast("string")).alias("reviewer"), e.alias("idx"),
        F.when(e % 7 == 0, "skip").otherwise("litter").alias("status"), (F.col("x1") + (e % 3) * 0.001).alias("x1"), "y1", "x2", "y2",
    )
    who = a.select("view", "reviewer").distinct()
    number = F.substring("reviewer", 2, 1)
    b = a.drop("reviewer", "status").join(who, "view").where((F.col("idx") + F.ascii(number)) % 4 != 0)
    return a, b.withColumn("x1", F.col("x1") + number.cast("int") * F.lit(0.002) * (F.col("idx") % 5))


@query(f"WITH RECURSIVE {DET_SQL}, {_ANSWERS}{_AGREE} SELECT view, a, b, CAST(floor(f1 * 1e6 + 0.37::DOUBLE) AS BIGINT) AS f1_micro FROM ag")
def calibration_agreement(spark, d):
    """Agreement of reviewers over their boxes."""
    x = evaluate.agreement(_answers(spark, d)[1])
    return x.select("view", "a", "b", F.floor(F.col("f1") * 1e6 + 0.37).cast("long").alias("f1_micro"))


@query(
    f"WITH RECURSIVE {DET_SQL}, {_ANSWERS}{_AGREE}, f AS (SELECT view, round(avg(f1), 3) AS f FROM ag GROUP BY 1), sv AS (SELECT view, count(DISTINCT reviewer) AS reviewers, count(DISTINCT status) = 1 AS statuses_agree FROM an GROUP BY 1) "
    "SELECT view, reviewers, statuses_agree, CAST(round(f * 1000) AS BIGINT) AS f1_milli, NOT statuses_agree OR coalesce(f < 0.7, false) AS discuss FROM sv LEFT JOIN f USING (view)"
)
def calibration_report(spark, d):
    """What each view's reviewers agree on, and which views to discuss."""
    a, b = _answers(spark, d)
    x = evaluate.calibration(b, a.select("view", "reviewer", "status"))
    return x.select("view", "reviewers", "statuses_agree", F.rint(F.col("mean_f1") * 1000).cast("long").alias("f1_milli"), "discuss")


@query("WITH o AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS a, CASE WHEN doc_id % 3 = 0 THEN source END AS b FROM documents), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE lang END AS a, source AS b FROM documents) SELECT doc_id, CASE WHEN o.a = '' THEN n.a ELSE o.a END AS a, coalesce(o.b, n.b) AS b, CASE WHEN o.a <> '' AND o.a <> n.a THEN 'a' ELSE '' END AS conflicts, o.a = '' OR o.b IS NULL AS filled FROM o JOIN n USING (doc_id)")
def sheet_merge(spark, d):
    t, k = table(spark, d, "documents"), F.col("doc_id")
    old = t.select("doc_id", F.when(k % 2 == 0, F.col("lang")).otherwise("").alias("a"), F.when(k % 3 == 0, F.col("source")).alias("b"))
    new = t.select("doc_id", F.when(k % 5 == 0, "x").otherwise(F.col("lang")).alias("a"), F.col("source").alias("b"))
    return review.merge_sheets(old, new, "doc_id").withColumn("conflicts", F.array_join("conflicts", ","))


@query(f"{WITH}, v AS (SELECT view, arg_max(status, revision) AS status, row_number() OVER (ORDER BY view) - 1 AS position, count(*) OVER () AS n FROM review GROUP BY 1) SELECT view, CAST(position AS BIGINT) AS position FROM v WHERE status = 'unreviewed' ORDER BY (position - 6 + n) % n LIMIT 1")
def next_unreviewed(spark, d):
    r = numbered(review.current(reviews(spark, d)).select("view", "status"), [F.asc("view")], "n").withColumn("position", F.col("n") - 1)
    return review.next_unreviewed(r, 5).select("view", "position")


@query(f"WITH RECURSIVE {DET_SQL}, {GRID_SQL}, {AT_SQL} SELECT cell, count(*) AS detection_count, max(detected_at) AS last_scanned FROM att WHERE cell IS NOT NULL GROUP BY 1")
def incremental_grid_counts(spark, d):
    """The events as a stream in one run of available data; equals the batch count."""
    rows = cut(detections(spark, d).select("lat", "lng", "detected_at"))
    stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    name = f"cells_{uuid.uuid4().hex}"
    q = incremental.cell_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
