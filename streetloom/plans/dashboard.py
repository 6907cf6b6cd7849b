"""Dashboard queries over the projected detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import area_pct
from ..operators import analytics, hotspots, store
from ..sources.fixtures import AS_OF, DET_SQL, detections
from .base import leaders_sql, query
from .places import hav

SEV = "CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END"
WITH = f"WITH RECURSIVE {DET_SQL}, sev AS (SELECT *, {SEV} AS severity FROM det)"

#: Edges of the grid as running sums, cells and attribution of points to the lowest cell that holds them.
GRID_SQL = """ys AS (SELECT 0 AS r, 18.4::DOUBLE AS v UNION ALL SELECT r + 1, v + 0.0045::DOUBLE FROM ys WHERE v + 0.0045::DOUBLE < 18.7::DOUBLE),
xs AS (SELECT 0 AS c, 73.7::DOUBLE AS v UNION ALL SELECT c + 1, v + 0.0045::DOUBLE FROM xs WHERE v + 0.0045::DOUBLE < 74.05::DOUBLE),
cells AS (SELECT CAST(r * 78 + c AS BIGINT) AS ordinal, 'grid-' || (r * 78 + c + 1) AS id, ys.v AS lat_min, least(ys.v + 0.0045::DOUBLE, 18.7::DOUBLE) AS lat_max,
  xs.v AS lng_min, least(xs.v + 0.0045::DOUBLE, 74.05::DOUBLE) AS lng_max FROM ys, xs)"""
#: The join runs on each axis alone, so it stays small.
AT_SQL = """ay AS (SELECT d.id, min(r) AS r FROM det d JOIN ys ON d.lat BETWEEN ys.v AND least(ys.v + 0.0045::DOUBLE, 18.7::DOUBLE) GROUP BY d.id),
ax AS (SELECT d.id, min(c) AS c FROM det d JOIN xs ON d.lng BETWEEN xs.v AND least(xs.v + 0.0045::DOUBLE, 74.05::DOUBLE) GROUP BY d.id),
att AS (SELECT d.*, CASE WHEN ay.r IS NOT NULL AND ax.c IS NOT NULL THEN 'grid-' || (ay.r * 78 + ax.c + 1) END AS cell FROM det d LEFT JOIN ay USING (id) LEFT JOIN ax USING (id))"""


def clusters_sql(newest: int | None) -> str:
    """The leader of each detection's cluster, newest first, as ``cl(id, leader)``; needs WITH RECURSIVE."""
    cut = f" QUALIFY node <= {newest}" if newest else ""
    return f"""o AS MATERIALIZED (SELECT id AS node_id, row_number() OVER (ORDER BY detected_at DESC, id) AS node, lat, lng FROM det{cut}),
e AS MATERIALIZED (SELECT a.node AS a, b.node AS b, b.node AS rb FROM o a JOIN o b ON b.node < a.node AND abs(a.lat - b.lat) < 0.00095 AND {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 100),
{leaders_sql()}, cl0 AS (SELECT s.node, CASE WHEN s.lead THEN s.node ELSE min(e.b) END AS leader FROM s LEFT JOIN (e JOIN s h ON h.node = e.b AND h.lead) ON e.a = s.node GROUP BY s.node, s.lead),
cl AS MATERIALIZED (SELECT a.node_id AS id, b.node_id AS leader FROM cl0 JOIN o a ON a.node = cl0.node JOIN o b ON b.node = cl0.leader)"""


#: One row for each cluster, as ``hot``.
HOT_SQL = f"""h0 AS (SELECT leader, avg(lat) AS lat, avg(lng) AS lng, avg(confidence) AS avg_confidence, count(*) AS n, count(DISTINCT image_id) AS images, max(waste_area_pct) AS area, max(detected_at) AS newest, min(detected_at) AS first_seen,
  max(detected_at) FILTER (WHERE id = leader) AS lead_at FROM det JOIN cl USING (id) GROUP BY 1),
hot AS MATERIALIZED (SELECT *, 0.3::DOUBLE * least(area / 20, 1) + 0.25::DOUBLE * least(n / 20, 1) + 0.2::DOUBLE * avg_confidence + 0.15::DOUBLE * greatest(0, 1 - ({AS_OF} - newest) / 86400 / 90) + 0.1::DOUBLE * least(images / 5, 1) AS score FROM h0)"""


def with_severity(spark, d):
    return detections(spark, d).withColumn("severity", analytics.severity(F.col("confidence")))


@query(f"{WITH} SELECT id, image_id, confidence, severity, detected_at FROM sev ORDER BY detected_at DESC, id LIMIT 50 OFFSET 20")
def detections_page(spark, d):
    x = with_severity(spark, d).select("id", "image_id", "confidence", "severity", "detected_at")
    return analytics.page(x, [F.desc("detected_at"), F.asc("id")], 50, 20)


@query(f"{WITH} SELECT id, image_id, severity, detected_at FROM sev WHERE severity = 'high' ORDER BY detected_at DESC, id LIMIT 200")
def detections_by_severity(spark, d):
    x = analytics.with_severity(with_severity(spark, d), "high").select("id", "image_id", "severity", "detected_at")
    return analytics.page(x, [F.desc("detected_at"), F.asc("id")], 200)


@query(f"{WITH} SELECT id, severity FROM sev WHERE id = '17'")
def detection_lookup(spark, d):
    return with_severity(spark, d).where("id = '17'").select("id", "severity")


@query(f"{WITH} SELECT count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM sev")
def severity_distribution(spark, d):
    return with_severity(spark, d).agg(*analytics.severity_counts())


@query(
    f"WITH {DET_SQL} SELECT id, CASE WHEN confidence >= 0.7 OR coalesce(a, 0) > 5 THEN 'high' WHEN confidence >= 0.5 OR coalesce(a, 0) > 2 THEN 'medium' ELSE 'low' END AS severity "
    "FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN waste_area_pct END AS a FROM det)"
)
def severity_area_rule(spark, d):
    area = F.when(F.col("event_id") % 3 != 0, F.col("waste_area_pct"))
    return detections(spark, d).select("id", analytics.severity_with_area(F.col("confidence"), area).alias("severity"))


@query(f"WITH {DET_SQL} SELECT id, CAST(floor(abs(x2 - x1) * abs(y2 - y1) * 100 * 1e6) AS BIGINT) AS area_millionths FROM det")
def box_area(spark, d):
    x = area_pct(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return detections(spark, d).select("id", F.floor(x * 1e6).cast("long").alias("area_millionths"))


@query(f"WITH {DET_SQL} SELECT strftime(to_timestamp(detected_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, count(*) AS count FROM det WHERE detected_at >= {AS_OF - 30 * 86400} GROUP BY 1")
def daily_counts_30d(spark, d):
    return analytics.daily_counts(detections(spark, d), AS_OF)


@query(f"WITH {DET_SQL} SELECT model_used, count(*) AS count FROM det GROUP BY 1 ORDER BY 2 DESC, 1")
def model_usage(spark, d):
    return analytics.model_usage(detections(spark, d))


@query(f"WITH RECURSIVE {DET_SQL}, {GRID_SQL} SELECT id, ordinal, lat_min, lat_max, lng_min, lng_max FROM cells")
def grid_cells(spark, d):
    return store.grid(spark)


@query(
    f"WITH RECURSIVE {DET_SQL}, {GRID_SQL} SELECT 'grid-' || ordinal AS id, CAST(floor(lat_min * 1e6 + 0.5) AS BIGINT) AS lat_min_micro, CAST(floor(lng_min * 1e6 + 0.5) AS BIGINT) AS lng_min_micro FROM cells"
)
def grid_cells_zero_based(spark, d):
    micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(f"{c}_micro")
    return store.grid(spark, base=0).select("id", micro("lat_min"), micro("lng_min"))


@query(f"WITH RECURSIVE {DET_SQL}, {GRID_SQL}, {AT_SQL} SELECT id, cell FROM att")
def grid_attribution(spark, d):
    x = detections(spark, d).select("id", "lat", "lng")
    return store.attribute(x).select("id", "cell")


@query(
    f"WITH RECURSIVE {DET_SQL}, {GRID_SQL}, {AT_SQL}, n AS (SELECT cell, count(*) AS k, max(detected_at) AS t FROM att WHERE cell IS NOT NULL GROUP BY 1) "
    "SELECT id, coalesce(k, 0) AS detection_count, k IS NOT NULL AS scanned, coalesce(t, 0) AS last_scanned FROM cells LEFT JOIN n ON cells.id = n.cell"
)
def grid_counts(spark, d):
    x = detections(spark, d).select("id", "lat", "lng", "detected_at")
    cells = store.grid(spark)
    return store.cell_counts(cells, store.attribute(x)).na.fill(0, ["last_scanned"])


@query(
    f"WITH {DET_SQL} SELECT id, CASE WHEN lat BETWEEN 18.4::DOUBLE AND 18.7::DOUBLE AND lng BETWEEN 73.7::DOUBLE AND 74.05::DOUBLE THEN "
    "'grid-' || (CAST(floor((lat - 18.4::DOUBLE) / 0.0045::DOUBLE) AS BIGINT) * 78 + CAST(floor((lng - 73.7::DOUBLE) / 0.0045::DOUBLE) AS BIGINT)) END AS cell FROM det"
)
def grid_lookup(spark, d):
    return store.lookup(detections(spark, d).select("id", "lat", "lng")).select("id", "cell")


@query(
    f"WITH RECURSIVE {DET_SQL}, {GRID_SQL}, {AT_SQL}, a AS (SELECT count(DISTINCT cell) AS s FROM att) "
    "SELECT a.s AS areas_scanned, t.n AS areas_total, CAST(round(a.s / t.n * 1000) AS BIGINT) AS coverage_permille FROM a, (SELECT count(*) AS n FROM cells) t"
)
def coverage_pct(spark, d):
    x = detections(spark, d).select("id", "lat", "lng", "detected_at")
    cells = store.grid(spark)
    return analytics.coverage(store.cell_counts(cells, store.attribute(x))).select("areas_scanned", "areas_total", F.rint(F.col("coverage_pct") * 10).cast("long").alias("coverage_permille"))


@query(
    f"{WITH}, {GRID_SQL}, {AT_SQL}, {clusters_sql(2000)}, {HOT_SQL} "
    "SELECT (SELECT count(*) FROM sev) AS total_detections, (SELECT count(DISTINCT image_id) FROM sev) AS total_scans, "
    "(SELECT count(*) FROM sev WHERE severity = 'high') AS high, (SELECT count(*) FROM sev WHERE severity = 'medium') AS medium, (SELECT count(*) FROM sev WHERE severity = 'low') AS low, "
    "(SELECT count(*) FROM hot) AS hotspot_count, (SELECT count(*) FROM hot WHERE score > 0.7) AS high_priority, "
    "(SELECT count(DISTINCT cell) FROM att) AS areas_scanned, (SELECT count(*) FROM cells) AS areas_total, "
    f"(SELECT string_agg(d || '=' || n, ',' ORDER BY d) FROM (SELECT strftime(to_timestamp(detected_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS d, count(*) AS n FROM det WHERE detected_at >= {AS_OF - 30 * 86400} GROUP BY 1)) AS daily_counts"
)
def dashboard_stats(spark, d):
    """Everything that the dashboard shows, with the hotspots of the service's own refresh."""
    x = with_severity(spark, d)
    hs = hotspots.snapshot(x, hotspots.cluster(x), AS_OF)
    cells = store.grid(spark)
    grid = store.cell_counts(cells, store.attribute(x.select("id", "lat", "lng", "detected_at")))
    out = analytics.stats(x, hs, grid, AS_OF)
    days = F.array_join(F.transform("daily_counts", lambda r: F.concat(r["date"], F.lit("="), r["count"].cast("string"))), ",")
    return out.withColumn("daily_counts", days)


@query(f"WITH {DET_SQL} SELECT image_id AS id, max(event_id) AS event_id, arg_max(label, event_id) AS label FROM det GROUP BY 1")
def upsert_latest(spark, d):
    x = detections(spark, d).select(F.col("image_id").alias("id"), "event_id", "label")
    return store.latest(x, ["id"], [F.desc("event_id")])


@query(f"WITH {DET_SQL} SELECT image_id AS id, CAST(arg_max(CASE WHEN event_id % 3 = 0 THEN event_id END, event_id) AS BIGINT) AS processed, arg_max(CASE WHEN event_id % 2 = 0 THEN label END, event_id) AS status FROM det GROUP BY 1")
def scan_jobs_view(spark, d):
    log = detections(spark, d).select(
        F.col("image_id").alias("id"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("processed"), F.when(F.col("event_id") % 2 == 0, F.col("label")).alias("status")
    )
    return store.jobs_view(log)


@query(
    f"WITH {DET_SQL}, n AS (SELECT image_id AS id, CAST(count(*) AS DOUBLE) AS score FROM det WHERE event_id % 2 = 0 GROUP BY 1), o AS (SELECT image_id AS id, CAST(count(*) AS DOUBLE) AS score, min(detected_at) AS first_seen, max(detected_at) AS last_seen FROM det WHERE event_id % 3 = 0 GROUP BY 1) "
    f"SELECT id, coalesce(n.score, o.score) AS score, CASE WHEN n.score IS NOT NULL THEN coalesce(o.first_seen, {AS_OF}) ELSE o.first_seen END AS first_seen, CASE WHEN n.score IS NOT NULL THEN {AS_OF} ELSE o.last_seen END AS last_seen FROM n FULL JOIN o USING (id)"
)
def hotspot_upsert(spark, d):
    x = detections(spark, d)
    new = x.where("event_id % 2 = 0").groupBy(F.col("image_id").alias("id")).agg(F.count("*").cast("double").alias("score"))
    old = x.where("event_id % 3 = 0").groupBy(F.col("image_id").alias("id")).agg(F.count("*").cast("double").alias("score"), F.min("detected_at").alias("first_seen"), F.max("detected_at").alias("last_seen"))
    return store.keep_first_seen(old, new, AS_OF)


@query(
    f"WITH {DET_SQL}, g AS (SELECT image_id, max(waste_area_pct) AS area, count(*) AS n, sum(CAST(floor(confidence * 1e6) AS BIGINT)) AS c, max(detected_at) AS newest, count(DISTINCT view_id) AS v FROM det GROUP BY 1) "
    f"SELECT image_id, CAST(floor((0.3::DOUBLE * least(area / 20, 1) + 0.25::DOUBLE * least(n / 20, 1) + 0.2::DOUBLE * (CAST(c AS DOUBLE) / n / 1e6) + 0.15::DOUBLE * greatest(0, 1 - ({AS_OF} - newest) / 86400 / 90) + 0.1::DOUBLE * least(v / 5, 1)) * 1e6 + 0.5) AS BIGINT) AS score_micro FROM g"
)
def hotspot_scores(spark, d):
    x = detections(spark, d).groupBy("image_id").agg(
        F.max("waste_area_pct").alias("area"), F.count("*").alias("n"), F.sum(F.floor(F.col("confidence") * 1e6).cast("long")).alias("c"), F.max("detected_at").alias("newest"), F.countDistinct("view_id").alias("v")
    )
    s = hotspots.score(F.col("area"), F.col("n"), F.col("c").cast("double") / F.col("n") / 1e6, F.col("newest"), F.col("v"), AS_OF)
    return x.select("image_id", F.floor(s * 1e6 + 0.5).cast("long").alias("score_micro"))


@query(f"WITH RECURSIVE {DET_SQL}, {clusters_sql(None)} SELECT id, leader FROM cl")
def hotspot_leaders(spark, d):
    """Every detection with the leader of its cluster."""
    return hotspots.cluster(detections(spark, d), newest=None)


_SNAPSHOT = f"""WITH RECURSIVE {DET_SQL}, {clusters_sql(2000)}, {HOT_SQL}, sn AS MATERIALIZED (SELECT 'hotspot-' || row_number() OVER (ORDER BY lead_at DESC, leader) AS id, *, CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.4 THEN 'medium' ELSE 'low' END AS priority FROM hot)"""


@query(
    f"{_SNAPSHOT} SELECT id, CAST(floor(lat * 1e6 + 0.37::DOUBLE) AS BIGINT) AS lat_micro, CAST(floor(lng * 1e6 + 0.37::DOUBLE) AS BIGINT) AS lng_micro, 100.0::DOUBLE AS radius_m, priority, CAST(floor(score * 1e6 + 0.37::DOUBLE) AS BIGINT) AS score_micro, n AS detection_count, newest AS last_seen, first_seen, "
    "CAST(floor(avg_confidence * 1e6 + 0.37::DOUBLE) AS BIGINT) AS confidence_micro, true AS rounded, n || ' waste observations near ' AS description FROM sn"
)
def hotspot_snapshot(spark, d):
    """The service's own refresh: the newest 2000 detections (its window) clustered, scored and named. Engines round ties
    apart, so the exact values are compared, and that the rounded ones are near them."""
    x = detections(spark, d)
    h = hotspots.snapshot(x, hotspots.cluster(x), AS_OF, exact=True)
    micro = lambda c, n: F.floor(F.col(f"exact.{c}") * 1e6 + 0.37).cast("long").alias(n)
    near = lambda c, digits: F.abs(F.col(c) - F.col(f"exact.{c}")) <= 0.50001 * 10.0**-digits
    rounded = near("lat", 6) & near("lng", 6) & near("score", 4) & near("avg_confidence", 4)
    return h.select(
        "id", micro("lat", "lat_micro"), micro("lng", "lng_micro"), "radius_m", "priority", micro("score", "score_micro"), "detection_count", "last_seen", "first_seen",
        micro("avg_confidence", "confidence_micro"), rounded.alias("rounded"), F.substring_index("description", "(", 1).alias("description"),
    )


def _hot_images(spark, d):
    """Images as hotspots: scores from counts, so that ties occur."""
    e = F.col("event_id")
    x = detections(spark, d).groupBy(F.col("image_id").alias("id")).agg(F.min_by("lat", "event_id").alias("lat"), F.min_by("lng", "event_id").alias("lng"), F.count("*").alias("detection_count"), (F.count_if(e % 3 == 0) / F.lit(64.0)).alias("score"))
    return x.withColumn("priority", hotspots.priority(F.col("score")))


HOT_IMAGES = "hi AS (SELECT image_id AS id, arg_min(lat, event_id) AS lat, arg_min(lng, event_id) AS lng, count(*) AS detection_count, count(*) FILTER (WHERE event_id % 3 = 0) / 64.0::DOUBLE AS score FROM det GROUP BY 1)"


@query(f"WITH {DET_SQL}, {HOT_IMAGES} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM hi")
def hotspots_by_score(spark, d):
    """The list as the service returns it, with the place of each."""
    from pyspark.sql import Window as W

    return hotspots.ranked(_hot_images(spark, d).select("id", "score", F.row_number().over(W.orderBy(F.desc("score"), "id")).cast("long").alias("place")))


@query(f"WITH {DET_SQL}, {HOT_IMAGES} SELECT id, score FROM hi WHERE {hav('18.55::DOUBLE', '73.85::DOUBLE', 'lat', 'lng')} <= 9000 ORDER BY score DESC, id LIMIT 1")
def hotspot_near(spark, d):
    """The best hotspot around a place."""
    return hotspots.near(_hot_images(spark, d), 18.55, 73.85, 9000).select("id", "score")


@query(f"WITH {DET_SQL}, {HOT_IMAGES} SELECT id, score, CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.4 THEN 'medium' ELSE 'low' END AS priority, detection_count, lng, lat FROM hi")
def hotspot_geojson(spark, d):
    """The features of the map's text, read back from it."""
    feature = "struct<geometry:struct<coordinates:array<double>>,properties:struct<id:string,score:double,priority:string,detection_count:bigint>>"
    g = analytics.feature_collection(_hot_images(spark, d)).select(F.explode(F.from_json("geojson", f"type string, features array<{feature}>")["features"]).alias("f"))
    return g.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lng"), F.col("f.geometry.coordinates")[1].alias("lat"))


@query(f"WITH {DET_SQL}, j AS (SELECT image_id AS id, max(detected_at) AS started_at, count(*) AS processed FROM det GROUP BY 1) SELECT id, started_at, processed FROM j ORDER BY started_at DESC, id LIMIT 50")
def latest_jobs(spark, d):
    """The service's own window of fifty."""
    x = detections(spark, d).groupBy(F.col("image_id").alias("id")).agg(F.max("detected_at").alias("started_at"), F.count("*").alias("processed"))
    return analytics.latest_jobs(x)


@query(f"WITH RECURSIVE {DET_SQL}, {GRID_SQL}, {AT_SQL}, hit AS (SELECT DISTINCT cell FROM att WHERE CAST(id AS BIGINT) % 50 = 0 AND cell IS NOT NULL) SELECT cells.id, hit.cell IS NOT NULL AS scanned, CASE WHEN hit.cell IS NOT NULL THEN {AS_OF} ELSE 0 END AS last_scanned FROM cells LEFT JOIN hit ON hit.cell = cells.id")
def mark_scanned(spark, d):
    """Cells marked by a list of ids that names some twice."""
    cells = store.grid(spark).select("id", F.lit(False).alias("scanned"), F.lit(0).cast("long").alias("last_scanned"))
    ids = store.attribute(detections(spark, d).where("event_id % 50 = 0")).where("cell is not null").select(F.col("cell").alias("id"))
    return store.mark_scanned(cells, ids, AS_OF).select("id", "scanned", F.col("last_scanned").cast("long").alias("last_scanned"))


@query(
    f"WITH {DET_SQL} SELECT id, strftime(to_timestamp(detected_at) AT TIME ZONE 'UTC', '%m-%d') AS short_day, strftime(to_timestamp(detected_at) AT TIME ZONE 'UTC', '%-d %b %Y') AS shown_date, CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '%' AS shown_confidence, "
    "CAST(floor(x1 * 100 * 1e4 + 0.37::DOUBLE) AS BIGINT) AS css_left, CAST(floor((y2 - y1) * 100 * 1e4 + 0.37::DOUBLE) AS BIGINT) AS css_height FROM det"
)
def display_values(spark, d):
    """What the page shows of each detection: dates, per cent, the frame of the box."""
    box = analytics.css_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    part = lambda n: F.floor(box[n] * 1e4 + 0.37).cast("long").alias(f"css_{n}")
    return detections(spark, d).select(
        "id", analytics.short_day(analytics.utc_day(F.col("detected_at"))).alias("short_day"), analytics.shown_date(F.col("detected_at") * 1000).alias("shown_date"),
        analytics.shown_percent(F.col("confidence")).alias("shown_confidence"), part("left"), part("height"),
    )


@query(
    f"WITH {DET_SQL}, l AS (SELECT image_id AS key, event_id AS w, 'v' || event_id AS value, CASE WHEN event_id % 4 = 0 THEN 86400 ELSE 600 END * 50 AS ttl FROM det), m AS (SELECT key, max(w) AS w, arg_max(value, w) AS value, arg_max(ttl, w) AS ttl FROM l GROUP BY 1) "
    "SELECT key, value, w + ttl AS expires FROM m WHERE w + ttl > (SELECT max(w) + 25000 FROM l)"
)
def live_entries(spark, d):
    """What a cache with times to live still holds a while after the last write."""
    e = F.col("event_id")
    log = detections(spark, d).select(F.col("image_id").alias("key"), e.alias("at"), F.concat(F.lit("v"), e.cast("string")).alias("value"), (F.when(e % 4 == 0, 86400).otherwise(600) * 50).cast("long").alias("ttl"))
    now = log.agg(F.max("at")).first()[0] + 25_000
    return store.live_entries(log, now)


@query(
    f"WITH RECURSIVE {DET_SQL}, c AS MATERIALIZED (SELECT view_id AS key, event_id AS t, image_id AS owner, row_number() OVER (PARTITION BY view_id ORDER BY event_id, image_id) AS k FROM det), "
    "r AS (SELECT key, k, t, owner, t + 300 AS until, true AS granted FROM c WHERE k = 1 UNION ALL SELECT c.key, c.k, c.t, c.owner, CASE WHEN c.t >= r.until THEN c.t + 300 ELSE r.until END, c.t >= r.until FROM r JOIN c ON c.key = r.key AND c.k = r.k + 1) SELECT key, t AS \"at\", owner, granted FROM r"
)
def lease_grants(spark, d):
    """Claims of a lease: one is granted if the one before has run out."""
    x = detections(spark, d).select(F.col("view_id").alias("key"), F.col("event_id").alias("at"), F.col("image_id").alias("owner"))
    return store.leases(x, 300)
