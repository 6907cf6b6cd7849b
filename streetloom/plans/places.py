"""Queries about places: radius, nearest neighbours, candidates, views and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sphere
from ..functions.geo import haversine_rounded
from ..operators import catalog, spatial
from ..sources.fixtures import DET_SQL, PANO_SQL, detections, panoramas
from .base import query

WITH = f"WITH {DET_SQL}, {PANO_SQL}"


def hav(a: str, b: str, c: str, d: str) -> str:
    s = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, {s}))))"


@query(
    f"{WITH}, n AS (SELECT *, round_even({hav('18.55::DOUBLE', '73.85::DOUBLE', 'lat', 'lng')}, 0) AS rint FROM pano WHERE is_pano) "
    "SELECT id, CAST(rint AS BIGINT) AS distance_m, (SELECT count(*) > 100 FROM n WHERE rint <= 12000) AS truncated FROM n WHERE rint <= 12000 ORDER BY rint, captured_at DESC, id LIMIT 100"
)
def nearby_radius(spark, d):
    """The service's own window of a hundred."""
    return spatial.nearby(panoramas(spark, d), 18.55, 73.85, 12000).select("id", "distance_m", "truncated")


@query(f"{WITH} SELECT a.id AS a, b.id AS b, CAST(floor({hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}) AS BIGINT) AS metres FROM det a JOIN det b ON a.event_id < b.event_id AND abs(a.lat - b.lat) < 0.00095 WHERE {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 100")
def radius_pairs(spark, d):
    x = detections(spark, d).select("id", F.col("event_id").alias("rank"), "lat", "lng")
    return spatial.pairs_within(x, 100).select("a", "b", F.floor("distance_m").cast("long").alias("metres"))


@query(f"{WITH}, t AS (SELECT lat, lng FROM pano WHERE user_id % 10 = 0) SELECT p.id, CAST(min(round_even({hav('p.lat', 'p.lng', 't.lat', 't.lng')}, 0)) AS BIGINT) AS nearest_m FROM pano p, t GROUP BY 1")
def nearest_distance(spark, d):
    p = panoramas(spark, d)
    return spatial.nearest_distance(p.select("id", "lat", "lng"), p.where("user_id % 10 = 0"), F.col("id")).select("id", "nearest_m")


@query(
    f"{WITH}, t AS (SELECT lat, lng FROM pano WHERE user_id % 50 = 7), x AS (SELECT p.id, p.sequence, p.user_id, min(round_even({hav('p.lat', 'p.lng', 't.lat', 't.lng')}, 0)) AS m FROM pano p, t GROUP BY ALL) "
    "SELECT CASE WHEN user_id % 9 = 0 THEN 'already reviewed' WHEN sequence IN ('seq-3', 'seq-5') THEN 'test sequence' WHEN m < 300 THEN 'within 300 m of a test panorama' ELSE 'safe' END AS reason, count(*) AS count FROM x GROUP BY 1"
)
def candidate_exclusions(spark, d):
    p = panoramas(spark, d)
    tests = p.where("sequence in ('seq-3', 'seq-5')").select("sequence")
    x = catalog.candidates(p, p.where("user_id % 50 = 7"), p.where("user_id % 9 = 0").select("id"), tests)
    return x.groupBy("reason").agg(F.count("*").alias("count"))


@query(f"{WITH} SELECT sequence, count(*) AS panoramas, arg_min(creator, {{'a': captured_at, 'b': id}}) AS creator, array_to_string(list_sort(list(DISTINCT year(make_timestamp(captured_at * 1000)))), ' ') AS years FROM pano GROUP BY 1")
def sequence_summary(spark, d):
    return catalog.sequence_summary(panoramas(spark, d)).withColumn("years", F.array_join(F.col("years").cast("array<string>"), " "))


@query(
    f"{WITH}, a(area, y, x) AS (VALUES ('centre', 18.52::DOUBLE, 73.85::DOUBLE), ('north', 18.62::DOUBLE, 73.80::DOUBLE), ('nowhere', 18.0::DOUBLE, 73.0::DOUBLE)), "
    f"f AS (SELECT area, sequence, round_even({hav('y', 'x', 'lat', 'lng')}, 0) AS m FROM a JOIN pano ON is_pano AND round_even({hav('y', 'x', 'lat', 'lng')}, 0) <= 3000) "
    "SELECT a.area, count(f.m) AS found, count(DISTINCT f.sequence) AS sequences, coalesce(CAST(min(f.m) AS BIGINT), -1) AS nearest_m, count(f.m) >= 5 AS possibly_capped FROM a LEFT JOIN f USING (area) GROUP BY 1"
)
def survey_rollup(spark, d):
    areas = spark.createDataFrame([("centre", 18.52, 73.85), ("north", 18.62, 73.80), ("nowhere", 18.0, 73.0)], "area string, a_lat double, a_lng double")
    return catalog.survey(panoramas(spark, d), areas, 3000, 5).na.fill(-1, ["nearest_m"])


@query("SELECT CAST(floor((18.40::DOUBLE + y * 0.01::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS lat_micro, CAST(floor((73.70::DOUBLE + x * 0.01::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS lng_micro FROM range(31) a(y), range(36) b(x)")
def search_points(spark, d):
    x = catalog.sample_grid(spark, 73.70, 18.40, 74.05, 18.70, 0.01)
    return x.select(F.floor(F.col("lat") * 1e6 + 0.5).cast("long").alias("lat_micro"), F.floor(F.col("lng") * 1e6 + 0.5).cast("long").alias("lng_micro"))


@query(f"{WITH} SELECT DISTINCT ON (sequence) sequence, id FROM pano ORDER BY sequence, captured_at DESC, id")
def unique_last(spark, d):
    p = panoramas(spark, d).select(F.col("sequence").alias("id"), F.col("id").alias("pano"), "captured_at")
    return catalog.unique(p, [F.desc("captured_at"), F.asc("pano")]).select(F.col("id").alias("sequence"), F.col("pano").alias("id"))


@query(
    "WITH e AS (SELECT e, t FROM (VALUES (500), (640), (641), (1024), (1400)) v(e), (VALUES (640)) w(t)), o AS (SELECT e, unnest(CASE WHEN e <= t THEN [0] ELSE list_concat(range(0, e - t, 384), [e - t]) END) AS origin FROM e) SELECT e AS extent, CAST(origin AS INT) AS origin FROM o"
)
def tile_grid(spark, d):
    x = spark.createDataFrame([(500,), (640,), (641,), (1024,), (1400,)], "extent int")
    return x.select("extent", F.explode(sphere.tile_origins(F.col("extent"), 640, 384)).alias("origin"))


_V = "tan(radians(50::DOUBLE))"
VIEWS_SQL = f"""v(view_id, o, r, dn) AS (VALUES ('front', [0,0,1]::DOUBLE[], [{_V},0,0], [0,-{_V},0]), ('right', [1,0,0]::DOUBLE[], [0,0,-{_V}], [0,-{_V},0]), ('back', [0,0,-1]::DOUBLE[], [-{_V},0,0], [0,-{_V},0]),
 ('left', [-1,0,0]::DOUBLE[], [0,0,{_V}], [0,-{_V},0]), ('up', [0,1,0]::DOUBLE[], [{_V},0,0], [0,0,{_V}]), ('down', [0,-1,0]::DOUBLE[], [{_V},0,0], [0,0,-{_V}]))"""


def _dot(a: str, b: str) -> str:
    return f"({a}[1]*{b}[1] + {a}[2]*{b}[2] + {a}[3]*{b}[3])"


@query(
    f"WITH {DET_SQL}, {VIEWS_SQL}, p AS (SELECT id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, v.* FROM det JOIN v USING (view_id)), "
    "q AS (SELECT id, [o[1] + (2*x-1)*r[1] + (2*y-1)*dn[1], o[2] + (2*x-1)*r[2] + (2*y-1)*dn[2], o[3] + (2*x-1)*r[3] + (2*y-1)*dn[3]] AS k FROM p), "
    f"n AS (SELECT id, k, sqrt({_dot('k', 'k')}) AS z FROM q), uv AS (SELECT id, atan2(k[1]/z, k[3]/z) / (2*pi()) + 0.5::DOUBLE AS u, 0.5::DOUBLE - asin(greatest(-1, least(1, k[2]/z))) / pi() AS v FROM n) "
    "SELECT id, CAST(floor((u - floor(u)) * 1e6 + 0.5) AS BIGINT) AS u_micro, CAST(floor(v * 1e6 + 0.5) AS BIGINT) AS v_micro FROM uv"
)
def panorama_tags(spark, d):
    x = detections(spark, d).join(F.broadcast(sphere.views(spark)), "view_id")
    tag = sphere.point_to_basic({k: F.col(k) for k in ("origin", "right", "down")}, (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    return x.select("id", F.floor(tag[0] * 1e6 + 0.5).cast("long").alias("u_micro"), F.floor(tag[1] * 1e6 + 0.5).cast("long").alias("v_micro"))


_PTS = " UNION ALL ".join(f"SELECT {i} AS i, {x}::DOUBLE AS wx, {y}::DOUBLE AS wy" for i, (x, y) in enumerate(sphere.PERIMETER))


def reprojected_sql(boxes: str, name: str = "seen") -> str:
    """Boxes of a CTE (id, view_id, x1..y2) as seen in each other view, as ``name(id, target, x1..y2)``; needs ``VIEWS_SQL``."""
    return (
        f"{name}_b AS (SELECT d.id, s.o AS so, s.r AS sr, s.dn AS sd, t.view_id AS target, t.o AS o, t.r AS r, t.dn AS dn, x1 + (x2 - x1) * wx AS x, y1 + (y2 - y1) * wy AS y "
        f"FROM {boxes} d JOIN v s ON s.view_id = d.view_id JOIN v t ON t.view_id <> d.view_id, ({_PTS}) pts), "
        f"{name}_k AS (SELECT *, [so[1] + (2*x-1)*sr[1] + (2*y-1)*sd[1], so[2] + (2*x-1)*sr[2] + (2*y-1)*sd[2], so[3] + (2*x-1)*sr[3] + (2*y-1)*sd[3]] AS ray FROM {name}_b), "
        f"{name}_z AS (SELECT *, {_dot('ray', 'o')} AS depth FROM {name}_k), {name}_w AS (SELECT *, [ray[1]/depth - o[1], ray[2]/depth - o[2], ray[3]/depth - o[3]] AS pl FROM {name}_z), "
        f"{name} AS MATERIALIZED (SELECT * EXCLUDE (depth) FROM (SELECT id, target, min(depth) AS depth, greatest(0, min(({_dot('pl', 'r')} / {_dot('r', 'r')} + 1) / 2)) AS x1, greatest(0, min(({_dot('pl', 'dn')} / {_dot('dn', 'dn')} + 1) / 2)) AS y1, "
        f"least(1, max(({_dot('pl', 'r')} / {_dot('r', 'r')} + 1) / 2)) AS x2, least(1, max(({_dot('pl', 'dn')} / {_dot('dn', 'dn')} + 1) / 2)) AS y2 FROM {name}_w GROUP BY 1, 2) WHERE depth > 0.01)"
    )


@query(
    f"WITH {DET_SQL}, {VIEWS_SQL}, {reprojected_sql('det', 'f')} "
    "SELECT id, target, CAST(floor(x1 * 1e6 + 0.5) AS BIGINT) AS x1, CAST(floor(y1 * 1e6 + 0.5) AS BIGINT) AS y1, CAST(floor(x2 * 1e6 + 0.5) AS BIGINT) AS x2, CAST(floor(y2 * 1e6 + 0.5) AS BIGINT) AS y2 FROM f"
)
def reproject_box(spark, d):
    v = sphere.views(spark)
    s = v.select("view_id", F.struct("origin", "right", "down").alias("s"))
    t = v.select(F.col("view_id").alias("target"), F.struct("origin", "right", "down").alias("t"))
    x = detections(spark, d).join(F.broadcast(s), "view_id").join(F.broadcast(t), F.col("view_id") != F.col("target"))  # six rows
    axes = lambda n: {k: F.col(n)[k] for k in ("origin", "right", "down")}
    x = sphere.reprojected(x, ["id", "target"], [F.col(c) for c in ("x1", "y1", "x2", "y2")], axes("s"), axes("t"), "b").where("b is not null")
    return x.select("id", "target", *[F.floor(F.col("b")[i] * 1e6 + 0.5).cast("long").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query(f"{WITH} SELECT id, CAST(round_even({hav('18.5204::DOUBLE', '73.8567::DOUBLE', 'lat', 'lng')}, 0) AS BIGINT) AS metres FROM pano")
def haversine_metres(spark, d):
    return panoramas(spark, d).select("id", haversine_rounded(F.lit(18.5204), F.lit(73.8567), F.col("lat"), F.col("lng")).alias("metres"))


_AREAS_SQL = "a(area, y, x) AS (VALUES ('centre', 18.52::DOUBLE, 73.85::DOUBLE), ('north', 18.62::DOUBLE, 73.80::DOUBLE), ('near', 18.54::DOUBLE, 73.86::DOUBLE))"


@query(
    f"{WITH}, {_AREAS_SQL}, f AS (SELECT area, id, round_even({hav('y', 'x', 'lat', 'lng')}, 0) AS m FROM a JOIN pano ON is_pano AND lat BETWEEN 18.4 AND 18.7 AND lng BETWEEN 73.7 AND 74.05 AND round_even({hav('y', 'x', 'lat', 'lng')}, 0) <= 6000) "
    "SELECT id, min(area) AS area, CAST(arg_min(m, area) AS BIGINT) AS metres, count(*) AS areas FROM f GROUP BY 1"
)
def survey_union(spark, d):
    areas = spark.createDataFrame([("centre", 18.52, 73.85), ("north", 18.62, 73.80), ("near", 18.54, 73.86)], "area string, a_lat double, a_lng double")
    return catalog.survey_union(panoramas(spark, d), areas, 6000).select("id", "area", "metres", "areas")


@query(f"{WITH}, k AS (SELECT sequence, min(captured_at * 100000 + user_id) AS position FROM pano GROUP BY 1) SELECT sequence, position FROM k")
def sequences_first_seen(spark, d):
    p = panoramas(spark, d).select("sequence", (F.col("captured_at") * 100000 + F.col("user_id")).alias("position"))
    return catalog.first_seen(p, "sequence", "position")


@query(f"{WITH} SELECT id, CASE WHEN user_id % 5 = 0 THEN '' ELSE creator END AS creator, user_id % 3 <> 0 AND is_pano AS is_pano, CAST(floor(lat * 1e6 + 0.5) AS BIGINT) AS lat_micro, CAST(floor(lng * 1e6 + 0.5) AS BIGINT) AS lng_micro, '' AS thumbnail, sequence FROM pano")
def catalogue_records(spark, d):
    """Records of a catalogue with gaps, as panoramas."""
    p, u = panoramas(spark, d), F.col("user_id")
    point = lambda ok: F.when(ok, F.struct(F.array("lng", "lat").alias("coordinates")))
    raw = p.select(
        "id", "captured_at", F.when(u % 5 != 0, F.struct(F.col("creator").alias("username"))).alias("creator"), F.when(u % 3 != 0, F.col("is_pano")).alias("is_pano"),
        F.lit(None).cast("string").alias("thumb_1024_url"), "sequence", point(u % 2 == 0).alias("computed_geometry"), point(F.lit(True)).alias("geometry"),
    )
    x = catalog.with_defaults(raw)
    micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(f"{c}_micro")
    return x.select("id", "creator", "is_pano", micro("lat"), micro("lng"), "thumbnail", "sequence")


@query(f"{WITH} SELECT id, 'Place ' || user_id AS name, 'search:' || lower(trim('  ' || upper(id) || ' ')) AS key FROM pano WHERE user_id % 4 <> 1 AND user_id % 7 <> 2")
def geocoder_places(spark, d):
    """Answers of a geocoder: some outside the area, some without a number, others are places."""
    p, u = panoramas(spark, d), F.col("user_id")
    lat = F.when(u % 4 == 1, F.lit("19.9")).when(u % 7 == 2, "none").otherwise(F.col("lat").cast("string"))
    raw = p.select(F.col("id").alias("place_id"), F.concat(F.lit("Place "), u.cast("string")).alias("display_name"), lat.alias("lat"), F.col("lng").cast("string").alias("lon"))
    return catalog.places_found(raw).select("id", "name", catalog.search_key(F.concat(F.lit("  "), F.upper("id"), F.lit(" "))).alias("key"))


def _uv(k: str) -> tuple[str, str]:
    return f"((({k} * 37) % 1000) / 1000.0::DOUBLE)", f"(0.2::DOUBLE + (({k} * 53) % 600) / 1000.0::DOUBLE)"


def _ray_sql(u: str, v: str) -> str:
    lng, lat = f"((({u}) - 0.5::DOUBLE) * (2 * pi()))", f"((0.5::DOUBLE - ({v})) * pi())"
    return f"[sin({lng}) * cos({lat}), sin({lat}), cos({lng}) * cos({lat})]"


@query(
    f"WITH {DET_SQL}, q AS (SELECT id, {_ray_sql(*_uv('event_id'))} AS o, {_ray_sql(_uv('event_id')[0] + ' + 0.05::DOUBLE', _uv('event_id')[1])} AS r, {_ray_sql(_uv('event_id')[0], _uv('event_id')[1] + ' + 0.05::DOUBLE')} AS dn FROM det), "
    f"s AS (SELECT id, o, [2 * (r[i] / {_dot('r', 'o')} - o[i]) for i in [1, 2, 3]] AS right_, [2 * (dn[i] / {_dot('dn', 'o')} - o[i]) for i in [1, 2, 3]] AS down_ FROM q) "
    + "SELECT id, " + ", ".join(f"CAST(floor({c}[{i + 1}] * 1e6 + 0.37::DOUBLE) AS BIGINT) AS {n}{i}" for n, c in (("o", "o"), ("r", "right_"), ("d", "down_")) for i in range(3)) + " FROM s"
)
def sampled_views(spark, d):
    """Cameras from three points of the viewer: the centre, halfway right and halfway down."""
    e = F.col("event_id")
    u, v = ((e * 37) % 1000) / F.lit(1000.0), F.lit(0.2) + ((e * 53) % 600) / F.lit(1000.0)
    view = sphere.view_from_samples((u, v), (u + 0.05, v), (u, v + 0.05))
    names = (("o", "origin"), ("r", "right"), ("d", "down"))
    return detections(spark, d).select("id", *[F.floor(view[c][i] * 1e6 + 0.37).cast("long").alias(f"{n}{i}") for n, c in names for i in range(3)])


@query(f"WITH {DET_SQL}, {VIEWS_SQL} SELECT id, event_id % 4 = 0 AS ok FROM det JOIN v USING (view_id)")
def camera_rules(spark, d):
    """One of four cameras is whole; the others have a long axis, a skewed one or a wrong aspect."""
    x = detections(spark, d).join(F.broadcast(sphere.views(spark)), "view_id")
    k = F.col("event_id") % 4
    origin = F.when(k == 1, F.transform("origin", lambda c: c * 1.1)).otherwise(F.col("origin"))
    right = F.when(k == 2, F.zip_with("right", "down", lambda a, b: a + 0.2 * b)).otherwise(F.col("right"))
    return x.select("id", sphere.camera_ok(origin, right, F.col("down"), F.when(k == 3, 1.2).otherwise(F.lit(1.0))).alias("ok"))
