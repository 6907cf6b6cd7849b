"""Rays, panorama coordinates, camera views and reprojection of boxes, as column expressions over structs of doubles."""

from __future__ import annotations

from math import cos, pi, radians, sin, tan

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import VIEWS

#: Viewing direction, right and down of each view before scaling by the half-angle.
AXES = {
    "front": ((0, 0, 1), (1, 0, 0), (0, -1, 0)),
    "right": ((1, 0, 0), (0, 0, -1), (0, -1, 0)),
    "back": ((0, 0, -1), (-1, 0, 0), (0, -1, 0)),
    "left": ((-1, 0, 0), (0, 0, 1), (0, -1, 0)),
    "up": ((0, 1, 0), (1, 0, 0), (0, 0, 1)),
    "down": ((0, -1, 0), (1, 0, 0), (0, 0, -1)),
}
HALF_FOV_DEG = 50
MIN_DEPTH = 0.01


def views(spark: SparkSession) -> DataFrame:
    """The six views: view_id and the vectors origin, right, down (arrays of 3)."""
    e = tan(radians(HALF_FOV_DEG))
    rows = [(v, [float(x) for x in AXES[v][0]], [x * e for x in AXES[v][1]], [x * e for x in AXES[v][2]], 1.0) for v in VIEWS]
    return spark.createDataFrame(rows, "view_id string, origin array<double>, right array<double>, down array<double>, aspect double")


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _components(view: dict[str, Column], x: Column, y: Column) -> list[Column]:
    return [view["origin"][i] + (2 * x - 1) * view["right"][i] + (2 * y - 1) * view["down"][i] for i in range(3)]


def ray(view: dict[str, Column], x: Column, y: Column) -> Column:
    """The ray through a point (0 to 1) of a view."""
    return F.array(*_components(view, x, y))


def ray_to_uv(r: Column) -> tuple[Column, Column]:
    norm = F.sqrt(dot(r, r))
    u = F.pmod(F.atan2(r[0] / norm, r[2] / norm) / (2 * pi) + 0.5, F.lit(1.0))
    v = 0.5 - F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r[1] / norm))) / pi
    return u, v


def uv_to_ray(u: Column, v: Column) -> Column:
    lng, lat = (u - 0.5) * (2 * pi), (0.5 - v) * pi
    return F.array(F.sin(lng) * F.cos(lat), F.sin(lat), F.cos(lng) * F.cos(lat))


def point_to_basic(view: dict[str, Column], x: Column, y: Column) -> Column:
    """Panorama coordinates of a point of a view."""
    return F.array(*ray_to_uv(ray(view, x, y)))


def view_from_samples(centre, right, down) -> dict[str, Column]:
    """Camera vectors from the panorama coordinates of the centre of a view and of points halfway to its right and lower
    edge (pairs of columns); too wide a view (a sample nearly behind) is an error."""
    origin = uv_to_ray(*centre)

    def tangent(point) -> Column:
        r = uv_to_ray(*point)
        scale = dot(r, origin)
        return F.when(scale <= 0.05, F.raise_error(F.lit("the view is too wide to be sampled"))).otherwise(F.array(*[2 * (r[i] / scale - origin[i]) for i in range(3)]))

    return {"origin": origin, "right": tangent(right), "down": tangent(down)}


def camera_ok(origin: Column, right: Column, down: Column, aspect: Column) -> Column:
    """Unit viewing direction, right angles between the vectors, an aspect that fits their lengths."""
    lo, lr, ld = (F.sqrt(dot(a, a)) for a in (origin, right, down))
    square = (F.abs(dot(origin, right)) / lr <= 0.03) & (F.abs(dot(origin, down)) / ld <= 0.03) & (F.abs(dot(right, down)) / (lr * ld) <= 0.03)
    return (F.abs(lo - 1) <= 0.01) & (lr > 0) & (ld > 0) & square & aspect.between(0.35, 4) & (F.abs(lr / ld / aspect - 1) <= 0.08)


#: Corners and edge middles of a box, as weights of (x1, x2) and (y1, y2).
PERIMETER = [(x, y) for x in (0, 0.5, 1) for y in (0, 0.5, 1) if (x, y) != (0.5, 0.5)]


def reprojected(df: DataFrame, keys: list[str], box, source: dict[str, Column], target: dict[str, Column], out: str = "seen") -> DataFrame:
    """A corner box (four columns) of one view as seen in another: an array in ``out``, null if part of it lies behind.

    Rows are told apart by ``keys``, the only other columns that stay. Each row becomes its eight perimeter points and
    the bounds are an aggregation over them, which combines where the rows are: small generated code, no lambdas.
    """
    spots = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in PERIMETER]))
    axes = [source[k].alias(f"_s{k}") for k in ("origin", "right", "down")] + [target[k].alias(f"_t{k}") for k in ("origin", "right", "down")]
    x = df.select(*keys, *[c.alias(f"_b{i}") for i, c in enumerate(box)], *axes, spots.alias("_p"))
    px, py = F.col("_b0") + (F.col("_b2") - F.col("_b0")) * F.col("_p.x"), F.col("_b1") + (F.col("_b3") - F.col("_b1")) * F.col("_p.y")
    r = F.explode(F.array(F.struct(*[e.alias(f"r{i}") for i, e in enumerate(_components({k: F.col(f"_s{k}") for k in ("origin", "right", "down")}, px, py))])))
    x = x.select(*keys, *[f"_t{k}" for k in ("origin", "right", "down")], r.alias("_r"))
    along = lambda axis: sum((F.col(f"_r.r{i}") * axis[i] for i in range(1, 3)), F.col("_r.r0") * axis[0])
    o = F.col("_torigin")
    place = lambda axis: ((along(axis) / F.col("_depth") - dot(o, axis)) / dot(axis, axis) + 1) / 2
    x = x.withColumn("_depth", along(o))
    ok = F.col("_depth") > MIN_DEPTH
    x = x.select(*keys, "_depth", F.when(ok, place(F.col("_tright"))).alias("_x"), F.when(ok, place(F.col("_tdown"))).alias("_y"))
    g = x.groupBy(*keys).agg(*[f("_" + c).alias(f"_{c}{n}") for c in "xy" for n, f in (("0", F.min), ("1", F.max))], F.min("_depth").alias("_d"))
    zero, one = F.lit(0.0), F.lit(1.0)
    inside = F.array(F.greatest(zero, F.col("_x0")), F.greatest(zero, F.col("_y0")), F.least(one, F.col("_x1")), F.least(one, F.col("_y1")))
    return g.select(*keys, F.when(F.col("_d") > MIN_DEPTH, inside).alias(out))


def rotate(lat_deg: float, lng_deg: float) -> tuple[float, float, float]:
    """Unit vector of a direction, for tests and literals."""
    a, b = radians(lat_deg), radians(lng_deg)
    return sin(b) * cos(a), sin(a), cos(b) * cos(a)


def tile_origins(extent: Column, tile: int, stride: int) -> Column:
    """Starts of overlapping tiles along an axis; the last one ends at the extent."""
    more = F.concat(F.sequence(F.lit(0), F.greatest(extent - tile - 1, F.lit(0)), F.lit(stride)), F.array(extent - tile))
    return F.when(extent <= tile, F.array(F.lit(0))).otherwise(more)
