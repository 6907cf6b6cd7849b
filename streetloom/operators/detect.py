"""From raw detector rows to numbered detections: filters, suppression over tiles and over views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import area_pct, unletterbox
from ..functions.sphere import AXES, HALF_FOV_DEG, MIN_DEPTH, PERIMETER
from ..schema import CROSS_VIEW_IOU, TILE_COVER, TILE_EDGE, TILE_IOU, VIEWS
from .analytics import severity_with_area
from .batches import in_groups


def confident(df: DataFrame, threshold: float) -> DataFrame:
    """Finite confidences from the threshold to 1, of class 0 where there is a class."""
    x = df.where(~F.isnan("confidence") & F.col("confidence").between(threshold, 1.0))
    return x.where("cls = 0") if "cls" in df.columns else x


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered from 1 in ``rank``; Spark drops further rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def numbered(df: DataFrame, by: list[str], prefix: str, order: list[Column]) -> DataFrame:
    """Names prefix-1, prefix-2, ... in order inside each group."""
    return df.withColumn("name", F.concat(F.lit(prefix), F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("string")))


def is_cut(x1, y1, x2, y2, left, top, right, bottom, width, height) -> Column:
    """Within two pixels of a tile edge that is no image edge (all in image pixels)."""
    e = TILE_EDGE
    return ((left > 0) & (x1 - left <= e)) | ((top > 0) & (y1 - top <= e)) | ((right < width) & (right - x2 <= e)) | ((bottom < height) & (bottom - y2 <= e))




def decode(raw: DataFrame, frame: dict[str, Column], threshold: float, k: int = 100) -> DataFrame:
    """Detector rows ``raw(image_id, view_id, id, confidence, cls, x1..y2)`` in pixels of the padded input as boxes from
    0 to 1 of the view: finite confidences from the threshold, class 0, clipped, none without an area, the ``k`` most
    confident of each view. ``frame`` has left, top, scale, width and height of the view in the input."""
    x = confident(raw, threshold)
    side = {"x": ("left", "width"), "y": ("top", "height")}
    x = x.withColumns({c: unletterbox(F.col(c), frame[side[c[0]][0]], frame["scale"], frame[side[c[0]][1]]) for c in ("x1", "y1", "x2", "y2")})
    return top_k(x.where("x2 > x1 and y2 > y1"), ["image_id", "view_id"], [F.desc("confidence"), F.asc("id")], k).drop("rank")


def analyse(raw: DataFrame, frame: dict[str, Column], threshold: float) -> DataFrame:
    """A panorama's analysis: the rows of all its views decoded, those that see one object from two views merged,
    numbered by falling confidence in each panorama, with area and severity. Rows to be kept by ``store.latest``."""
    x = numbered(cross_view_nms(decode(raw, frame, threshold)), ["image_id"], "litter-", [F.desc("confidence"), F.asc("id")])
    area = F.round(area_pct(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]), 2)
    x = x.withColumn("name", F.concat_ws("-", "image_id", "name")).withColumn("waste_area_pct", area)
    return x.withColumn("severity", severity_with_area(F.col("confidence"), F.col("waste_area_pct")))


def tile_nms(df: DataFrame, by: list[str]) -> DataFrame:
    """Greedy suppression inside each group: uncut boxes first, then by falling confidence (then id); a box goes if it
    overlaps a kept one by half, or if four fifths of the smaller of the two are common."""

    def over(x: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        inter, a, b = _common(x[i], x[j]), _area(x[i]), _area(x[j])
        union, small = b + a - inter, np.minimum(a, b)
        return (union > 0) & (inter / np.where(union > 0, union, 1) >= TILE_IOU) | (small > 0) & (inter / np.where(small > 0, small, 1) >= TILE_COVER)

    def suppress(t: pa.Table, starts: np.ndarray):  # noqa: ANN202
        yield t.filter(pa.array(_first_come(_corners(t), np.zeros(len(t), int), starts, lambda x, at: x, over)))

    x = df.select(*by, "id", "confidence", "cut", "x1", "y1", "x2", "y2")
    order = [F.asc_nulls_last("cut"), F.when(~F.isnan("confidence"), F.col("confidence")).desc_nulls_last(), F.asc_nulls_last("id")]
    return in_groups(x, by, order, suppress, _ddl(x))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)


def _corners(t: pa.Table) -> np.ndarray:
    return np.stack([t[c].cast(pa.float64()).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)


def _area(r: np.ndarray) -> np.ndarray:
    return np.maximum(0, r[..., 2] - r[..., 0]) * np.maximum(0, r[..., 3] - r[..., 1])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])) * np.maximum(0, np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]))


#: Pairs of boxes that are held at once.
PAIRS = 500_000


def _first_come(boxes: np.ndarray, kind: np.ndarray, starts: np.ndarray, prepare, over) -> np.ndarray:  # noqa: ANN001
    """Which rows stay of groups that begin at ``starts``, each in its order: a row goes if a row that stays, earlier in its
    group, is ``over`` it. ``over(prepare(boxes, kind), kind, i, j)`` says of pairs whether i is over j.

    Equal boxes of one ``kind`` in a group are one class, compared once: what its first row is over goes when that row
    stays, and once a row of it goes, all later ones do. So a class has one time from which its rows go, and groups that
    grow by copies take no more comparisons. Classes that have gone before their first row are over nothing.
    """
    n = len(boxes)
    if not n:
        return np.zeros(0, bool)
    group = np.zeros(n, np.int64)
    group[starts] = 1
    group = np.cumsum(group) - 1
    keys = np.column_stack([np.ascontiguousarray(boxes).view(np.int64), kind, group])
    by = np.lexsort((np.arange(n), *keys.T[:-1], keys[:, -1]))
    new = np.ones(n, bool)
    new[1:] = (keys[by][1:] != keys[by][:-1]).any(1)
    of = np.empty(n, np.int64)
    of[by] = np.cumsum(new) - 1
    # classes in the order of their first rows
    first = by[new]
    rank = np.argsort(first)
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    first, of = first[rank], place[of]
    b, k, g = boxes[first], kind[first], group[first]
    begin = np.searchsorted(g, np.arange(len(starts)))
    size = np.append(begin[1:], len(g)) - begin
    many = np.bincount(of, minlength=len(first)) > 1
    made = prepare(b, k)
    gone = np.full(len(first), n, np.int64)
    lo = 0
    each, base = size[g], begin[g]
    upto = np.cumsum(each)
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        i = np.arange(lo, hi)[gone[lo:hi] > first[lo:hi]]  # the others have gone already
        m = each[i]
        j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(base[i], m)
        i = np.repeat(i, m)
        later = (j > i) | many[j]  # a class of one row is only met by earlier ones
        i, j = i[later], j[later]
        hit = over(made, k, i, j)
        for p, q in zip(i[hit].tolist(), j[hit].tolist()):
            if gone[p] > first[p] and gone[q] > first[p]:
                # its own first row is not over itself, only over what comes later
                gone[q] = first[p] if p != q else first[p] + 1
        lo = hi
    return np.arange(n) < gone[of]


def _seen_from_all(view: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Corner boxes as seen in each of the views, n x views x 4 (see ``sphere.reprojected``); nan where part lies behind."""
    e = np.tan(np.radians(HALF_FOV_DEG))
    origin, right, down = (np.array([AXES[v][i] for v in VIEWS], float) * (e if i else 1) for i in range(3))
    low, high = np.full((len(b), len(VIEWS), 2), np.inf), np.full((len(b), len(VIEWS), 2), -np.inf)
    behind = np.zeros((len(b), len(VIEWS)), bool)
    for wx, wy in PERIMETER:
        x, y = b[:, 0] + (b[:, 2] - b[:, 0]) * wx, b[:, 1] + (b[:, 3] - b[:, 1]) * wy
        ray = origin[view] + (2 * x - 1)[:, None] * right[view] + (2 * y - 1)[:, None] * down[view]
        depth = ray @ origin.T
        ok = depth > MIN_DEPTH
        behind |= ~ok
        depth = np.where(ok, depth, 1)
        at = np.stack([((ray @ a.T / depth - (origin * a).sum(1)) / (a * a).sum(1) + 1) / 2 for a in (right, down)], axis=2)
        low, high = np.minimum(low, at), np.maximum(high, at)
    seen = np.concatenate([np.maximum(0, low), np.minimum(1, high)], axis=2)
    seen[behind] = np.nan
    return seen


def cross_view_nms(df: DataFrame, by: str = "image_id") -> DataFrame:
    """Greedy suppression over the views of a panorama: by falling confidence (then id), a box goes if a kept box of
    another view, seen from its own, overlaps it by ``CROSS_VIEW_IOU``.

    Equal boxes of a view are compared once for each panorama (``_first_come``), and a box is seen once in each other view.
    Memory grows with the boxes of a panorama and not with their pairs. Boxes without a confidence or of no known view
    neither suppress nor go.
    """

    def prepare(b: np.ndarray, view: np.ndarray) -> tuple:
        seen = _seen_from_all(view, b)
        return b, _area(b), seen, _area(seen)

    def over(x: tuple, view: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        b, areas, seen, sizes = x
        out = np.zeros(len(i), bool)
        at = np.flatnonzero((view[i] != view[j]) & (view[i] >= 0) & (view[j] >= 0))
        i, j = i[at], j[at]
        s, of = seen[i, view[j]], sizes[i, view[j]]
        at, s, of, j = (v[of > 0] for v in (at, s, of, j))
        inter = _common(b[j], s)
        out[at] = inter / (areas[j] + of - inter) >= CROSS_VIEW_IOU
        return out

    def suppress(t: pa.Table, starts: np.ndarray):  # noqa: ANN202
        view = pc.index_in(t["view_id"], pa.array(VIEWS)).fill_null(-1).to_numpy().astype(np.int64)
        sure = ~np.isnan(t["confidence"].cast(pa.float64()).to_numpy())
        yield t.filter(pa.array(_first_come(_corners(t), np.where(sure, view, -1), starts, prepare, over)))

    order = [F.when(~F.isnan("confidence"), F.col("confidence")).desc_nulls_last(), F.asc_nulls_last("id")]
    return in_groups(df, [by], order, suppress, _ddl(df))
