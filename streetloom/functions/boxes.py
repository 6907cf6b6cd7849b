"""Boxes as four double columns or arrays: overlap, formats, clipping, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INPUT_PX, KEEP_VISIBLE, MIN_LABEL_PX, SIZE_BUCKETS


def corners(box: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(box[i] for i in range(4))


def area(a) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def intersection(a, b) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a, b) -> Column:
    """Intersection over union of two corner boxes (four columns each); 0 where the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def cover(a, b) -> Column:
    """Intersection over the smaller area."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(F.lit(0.0))


def from_xywh(x, y, w, h) -> tuple[Column, ...]:
    return x, y, x + w, y + h


def centre_to_corners(cx, cy, w, h) -> tuple[Column, ...]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def corners_to_centre(x1, y1, x2, y2) -> tuple[Column, ...]:
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def clip01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def area_pct(x1, y1, x2, y2) -> Column:
    return F.abs(x2 - x1) * F.abs(y2 - y1) * 100


def short_side_px(w: Column, h: Column, width: Column, height: Column, size: int = INPUT_PX) -> Column:
    """Short side of a box of w x h image pixels after scaling the image's long side to the detector's."""
    return F.least(w, h) * F.lit(float(size)) / F.greatest(width, height)


def size_bucket(side: Column) -> Column:
    out = F.lit(SIZE_BUCKETS[-1][0])
    for name, _, high in reversed(SIZE_BUCKETS[:-1]):
        out = F.when(side < high, name).otherwise(out)
    return out


def letterbox(width: Column, height: Column, size: int = INPUT_PX) -> dict[str, Column]:
    """Scale and offsets with which an image lies centred in a square."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    rw, rh = F.rint(width * scale), F.rint(height * scale)
    return {"scale": scale, "left": F.floor((size - rw) / 2).cast("int"), "top": F.floor((size - rh) / 2).cast("int")}


def unletterbox(v: Column, offset: Column, scale: Column, extent: Column) -> Column:
    return clip01((v - offset) / scale / extent)


def window_class(visible: Column, w: Column, h: Column) -> Column:
    """What becomes of a box in a window: null (outside), grey, dropped or kept."""
    return (
        F.when(visible <= 0, F.lit(None).cast("string"))
        .when(visible < KEEP_VISIBLE, "grey")
        .when(F.least(w, h) < MIN_LABEL_PX, "dropped")
        .otherwise("kept")
    )


def normalised(pred: Column, width: Column, height: Column) -> Column:
    """A box of any of three formats as [x1, y1, x2, y2] from 0 to 1: centre and size, corners, or ready-made array.

    ``pred`` is a struct with the fields x, y, width, height, x1, y1, x2, y2 and bbox; null if no format is complete.
    """
    zero, one = F.lit(0.0), F.lit(1.0)

    def known(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & pred[n].isNotNull()
        return out

    cx, cy, w, h = (pred[n] for n in ("x", "y", "width", "height"))
    first = F.array(F.greatest(zero, (cx - w / 2) / width), F.greatest(zero, (cy - h / 2) / height), F.least(one, (cx + w / 2) / width), F.least(one, (cy + h / 2) / height))
    second = F.array(F.greatest(zero, pred["x1"] / width), F.greatest(zero, pred["y1"] / height), F.least(one, pred["x2"] / width), F.least(one, pred["y2"] / height))
    b = pred["bbox"]
    third = F.array(F.greatest(zero, F.get(b, F.lit(0))), F.greatest(zero, F.get(b, F.lit(1))), F.least(one, F.get(b, F.lit(2))), F.least(one, F.get(b, F.lit(3))))
    return F.when(known("x", "y", "width", "height"), first).when(known("x1", "y1", "x2", "y2"), second).when(F.size(b) == 4, third)
