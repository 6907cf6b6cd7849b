"""Derived training images, planned on geometry alone: windows, label sizes, collages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import area, intersection, window_class
from ..session import ship


def window_labels(boxes: DataFrame) -> DataFrame:
    """Boxes (pixels) clipped to windows ``x0, y0, ww, wh`` of the same row, in window coordinates, and what becomes of
    them: kept, grey (too little visible) or dropped (too small); those outside are left out."""
    b = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    w = [F.col("x0"), F.col("y0"), F.col("x0") + F.col("ww"), F.col("y0") + F.col("wh")]
    inter, full = intersection(b, w), area(b)
    x1, y1 = F.greatest(b[0], w[0]) - F.col("x0"), F.greatest(b[1], w[1]) - F.col("y0")
    x2, y2 = F.least(b[2], w[2]) - F.col("x0"), F.least(b[3], w[3]) - F.col("y0")
    visible = F.when(full > 0, inter / full).otherwise(F.lit(0.0))
    x = boxes.withColumns({"visible": visible, "kind": window_class(visible, x2 - x1, y2 - y1), "wx1": x1, "wy1": y1, "wx2": x2, "wy2": y2})
    return x.where("kind is not null")


def log_uniform(u: Column, low: float, high: float) -> Column:
    from math import log

    return F.exp(F.lit(log(low)) + u * (log(high) - log(low)))


def target_pixels(size_m: Column, distance_m: Column, pixels_per_degree: float) -> Column:
    """How large an object of a size looks from a distance."""
    return F.degrees(2 * F.atan(size_m / (2 * distance_m))) * pixels_per_degree


def reference_side(boxes: DataFrame) -> DataFrame:
    """(photo, reference): the median long side of each photo's boxes."""
    return boxes.groupBy("photo").agg(F.median(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("reference"))


def street_scale(target: Column, reference: Column, width: Column, height: Column, u: Column, least_px: float, tile: float = 640.0) -> Column:
    """The scale at which a photo's objects are ``target`` pixels long, never over 1 and never so small that its long
    side is under ``least_px``; a photo without boxes gets a long side between both sizes by ``u`` (0 to 1)."""
    longest = F.greatest(width, height)
    free = (F.lit(least_px) + u * (tile - least_px)) / longest
    scale = F.coalesce(F.least(F.lit(1.0), target / reference), free)
    return F.least(F.lit(1.0), F.greatest(scale, F.lit(least_px) / longest))


def centred_origin(extent: Column, size: Column, centre: Column, u: Column) -> Column:
    """Where a window starts so that ``centre`` lies in its middle three fifths (``u`` from 0 to 1 says where), inside the extent."""
    start = F.least(F.greatest(centre - (0.2 + 0.6 * u) * size, F.lit(0.0)), extent - size)
    return F.when(extent <= size, 0).otherwise(start.cast("long")).cast("long")


def derivative_means(tiles: DataFrame) -> DataFrame:
    """One row over ``tiles(parts, clean_parts, labels, grey_share)``: means as the build reports them, null without tiles."""
    return tiles.agg(
        F.round(F.avg("parts"), 2).alias("photos_per_tile"), F.round(F.avg("grey_share"), 3).alias("grey_share"), F.round(F.avg("labels"), 1).alias("labels_per_tile"),
        F.round(F.avg(F.col("clean_parts") / F.col("parts")), 3).alias("clean_share_of_parts"), F.count_if(F.col("labels") == 0).alias("tiles_without_labels"),
    )


def is_clear(windows: DataFrame, boxes: DataFrame, margin: float = 16.0) -> DataFrame:
    """Windows of an image that keep ``margin`` pixels from all its boxes; ``windows(image, x0, y0, ww, wh)``."""
    b = boxes.select(F.col("image").alias("_i"), *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    near = (
        (F.col("image") == F.col("_i")) & (F.col("_x1") < F.col("x0") + F.col("ww") + margin) & (F.col("_x2") > F.col("x0") - margin)
        & (F.col("_y1") < F.col("y0") + F.col("wh") + margin) & (F.col("_y2") > F.col("y0") - margin)
    )
    return windows.join(b, near, "left_anti")


def pack_collages(parts: DataFrame, size: int = 640, least: int = 32) -> DataFrame:
    """Places of parts (collage, part, w, h) on square canvases: the largest free rectangle takes the next part that
    fits it (largest first) at its top left, and what is left of it to the right and below is free again.

    The order matters inside a canvas only, so each canvas is one small group.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        waiting = sorted(pdf.itertuples(index=False), key=lambda r: (-r.w * r.h, r.part))
        free, out = [(0.0, 0.0, float(size), float(size))], []
        while free and waiting:
            free.sort(key=lambda r: (r[2] * r[3], -r[1], -r[0]))
            x, y, w, h = free.pop()
            k = next((i for i, r in enumerate(waiting) if r.w <= w and r.h <= h), None)
            if k is None:
                continue
            r = waiting.pop(k)
            out.append((r.collage, r.part, x, y, float(r.w), float(r.h)))
            for rest in ((x + r.w, y, w - r.w, float(r.h)), (x, y + r.h, w, h - r.h)):
                if min(rest[2:]) >= least:
                    free.append(rest)
        return pd.DataFrame(out, columns=["collage", "part", "x", "y", "w", "h"])

    ship(parts.sparkSession)
    return parts.groupBy("collage").applyInPandas(pack, "collage string, part long, x double, y double, w double, h double")


def laplacian_variance(images: DataFrame) -> DataFrame:
    """Sharpness of grey images given as ``pixels array<array<double>>``: variance of the 4-neighbour Laplacian inside;
    null if a side is under three."""
    import numpy as np

    @F.pandas_udf("double")
    def sharp(pixels: pd.Series) -> pd.Series:
        def one(p) -> float | None:
            a = np.array([list(r) for r in p], float) if p is not None and len(p) else np.zeros((0, 0))
            if a.ndim != 2 or min(a.shape) < 3:
                return None
            c = a[1:-1, 1:-1]
            return float((4 * c - a[:-2, 1:-1] - a[2:, 1:-1] - a[1:-1, :-2] - a[1:-1, 2:]).var())

        return pixels.map(one)

    ship(images.sparkSession)
    return images.withColumn("sharpness", sharp("pixels"))


def dhash_words(images: DataFrame) -> DataFrame:
    """Perceptual hash of grey images of 17 x 16 pixels: a bit for each right neighbour that is lighter, row by row, as four longs."""
    bits = F.flatten(F.transform("pixels", lambda row: F.zip_with(F.slice(row, 2, 16), F.slice(row, 1, 16), lambda r, q: (r > q).cast("int"))))
    word = lambda i: F.aggregate(F.slice(F.col("_bits"), 64 * i + 1, 64), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))
    return images.withColumn("_bits", bits).withColumns({f"h{i}": word(i) for i in range(4)}).drop("_bits")
