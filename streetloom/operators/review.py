"""Reviews of views: rules, the latest revision, export, merging packs of several reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import latest

STATUSES = ("litter", "clean", "skip", "unreviewed")


def violations(df: DataFrame, max_boxes: int = 500) -> DataFrame:
    """``df(status, boxes, notes)`` and an array of the rules that each row breaks."""
    n = F.coalesce(F.size("boxes"), F.lit(0))
    fits = F.forall("boxes", lambda b: (F.size(b) == 4) & (b[0] >= 0) & (b[1] >= 0) & (b[2] <= 1) & (b[3] <= 1) & (b[0] < b[2]) & (b[1] < b[3]))
    rules = [
        F.when(~F.col("status").isin(*STATUSES), "status"),
        F.when((F.col("status") == "litter") != (n > 0), "boxes do not fit the status"),
        F.when((F.col("status") == "skip") & (F.trim(F.coalesce("notes", F.lit(""))) == ""), "skip needs notes"),
        F.when(~F.coalesce(fits, F.lit(True)), "box"),
        F.when(n > max_boxes, "too many boxes"),
    ]
    return df.withColumn("violations", F.array_compact(F.array(*rules)))


def current(log: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """The last revision of each view; with ``hashes(view, sha)``, one whose image has changed is unreviewed again."""
    x = latest(log, ["view"], [F.desc("revision")])
    if hashes is None:
        return x
    x = x.join(hashes.withColumnRenamed("sha", "_now"), "view", "left")
    stale = ~F.col("sha256").eqNullSafe(F.col("_now"))
    return x.withColumn("status", F.when(stale, "unreviewed").otherwise(F.col("status"))).withColumn("boxes", F.when(stale, F.array().cast(x.schema["boxes"].dataType)).otherwise(F.col("boxes"))).drop("_now")


def exportable(reviews: DataFrame, views: DataFrame) -> DataFrame:
    """Reviewed views (litter or clean) that have an original and a sequence, with one label line for each box."""
    x = reviews.where(F.col("status").isin("litter", "clean")).join(views.where("sequence is not null and original"), "view")
    line = lambda b: F.format_string("0 %.8f %.8f %.8f %.8f", (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1])
    return x.withColumn("labels", F.array_join(F.transform("boxes", line), "\n"))


def merge_packs(pack: DataFrame, target: DataFrame, known: DataFrame) -> DataFrame:
    """What becomes of each row of a returned pack, first rule wins: rejected (hash unknown or changed), skipped
    (unreviewed), calibration, rejected (view of another member), unchanged, conflict, merged.

    ``pack(view, member, status, boxes, sha)``, ``target(view, status, boxes)``, ``known(view, sha, assigned, calibration)``.
    """
    k = known.select("view", F.col("sha").alias("_sha"), "assigned", "calibration")
    t = target.select("view", F.col("status").alias("_status"), F.col("boxes").alias("_boxes"))
    x = pack.join(k, "view", "left").join(t, "view", "left")
    same = F.col("status").eqNullSafe(F.col("_status")) & F.col("boxes").eqNullSafe(F.col("_boxes"))
    result = (
        F.when(F.col("_sha").isNull() | ~F.col("sha").eqNullSafe(F.col("_sha")), "rejected")
        .when(F.col("status") == "unreviewed", "skipped")
        .when(F.col("calibration"), "calibration")
        .when(~F.col("assigned").eqNullSafe(F.col("member")), "rejected")
        .when(F.col("_status").isNotNull(), F.when(same, "unchanged").otherwise("conflict"))
        .otherwise("merged")
    )
    return x.select("view", "member", "status", "boxes", result.alias("result"))


def merge_sheets(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Cells of two sheets: empty ones are filled from the new sheet, differing ones are listed in ``conflicts`` and kept."""
    columns = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    x = old.join(n, key, "full_outer")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    filled = [F.when(blank(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    clash = F.array_compact(F.array(*[F.when(~blank(c) & ~blank(f"_{c}") & (F.col(c) != F.col(f"_{c}")), c) for c in columns]))
    touched = F.lit(False)
    for c in columns:
        touched = touched | (blank(c) & ~blank(f"_{c}"))
    return x.select(key, *filled, clash.alias("conflicts"), touched.alias("filled"))


def progress(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_if(F.col("status").isin("litter", "clean")).alias("reviewed"), F.count_if(F.col("status") == "skip").alias("skipped"), F.count("*").alias("total"))


def next_unreviewed(views: DataFrame, position: int) -> DataFrame:
    """The next view without a review, going round from ``position``; ``views(position, view, status)``."""
    n = views.agg(F.count("*").alias("_n"))
    x = views.crossJoin(n).where("status = 'unreviewed'")  # one row
    return x.orderBy(F.pmod(F.col("position") - position - 1, F.col("_n"))).limit(1).drop("_n")
