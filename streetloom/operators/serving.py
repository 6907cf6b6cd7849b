"""Rules around a detector: manifests, sheets, fallbacks, views to label, label packs, the choice of a checkpoint, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import area_pct
from ..schema import INPUT_PX, VIEWS
from .analytics import severity_with_area
from .dataset import deal_out, shuffled
from .evaluate import choose_threshold

SHEET_STATUS = ("", "usable", "difficult", "unusable")
#: Pixels of the largest face that is cut into tiles.
MAX_FACE_PX = 2048


def _named(rules: dict[str, Column]) -> Column:
    """The names of the rules that are not clearly met (a null breaks a rule)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def manifest_problems(manifests: DataFrame, rejected: DataFrame) -> DataFrame:
    """``manifests(sha256, version, trained, classes, format, input_size, confidence_threshold, tiling)`` and an array
    ``problems``; ``rejected(sha256)`` lists models that never serve. No threshold counts as 0.35, no tiling as untiled."""
    denied = rejected.select(F.col("sha256").alias("_sha")).distinct()
    t = F.col("tiling")
    tiled = (t["tile"] == INPUT_PX) & (t["face_size"] > INPUT_PX) & (t["face_size"] <= MAX_FACE_PX) & (t["stride"] > 0) & (t["stride"] <= t["tile"])
    rules = {
        "untrained": F.col("trained"),
        "classes": F.col("classes") == F.array(F.lit("litter")),
        "format": F.col("format") == "yolo26-end2end",
        "input size": F.col("input_size") == INPUT_PX,
        "version": F.col("version") != "",
        "hash": F.length("sha256") == 64,
        "rejected": F.col("_sha").isNull(),
        "threshold": F.coalesce("confidence_threshold", F.lit(0.35)).between(0.05, 0.95),
        "tiling": t.isNull() | tiled,
    }
    return manifests.join(denied, F.col("sha256") == F.col("_sha"), "left").withColumn("problems", _named(rules)).drop("_sha")


def sheet_problems(sheet: DataFrame) -> DataFrame:
    """``sheet(status, notes, annotation_complete)`` with its status in plain form, ``complete`` and ``problems``."""
    status, notes = F.lower(F.trim("status")), F.trim(F.coalesce("notes", F.lit("")))
    rules = {"status": status.isin(*SHEET_STATUS), "unusable needs a note": (status != "unusable") | (notes != "")}
    done = F.coalesce(F.lower(F.trim("annotation_complete")) == "yes", F.lit(False))
    return sheet.withColumns({"problems": _named(rules), "complete": done}).withColumn("status", status)


def first_answers(answers: DataFrame, by: str, priority: list[str], model: str = "model_used") -> DataFrame:
    """Of each ``by`` the rows of the first detector in ``priority`` that has any; others do not count."""
    rank = F.array_position(F.array(*[F.lit(m) for m in priority]), F.col(model))
    x = answers.withColumn("_rank", rank).where("_rank > 0")
    return x.withColumn("_first", F.min("_rank").over(W.partitionBy(by))).where("_rank = _first").drop("_rank", "_first")


def enriched(df: DataFrame) -> DataFrame:
    """Area from the box where no mask gave one, and the severity by confidence or area."""
    area = F.coalesce("waste_area_pct", F.round(area_pct(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 2))
    x = df.withColumn("waste_area_pct", area)
    return x.withColumn("severity", severity_with_area(F.coalesce("confidence", F.lit(0.0)), F.col("waste_area_pct")))


def views_to_label(panoramas: DataFrame) -> DataFrame:
    """A row for each of the six views of ``panoramas(id, captured_at, creator, sequence, width, height)``; a panorama
    that is not twice as wide as high is an error."""
    size = F.when(F.col("width") == 2 * F.col("height"), F.array("width", "height")).otherwise(F.raise_error(F.concat("id", F.lit(" is not a 2:1 panorama"))))
    x = panoramas.withColumn("view_id", F.explode(F.array(*[F.lit(v) for v in VIEWS])))
    return x.select(
        F.concat_ws("_", "id", F.concat("view_id", F.lit(".jpg"))).alias("file_name"), F.col("id").alias("image_id"), "view_id",
        F.to_date(F.timestamp_millis("captured_at")).alias("capture_date"), F.col("creator").alias("contributor"), "sequence",
        size.alias("panorama_size"), F.lit("unreviewed").alias("review_status"),
    )


def label_packs(views: DataFrame, members: list[str], calibration: int = 2, seed: int = 42) -> DataFrame:
    """(member, file_name, image_id, calibration): ``calibration`` panoramas go to all members, one of each contributor
    in order of names before any second one; the others are dealt out in order of sequence and id. Chance is an order by
    hash."""
    panoramas = views.groupBy("image_id").agg(F.min("contributor").alias("contributor"), F.min("sequence").alias("sequence")).withColumn("_hash", shuffled("image_id", seed))
    place = F.row_number().over(W.partitionBy("contributor").orderBy("_hash", "image_id"))
    panoramas = panoramas.withColumn("_later", place > 1)
    order = [F.col("_later"), F.when(~F.col("_later"), F.col("contributor")), F.col("_hash"), F.col("image_id")]
    shared = panoramas.orderBy(*order).limit(calibration).select("image_id").withColumn("calibration", F.lit(True))
    panoramas = panoramas.join(F.broadcast(shared), "image_id", "left").na.fill(False, ["calibration"])  # `calibration` rows
    names = F.array(*[F.lit(m) for m in members])
    dealt = deal_out(panoramas.where("not calibration"), [F.coalesce("sequence", F.lit("")), F.col("image_id")], len(members))
    dealt = dealt.select("image_id", "calibration", F.get(names, F.col("member")).alias("member"))
    shared = panoramas.where("calibration").select("image_id", "calibration", F.explode(names).alias("member"))
    return views.join(dealt.unionByName(shared), "image_id").select("member", "file_name", "image_id", "calibration")


def scored_checkpoints(proxy: DataFrame, local: DataFrame, least_regions: int = 20) -> DataFrame:
    """(checkpoint, source, threshold, precision, score_recall, small_recall) from threshold sweeps
    ``(checkpoint, threshold, true_positives, false_negatives, precision, recall, small_recall)``. The local sweep
    chooses the threshold if it has regions enough; with fewer it is read at the proxy's; without it the proxy counts."""
    by = ["checkpoint"]
    regions = local.groupBy(*by).agg(F.min_by(F.col("true_positives") + F.col("false_negatives"), "threshold").alias("regions"))
    own = choose_threshold(local, by=by).select(*by, F.col("threshold").alias("own"))
    x = choose_threshold(proxy, by=by).drop("reached").join(regions, by, "left").join(own, by, "left")
    enough = F.col("regions") >= least_regions
    x = x.select(
        *by, F.when(enough, F.col("own")).otherwise(F.col("threshold")).alias("threshold"),
        F.when(F.col("regions").isNull(), "proxy").when(enough, "validation").otherwise("validation at proxy threshold").alias("source"),
    )
    rows = proxy.withColumn("_local", F.lit(False)).unionByName(local.withColumn("_local", F.lit(True)), allowMissingColumns=True)
    x = x.withColumn("_local", F.col("source") != "proxy").join(rows, [*by, "threshold", "_local"])
    return x.select(*by, "source", "threshold", "precision", F.col("recall").alias("score_recall"), "small_recall")


def select_checkpoint(scored: DataFrame, baseline: str, least_gain: float = 0.05) -> DataFrame:
    """The candidate of the highest recall, by small objects among equals, its gain over the baseline, and whether to stop."""
    recall = F.coalesce("score_recall", F.lit(0.0))
    best = scored.where(F.col("checkpoint") != baseline).orderBy(recall.desc(), F.coalesce("small_recall", F.lit(0.0)).desc(), "checkpoint").limit(1)
    base = scored.where(F.col("checkpoint") == baseline).agg(F.coalesce(F.max(recall), F.lit(0.0)).alias("_base"))  # one row
    return best.crossJoin(base).withColumn("gain", recall - F.col("_base")).withColumn("stop", F.col("gain") < least_gain).drop("_base")


def target_met(precision: Column, recall: Column, least: float = 0.85) -> Column:
    """Both are there and reach the target."""
    return F.coalesce((precision >= least) & (recall >= least), F.lit(False))


def diagnosis_gate(checks: DataFrame, categories: DataFrame, expected: int) -> DataFrame:
    """Whether all of ``checks(passed)`` hold and ``categories(count)`` add up; one row."""
    passed = checks.agg(F.coalesce(F.every(F.coalesce("passed", F.lit(False))), F.lit(True)).alias("checks"))
    total = categories.agg((F.coalesce(F.sum("count"), F.lit(0)) == expected).alias("categorised"))
    return passed.crossJoin(total).withColumn("gate", F.col("checks") & F.col("categorised"))


def analysis_version(tiling: Column, base: str = "cube-100-v1") -> Column:
    """Results of tiled and untiled analyses are kept apart by their version."""
    tiled = F.concat(F.lit(base), F.lit("-tile"), tiling["face_size"].cast("string"), F.lit("-"), tiling["tile"].cast("string"), F.lit("s"), tiling["stride"].cast("string"))
    return F.when(tiling.isNull(), base).otherwise(tiled)


def cache_key(*fields: str) -> Column:
    """SHA-256 of the fields as a JSON object with its names in order."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)
