"""Rules around a detector, against hand-computed values."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from streetloom.operators import serving

MANIFEST = "sha256 string, version string, trained boolean, classes array<string>, format string, input_size int, confidence_threshold double, tiling struct<face_size:int,tile:int,stride:int>"
GOOD = ("a" * 64, "v1", True, ["litter"], "yolo26-end2end", 640, None, None)


def changed(**fields):
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    return tuple(fields.get(n, v) for n, v in zip(names, GOOD))


@pytest.mark.parametrize(
    "row, problem",
    [
        (GOOD, []), (changed(trained=None), ["untrained"]), (changed(classes=["litter", "bin"]), ["classes"]), (changed(version=None), ["version"]), (changed(sha256="a"), ["hash"]), (changed(sha256=None), ["hash"]),
        (changed(sha256="b" * 64), ["rejected"]), (changed(confidence_threshold=0.96), ["threshold"]), (changed(confidence_threshold=0.05), []), (changed(tiling=(1024, 640, 384)), []),
        (changed(tiling=(640, 640, 384)), ["tiling"]), (changed(tiling=(1024, 640, 0)), ["tiling"]), (changed(tiling=(1024, None, 384)), ["tiling"]), (changed(format="onnx", input_size=320), ["format", "input size"]),
    ],
)
def test_manifest(spark, row, problem):
    rejected = spark.createDataFrame([("b" * 64,), ("b" * 64,)], "sha256 string")
    got = serving.manifest_problems(spark.createDataFrame([row], MANIFEST), rejected).collect()
    assert [r["problems"] for r in got] == [problem]


def test_sheet(spark):
    rows = [(1, " Usable ", None, "YES"), (2, "unusable", " ", "no"), (3, "UNUSABLE", "dark", None), (4, "fine", "", ""), (5, "", None, " yes"), (6, None, None, None)]
    got = {r["id"]: (r["status"], r["complete"], r["problems"]) for r in serving.sheet_problems(spark.createDataFrame(rows, "id int, status string, notes string, annotation_complete string")).collect()}
    assert got == {
        1: ("usable", True, []), 2: ("unusable", False, ["unusable needs a note"]), 3: ("unusable", False, []),
        4: ("fine", False, ["status"]), 5: ("", True, []), 6: (None, False, ["status", "unusable needs a note"]),
    }


def test_fallback_takes_the_first_detector_that_found_anything(spark):
    rows = [("a", 1, "second"), ("a", 2, "first"), ("a", 3, "first"), ("b", 4, "second"), ("c", 5, "unknown")]
    got = serving.first_answers(spark.createDataFrame(rows, "image string, id int, model_used string"), "image", ["first", "second"])
    assert sorted(r["id"] for r in got.collect()) == [2, 3, 4]


def test_enriched(spark):
    rows = [(0.1, None, 0.0, 0.0, 0.5, 0.5), (None, 1.0, 0.0, 0.0, 1.0, 1.0), (0.6, None, 0.0, 0.0, 0.1, 0.1)]
    got = serving.enriched(spark.createDataFrame(rows, "confidence double, waste_area_pct double, x1 double, y1 double, x2 double, y2 double")).collect()
    assert [(r["waste_area_pct"], r["severity"]) for r in got] == [(25.0, "high"), (1.0, "low"), (1.0, "medium")]


def test_views_to_label(spark):
    schema = "id string, captured_at long, creator string, sequence string, width int, height int"
    got = serving.views_to_label(spark.createDataFrame([("7", 86_400_000, "ann", None, 2048, 1024)], schema)).collect()
    assert sorted(r["file_name"] for r in got) == [f"7_{v}.jpg" for v in ("back", "down", "front", "left", "right", "up")]
    assert {str(r["capture_date"]) for r in got} == {"1970-01-02"}
    with pytest.raises(Exception, match="not a 2:1"):
        serving.views_to_label(spark.createDataFrame([("7", 0, "ann", None, 2048, 1000)], schema)).collect()


def test_label_packs(spark):
    rows = [(f"{p}_{v}", p, "xyz"[i % 3], f"s{i % 4}") for i, p in enumerate(f"p{k:02d}" for k in range(14)) for v in ("front", "back")]
    got = serving.label_packs(spark.createDataFrame(rows, "file_name string, image_id string, contributor string, sequence string"), ["ann", "bo"]).collect()
    shared = {r["image_id"] for r in got if r["calibration"]}
    contributor = {r[1]: r[2] for r in rows}
    assert sorted(contributor[p] for p in shared) == ["x", "y"]
    for p in {r[1] for r in rows}:
        members = sorted(r["member"] for r in got if r["image_id"] == p)
        assert members == (["ann", "ann", "bo", "bo"] if p in shared else [members[0]] * 2)
    rest = sorted((r[3], r[1]) for r in rows if r[1] not in shared and r[0].endswith("front"))
    want = {p: ("ann", "bo")[i % 2] for i, (_, p) in enumerate(rest)}
    assert {r["image_id"]: r["member"] for r in got if not r["calibration"]} == want


SWEEP = "checkpoint string, threshold double, true_positives long, false_negatives long, precision double, recall double, small_recall double"


def test_checkpoint_choice(spark):
    proxy = [(c, t, 50, 50, p, r, 0.1) for c, x in (("base", 0.0), ("one", 0.1), ("two", 0.1)) for t, p, r in ((0.2, 0.5, 0.6 + x), (0.5, 0.9, 0.4 + x))]
    local = [("one", 0.2, 15, 5, 0.86, 0.75, 0.2), ("one", 0.5, 10, 10, 0.95, 0.5, 0.2), ("two", 0.2, 3, 1, 0.9, 0.75, 0.3), ("two", 0.5, 2, 2, 1.0, 0.5, 0.3)]
    scored = serving.scored_checkpoints(spark.createDataFrame(proxy, SWEEP), spark.createDataFrame(local, SWEEP))
    got = {r["checkpoint"]: (r["source"], r["threshold"], r["score_recall"]) for r in scored.collect()}
    assert got == {"base": ("proxy", 0.5, 0.4), "one": ("validation", 0.2, 0.75), "two": ("validation at proxy threshold", 0.5, 0.5)}
    best = serving.select_checkpoint(scored, "base").collect()
    assert [(r["checkpoint"], round(r["gain"], 9), r["stop"]) for r in best] == [("one", 0.35, False)]


def test_gates(spark):
    met = lambda p, r: spark.range(1).select(serving.target_met(F.lit(p).cast("double"), F.lit(r).cast("double")).alias("x")).first()["x"]
    assert [met(0.85, 0.9), met(0.84, 0.9), met(None, 0.9)] == [True, False, False]
    checks = lambda *x: spark.createDataFrame([(v,) for v in x], "passed boolean")
    counts = spark.createDataFrame([(50,), (4,)], "count int")
    assert [serving.diagnosis_gate(c, counts, n).first()["gate"] for c, n in ((checks(True, True), 54), (checks(True, None), 54), (checks(True), 53))] == [True, False, False]


def test_analysis_key(spark):
    x = spark.createDataFrame([("i", None), ("j", (1024, 640, 384))], "image_id string, tiling struct<face_size:int,tile:int,stride:int>").withColumn("version", serving.analysis_version(F.col("tiling")))
    got = x.orderBy("image_id").select("version", serving.cache_key("version", "image_id").alias("key")).collect()
    assert [r["version"] for r in got] == ["cube-100-v1", "cube-100-v1-tile1024-640s384"]
    assert got[0]["key"] == hashlib.sha256(json.dumps({"image_id": "i", "version": "cube-100-v1"}, separators=(",", ":")).encode()).hexdigest()
