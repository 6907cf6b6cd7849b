"""Operators against hand-computed values and loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from streetloom.functions import boxes as B
from streetloom.functions import geo, sphere
from streetloom.functions.stats import wilson
from streetloom.operators import analytics, dataset, derive, detect, diagnose, evaluate, graph, hotspots, review, spatial, store
from streetloom.sources import files

CORNERS = ["x1", "y1", "x2", "y2"]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def hav(a, b, c, d):
    p, q = math.sin(math.radians(c - a) / 2), math.sin(math.radians(d - b) / 2)
    return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, p * p + math.cos(math.radians(a)) * math.cos(math.radians(c)) * q * q)))


def iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0.0


# grid and store


def test_grid_shape_and_edges(spark):
    g = store.grid(spark).orderBy("ordinal").collect()
    assert len(g) == 67 * 78 and g[0]["id"] == "grid-1" and g[-1]["id"] == "grid-5226"
    at = 18.40
    for _ in range(66):
        at += 0.0045
    assert g[-1]["lat_min"] == at and g[-1]["lat_max"] == 18.70 and g[-1]["lng_max"] == 74.05
    assert store.grid(spark, 0).orderBy("ordinal").first()["id"] == "grid-0"


def test_points_on_edges_and_outside(spark):
    pts = [("a", 18.40, 73.70), ("b", 18.70, 74.05), ("c", 18.4045, 73.7045), ("d", 18.3999, 73.8), ("e", 18.5, 75.0)]
    df = spark.createDataFrame(pts, "id string, lat double, lng double")
    got = {r["id"]: r["cell"] for r in store.attribute(df).collect()}
    assert got == {"a": "grid-1", "b": "grid-5226", "c": "grid-1", "d": None, "e": None}
    assert {r["id"]: r["cell"] for r in store.lookup(df).collect()}["a"] == "grid-0"


def test_recomputed_counts_do_not_count_a_replaced_row_twice(spark):
    log = spark.createDataFrame([("x", 1, 18.5, 73.8, 10), ("x", 2, 18.5, 73.8, 20)], "id string, v int, lat double, lng double, detected_at long")
    cells = store.grid(spark)
    n = store.cell_counts(cells, store.attribute(store.latest(log, ["id"], [F.desc("v")]))).where("scanned").collect()
    assert [(r["detection_count"], r["last_scanned"]) for r in n] == [(1, 20)]


def test_jobs_and_first_seen_and_mark(spark):
    log = spark.createDataFrame([("j", 1, "running", None), ("j", 2, None, 5), ("j", 3, "done", None)], "id string, at int, status string, processed int")
    assert tuple(store.jobs_view(log).first()) == ("j", "done", 5)
    old = spark.createDataFrame([("h1", 1.0, 5, 6), ("h9", 2.0, 7, 8)], "id string, score double, first_seen long, last_seen long")
    new = spark.createDataFrame([("h1", 3.0), ("h2", 4.0)], "id string, score double")
    assert sorted(tuple(r) for r in store.keep_first_seen(old, new, 100).collect()) == [("h1", 3.0, 5, 100), ("h2", 4.0, 100, 100), ("h9", 2.0, 7, 8)]
    cells = spark.createDataFrame([("g", False, None), ("k", True, 3)], "id string, scanned boolean, last_scanned long")
    ids = spark.createDataFrame([("g",), ("g",)], "id string")
    assert sorted(tuple(r) for r in store.mark_scanned(cells, ids, 9).collect()) == [("g", True, 9), ("k", True, 3)]


# dashboard


def test_severity_rules(spark):
    df = spark.createDataFrame([(0.7, None), (0.69, None), (0.5, 0.0), (0.1, 5.1), (0.1, 2.1), (0.1, 2.0)], "c double, a double")
    assert [r[0] for r in df.select(analytics.severity(F.col("c"))).collect()] == ["high", "medium", "medium", "low", "low", "low"]
    assert [r[0] for r in df.select(analytics.severity_with_area(F.col("c"), F.col("a"))).collect()] == ["high", "medium", "medium", "high", "medium", "low"]
    s = df.withColumn("severity", analytics.severity(F.col("c")))
    assert analytics.with_severity(s, "high").count() == 1 and analytics.with_severity(s, "nonsense").count() == 6


def test_coverage_of_nothing_is_zero(spark):
    none = store.grid(spark).limit(0).withColumn("scanned", F.lit(True))
    assert analytics.coverage(none).first()["coverage_pct"] == 0


# boxes and sphere


def test_iou_and_cover(spark):
    a = [F.lit(float(x)) for x in (0, 0, 2, 2)]
    b = [F.lit(float(x)) for x in (1, 0, 3, 2)]
    z = [F.lit(0.0)] * 4
    assert tuple(one(spark, B.iou(a, b), B.cover(a, b), B.iou(z, z), B.cover(a, z))) == (pytest.approx(1 / 3), 0.5, 0.0, 0.0)


def test_size_buckets(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 7.99, 8, 16, 31.9, 32, 500)], "s double")
    assert [r[0] for r in df.select(B.size_bucket(F.col("s"))).collect()] == ["<8", "<8", "8-16", "16-32", "16-32", ">=32", ">=32"]


def test_tile_origins(spark):
    df = spark.createDataFrame([(1024,), (1400,), (500,), (640,)], "e int")
    assert [r[0] for r in df.select(sphere.tile_origins(F.col("e"), 640, 384)).collect()] == [[0, 384], [0, 384, 760], [0], [0]]


def test_window_classes(spark):
    rows = [(0.0, 0.0, 10.0, 10.0), (95.0, 0.0, 105.0, 10.0), (93.0, 50.0, 103.0, 52.0), (200.0, 0.0, 210.0, 10.0)]
    df = spark.createDataFrame([(i, *r, 0.0, 0.0, 100.0, 100.0) for i, r in enumerate(rows)], "i int, x1 double, y1 double, x2 double, y2 double, x0 double, y0 double, ww double, wh double")
    assert {r["i"]: r["kind"] for r in derive.window_labels(df).collect()} == {0: "kept", 1: "grey", 2: "dropped"}


def test_rays_views_and_cameras(spark):
    v = sphere.views(spark)
    axes = {k: F.col(k) for k in ("origin", "right", "down")}
    got = {r["view_id"]: r["t"] for r in v.select("view_id", sphere.point_to_basic(axes, F.lit(0.5), F.lit(0.5)).alias("t")).collect()}
    assert got["front"] == pytest.approx([0.5, 0.5]) and got["right"] == pytest.approx([0.75, 0.5]) and got["left"] == pytest.approx([0.25, 0.5]) and got["up"][1] == pytest.approx(0.0)
    assert v.where(~sphere.camera_ok(F.col("origin"), F.col("right"), F.col("down"), F.col("aspect"))).count() == 0
    assert one(spark, sphere.camera_ok(F.array(*[F.lit(x) for x in (0.0, 0.0, 2.0)]), F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0)]), F.array(*[F.lit(x) for x in (0.0, -1.0, 0.0)]), F.lit(1.0)))[0] is False
    for lat in range(-90, 91, 30):
        for lng in range(-180, 181, 45):
            r = sphere.rotate(lat, lng)
            u, w = sphere.ray_to_uv(F.array(*[F.lit(x) for x in r]))
            back = one(spark, sphere.uv_to_ray(u, w))[0] if (lat, lng) in ((30, 45), (-60, 90)) else r
            assert back == pytest.approx(r, abs=1e-9)


def test_box_formats(spark):
    s = "struct<x:double,y:double,width:double,height:double,x1:double,y1:double,x2:double,y2:double,bbox:array<double>>"
    rows = [((50.0, 50.0, 20.0, 10.0, None, None, None, None, None),), ((None,) * 4 + (-10.0, 0.0, 50.0, 200.0, None),), ((None,) * 8 + ([0.1, -0.2, 0.3, 1.4],),), ((None,) * 8 + ([0.1],),)]
    df = spark.createDataFrame(rows, f"p {s}")
    assert [r[0] for r in df.select(B.normalised(F.col("p"), F.lit(100.0), F.lit(100.0))).collect()] == [pytest.approx([0.4, 0.45, 0.6, 0.55]), [0.0, 0.0, 0.5, 1.0], [0.1, 0.0, 0.3, 1.0], None]


# suppression


def random_boxes(rnd, n, groups, views=("v",), size=0.3):
    out = []
    for i in range(n):
        x, y = rnd.random() * 0.6, rnd.random() * 0.6
        out.append((f"g{rnd.randrange(groups)}", f"{i:04d}", rnd.choice(views), rnd.randint(1, 9) / 10, rnd.random() < 0.4, x, y, x + 0.05 + rnd.random() * size, y + 0.05 + rnd.random() * size))
    return out


BOXES = "image_id string, id string, view_id string, confidence double, cut boolean, x1 double, y1 double, x2 double, y2 double"


def test_tile_nms_equals_a_loop(spark):
    rows = random_boxes(random.Random(1), 150, 6)
    got = {r["id"] for r in detect.tile_nms(spark.createDataFrame(rows, BOXES), ["image_id"]).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[4], -r[3], r[1])):
            def over(k, r=r):
                i = max(0, min(r[7], k[7]) - max(r[5], k[5])) * max(0, min(r[8], k[8]) - max(r[6], k[6]))
                a, b = (r[7] - r[5]) * (r[8] - r[6]), (k[7] - k[5]) * (k[8] - k[6])
                return i / (a + b - i) >= 0.5 or i / min(a, b) >= 0.8
            if not any(over(k) for k in kept):
                kept.append(r)
        want |= {r[1] for r in kept}
    assert got == want and len(want) < len(rows)


def test_an_uncut_box_beats_a_more_confident_fragment(spark):
    rows = [("g", "a", "v", 0.9, True, 0.0, 0.0, 0.1, 0.1), ("g", "b", "v", 0.6, False, 0.0, 0.0, 0.2, 0.1)]
    assert [r["id"] for r in detect.tile_nms(spark.createDataFrame(rows, BOXES), ["image_id"]).collect()] == ["b"]


def reproject(box, s, t):
    e = math.tan(math.radians(50))
    (o, r, d), (p, q, w) = (tuple(tuple(float(x) for x in v) for v in sphere.AXES[n]) for n in (s, t))
    r, d, q, w = (tuple(x * e for x in v) for v in (r, d, q, w))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    xs, ys = [], []
    for wx, wy in sphere.PERIMETER:
        x, y = box[0] + (box[2] - box[0]) * wx, box[1] + (box[3] - box[1]) * wy
        k = tuple(o[i] + (2 * x - 1) * r[i] + (2 * y - 1) * d[i] for i in range(3))
        depth = dot(k, p)
        if depth <= 0.01:
            return None
        pl = tuple(k[i] / depth - p[i] for i in range(3))
        xs.append((dot(pl, q) / dot(q, q) + 1) / 2)
        ys.append((dot(pl, w) / dot(w, w) + 1) / 2)
    return max(0, min(xs)), max(0, min(ys)), min(1, max(xs)), min(1, max(ys))


def test_cross_view_nms_equals_a_loop(spark):
    rows = random_boxes(random.Random(2), 160, 5, ("front", "right", "left", "up"), 0.5)
    edge = [("e", "a", "front", 0.9, False, 0.9, 0.4, 1.0, 0.6)]
    seen = reproject(edge[0][5:], "front", "right")
    rows += edge + [("e", "b", "right", 0.8, False, *seen), ("e", "c", "front", 0.7, False, 0.9, 0.4, 1.0, 0.6)]
    got = {r["id"] for r in detect.cross_view_nms(spark.createDataFrame(rows, BOXES)).where("image_id = 'e'").collect()}
    assert got == {"a", "c"}
    got = {(r["image_id"], r["id"]) for r in detect.cross_view_nms(spark.createDataFrame(rows, BOXES)).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1])):
            hits = [s for k in kept if k[2] != r[2] and (s := reproject(k[5:], k[2], r[2])) is not None]
            if not any(iou(s, r[5:]) >= 0.45 if s[2] > s[0] and s[3] > s[1] else False for s in hits):
                kept.append(r)
        want |= {(g, r[1]) for r in kept}
    assert got == want


def test_cross_view_nms_stands_a_large_panorama(spark):
    rows = random_boxes(random.Random(4), 9990, 1, ("front", "right", "left", "up"), 0.1)
    rows += [("g0", "x", "front", 0.95, False, 0.9, 0.4, 1.0, 0.6), ("g0", "y", "right", 0.05, False, *reproject((0.9, 0.4, 1.0, 0.6), "front", "right"))]
    out = {r["id"] for r in detect.cross_view_nms(spark.createDataFrame(rows, BOXES)).collect()}
    assert "x" in out and "y" not in out and len(out) > 1000


@pytest.mark.parametrize("pairs", [60, 500_000])
def test_suppression_of_many_copies_equals_a_loop(spark, monkeypatch, pairs):
    """Copies of a box are held against the others once; groups come many at a time."""
    monkeypatch.setattr(detect, "PAIRS", pairs)
    rnd = random.Random(27)
    some = random_boxes(rnd, 40, 1, ("front", "right", "left", "up"), 0.5)
    edge = (0.9, 0.4, 1.0, 0.6)
    some += [("g", "e", "front", 0.9, False, *edge), ("g", "s", "right", 0.8, False, *reproject(edge, "front", "right")), ("g", "z", "up", 0.5, False, 0.3, 0.3, 0.3, 0.5)]
    rows = [(f"g{rnd.randrange(7)}", f"{i:04d}", b[2], rnd.randint(1, 9) / 10, rnd.random() < 0.4, *b[5:]) for i, b in enumerate(rnd.choice(some) for _ in range(900))]
    df = spark.createDataFrame(rows, BOXES)
    met = []
    boxes = detect.np.array([r[5:] for r in rows])
    one = detect.np.array([0])
    detect._first_come(boxes, detect.np.zeros(len(rows), int), one, lambda x, k: x, lambda x, k, i, j: met.append(len(i)) or detect.np.zeros(len(i), bool))
    assert sum(met) <= 43 * 43
    seen = {(b[5:], s, t): reproject(b[5:], s, t) for b in some for s in ("front", "right", "left", "up") for t in ("front", "right", "left", "up") if s != t}
    for name, order, hits in (
        ("cross", lambda r: (-r[3], r[1]), lambda k, r: k[2] != r[2] and (s := seen[k[5:], k[2], r[2]]) is not None and s[2] > s[0] and s[3] > s[1] and iou(s, r[5:]) >= 0.45),
        ("tile", lambda r: (r[4], -r[3], r[1]), lambda k, r: tiled(k, r)),
    ):
        want = set()
        for g in {r[0] for r in rows}:
            kept = []
            for r in sorted((r for r in rows if r[0] == g), key=order):
                if not any(hits(k, r) for k in kept):
                    kept.append(r)
            want |= {r[1] for r in kept}
        got = detect.cross_view_nms(df) if name == "cross" else detect.tile_nms(df, ["image_id"])
        got = [r["id"] for r in got.collect()]
        assert set(got) == want and len(got) == len(want) < len(rows), name


def tiled(k, r):
    i = max(0, min(r[7], k[7]) - max(r[5], k[5])) * max(0, min(r[8], k[8]) - max(r[6], k[6]))
    a, b = (r[7] - r[5]) * (r[8] - r[6]), (k[7] - k[5]) * (k[8] - k[6])
    return a > 0 and b > 0 and (i / (a + b - i) >= 0.5 or i / min(a, b) >= 0.8)


# matching and evaluation


def match_loop(preds, truths, least=0.5):
    used, out = set(), []
    for p in sorted(preds, key=lambda p: (-p[2], p[1])):
        free = [(iou(p[3:], t[2:]), -t[1]) for t in truths if t[1] not in used]
        if free and max(free)[0] >= least:
            used.add(-max(free)[1])
            out.append((p[0], p[1], -max(free)[1]))
    return out


def match_data(seed):
    rnd = random.Random(seed)
    preds, truths = [], []
    for img in ("a", "b", "c"):
        for i in range(12):
            x, y = rnd.random() * 0.4, rnd.random() * 0.4
            truths.append((img, i, x, y, x + 0.3, y + 0.3))
        for i in range(14):
            x, y = rnd.random() * 0.4, rnd.random() * 0.4
            preds.append((img, i, rnd.randint(1, 9) / 10, x, y, x + 0.3, y + 0.3))
    return preds, truths


P = "image string, idx long, confidence double, x1 double, y1 double, x2 double, y2 double"
T = "image string, idx long, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("seed", range(3))
def test_match_sweep_and_parity_equal_loops(spark, seed):
    preds, truths = match_data(seed)
    p, t = spark.createDataFrame(preds, P), spark.createDataFrame(truths, T)
    m = evaluate.match(p, t)
    got = sorted((r["image"], r["prediction"], r["truth"]) for r in m.collect())
    by = lambda rows, img: [r for r in rows if r[0] == img]
    assert got == sorted(x for img in "abc" for x in match_loop(by(preds, img), by(truths, img)))
    for r in evaluate.sweep(p, t, [0.2, 0.5, 0.8]).collect():
        some = [x for x in preds if x[2] >= r["threshold"]]
        tp = sum(len(match_loop(by(some, img), by(truths, img))) for img in "abc")
        assert (r["tp"], r["fp"], r["fn"]) == (tp, len(some) - tp, len(truths) - tp)
    q = [(*x[:2], 0.5, *x[2:]) for x in truths]
    by_overlap = evaluate.match_by_overlap(p, spark.createDataFrame(q, P), 0.3)
    want = []
    for img in "abc":
        left, right = set(), set()
        for v, i, j in sorted(((iou(a[3:], b[3:]), a[1], b[1]) for a in by(preds, img) for b in by(q, img)), reverse=True):
            if v >= 0.3 and i not in left and j not in right:
                left.add(i)
                right.add(j)
                want.append((img, i, j))
    assert sorted((r["image"], r["prediction"], r["truth"]) for r in by_overlap.collect()) == sorted(want)


def test_parity_allows_one_pixel_and_counts_unpaired(spark):
    left = spark.createDataFrame([("a", 1, 0.9, 0.1, 0.1, 0.11, 0.11), ("b", 1, 0.9, 0.1, 0.1, 0.2, 0.2)], P)
    d = 1 / 640
    right = spark.createDataFrame([("a", 1, 0.8, 0.1 + d / 2, 0.1, 0.11 + d / 2, 0.11)], P)
    got = {r["image"]: (r["passed"], r["unpaired"]) for r in evaluate.parity(left, right).collect()}
    assert got == {"a": (True, 0), "b": (False, 1)}


def test_undefined_measures_are_null(spark):
    recs = spark.createDataFrame([("a", 0, 0, 3, 3)], "image string, tp long, fp long, fn long, truths long")
    s = evaluate.summary(recs).first()
    assert s["precision"] is None and s["recall"] == 0 and s["clean_images"] == 0
    t = spark.createDataFrame([("a", 1, "8-16"), ("a", 2, "8-16")], "image string, idx long, size_bucket string")
    m = spark.createDataFrame([("a", 1)], "image string, truth long")
    assert [(r["labels"], r["found"], r["recall"]) for r in evaluate.recall_by_size(t, m).orderBy("bucket_order").collect()] == [(0, 0, None), (2, 1, 0.5), (0, 0, None), (0, 0, None)]


def test_wilson(spark):
    low, high = wilson(F.lit(46), F.lit(54))
    r = one(spark, low, high, *wilson(F.lit(0), F.lit(0)))
    assert r[0] == pytest.approx(0.73, abs=0.01) and r[1] == pytest.approx(0.92, abs=0.01) and r[2] is None and r[3] is None


def test_bootstrap_contains_the_estimate_and_repeats(spark):
    recs = spark.createDataFrame([(f"g{i % 12}_x", i % 3, 1, i % 2, 5) for i in range(60)], "image string, tp long, fp long, fn long, truths long")
    key = F.split("image", "_")[0]
    a, b = (evaluate.bootstrap(recs, key, 400, 0).orderBy("metric").collect() for _ in range(2))
    assert a == b and a[0]["low"] < 60 / 120 < a[0]["high"] and a[0]["rounds"] == 400
    assert evaluate.bootstrap(recs.limit(0), key).count() == 0


def test_choose_threshold(spark):
    c = lambda rows: spark.createDataFrame(rows, "threshold double, precision double, recall double")
    assert tuple(evaluate.choose_threshold(c([(0.2, 0.5, 0.9), (0.4, 0.86, 0.6), (0.6, 0.9, 0.5)])).first()) == (0.4, True)
    assert tuple(evaluate.choose_threshold(c([(0.2, 0.5, 0.5), (0.4, 0.5, 0.5), (0.6, None, 0.0)])).first()) == (0.2, False)


def test_near_miss_categories(spark):
    t = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.2, 0.2), ("a", 1, 0.5, 0.5, 0.7, 0.7), ("a", 2, 0.8, 0.0, 0.9, 0.1), ("a", 3, 0.0, 0.8, 0.1, 0.9), ("a", 4, 0.1, 0.8, 0.2, 0.9)], T)
    p = spark.createDataFrame([("a", 0, 0.9, 0.0, 0.0, 0.2, 0.2), ("a", 1, 0.9, 0.6, 0.5, 0.8, 0.7), ("a", 3, 0.9, 0.0, 0.8, 0.2, 0.9)], P)
    m = spark.createDataFrame([("a", 0)], "image string, truth long")
    got = {r["truth"]: r["category"] for r in evaluate.near_misses(p, t, m).collect()}
    assert got == {0: "matched", 1: "near-miss localisation", 2: "no prediction nearby", 3: "cluster mismatch", 4: "cluster mismatch"}


def test_agreement_of_reviewers(spark):
    rows = [("v", "a", 1, 0.0, 0.0, 0.2, 0.2), ("v", "b", 1, 0.0, 0.0, 0.2, 0.2), ("v", "b", 2, 0.5, 0.5, 0.6, 0.6), ("w", "a", None, None, None, None, None), ("w", "b", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "view string, reviewer string, idx long, x1 double, y1 double, x2 double, y2 double")
    assert {r["view"]: r["f1"] for r in evaluate.agreement(df).collect()} == {"v": pytest.approx(2 / 3), "w": None}


def test_agreement_goes_through_views_and_equals_a_loop(spark):
    rnd = random.Random(28)
    rows = []
    for v in "uvw":
        for who in "abc":
            for i in range(rnd.randrange(2, 9)):
                x, y = rnd.random() * 0.2, rnd.random() * 0.2
                rows.append((v, who, i, x, y, x + 0.4, y + 0.4))
    rows.append(("w", "d", None, None, None, None, None))
    x = evaluate.agreement(spark.createDataFrame(rows, "view string, reviewer string, idx long, x1 double, y1 double, x2 double, y2 double"))
    assert "Join" not in x._jdf.queryExecution().analyzed().toString()
    want = {}
    for v in "uvw":
        for a, b in [(p, q) for p in "abcd" for q in "abcd" if p < q and (v == "w" or q != "d")]:
            left, right = ([r for r in rows if r[:2] == (v, k) and r[2] is not None] for k in (a, b))
            pairs = sorted(((iou(p[3:], q[3:]), p[2], q[2]) for p in left for q in right if iou(p[3:], q[3:]) >= 0.5), reverse=True)
            used, n = set(), 0
            for _, p, q in pairs:
                if not {("p", p), ("q", q)} & used:
                    used, n = used | {("p", p), ("q", q)}, n + 1
            want[v, a, b] = pytest.approx(2 * n / (len(left) + len(right)))
    assert {(r["view"], r["a"], r["b"]): r["f1"] for r in x.collect()} == want


# graphs, places, hotspots


def test_components_of_chains_and_random_links(spark):
    rnd = random.Random(3)
    n = 120
    links = [(i, i + 1) for i in range(40)] + [(rnd.randrange(50, n), rnd.randrange(50, n)) for _ in range(40)] + [(7, 7)]
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.range(n).select(F.col("id").alias("node")), spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in range(n)}


def test_leader_clustering_equals_a_loop(spark):
    rnd = random.Random(4)
    d = [(f"d{i:03d}", 18.5 + rnd.random() * 0.006, 73.8 + rnd.random() * 0.006, rnd.randrange(40)) for i in range(150)]
    left, want = sorted(d, key=lambda r: (-r[3], r[0])), {}
    while left:
        seed = left[0]
        mine = [r for r in left if hav(seed[1], seed[2], r[1], r[2]) <= 100]
        want |= {r[0]: seed[0] for r in mine}
        left = [r for r in left if r not in mine]
    df = spark.createDataFrame(d, "id string, lat double, lng double, detected_at long")
    assert {r["id"]: r["leader"] for r in hotspots.cluster(df, newest=None).collect()} == want


def test_score_of_detections_without_area_never_passes_point_seven(spark):
    args = [F.lit(50), F.lit(1.0), F.lit(1706659200), F.lit(9)]
    s = one(spark, hotspots.score(F.lit(None).cast("double"), *args, 1706659200), hotspots.score(F.lit(25.0), *args, 1706659200), hotspots.score(F.lit(0.0), F.lit(1), F.lit(0.0), F.lit(0), F.lit(0), 5))
    assert s[0] == pytest.approx(0.7) and s[1] == pytest.approx(1.0) and s[2] == pytest.approx(0.0125)
    assert one(spark, hotspots.priority(F.lit(0.7)), hotspots.priority(F.lit(0.41)), hotspots.priority(F.lit(0.4)))[:] == ("medium", "medium", "low")


def test_radius_join_and_nearest_equal_loops(spark):
    rnd = random.Random(5)
    a = [(i, 18.4 + rnd.random() * 0.3, 73.7 + rnd.random() * 0.35) for i in range(60)]
    b = [(i, 18.4 + rnd.random() * 0.3, 73.7 + rnd.random() * 0.35) for i in range(80)]
    x, y = spark.createDataFrame(a, "a long, lat double, lng double"), spark.createDataFrame(b, "b long, lat double, lng double")
    got = {(r["a"], r["b"]) for r in spatial.radius_join(x, y, 4000).collect()}
    assert got == {(i[0], j[0]) for i in a for j in b if hav(*i[1:], *j[1:]) <= 4000}
    want = {i[0]: round(min(hav(*i[1:], *j[1:]) for j in b)) for i in a}
    for reach in (50.0, 2000.0, 1e5):  # however many rings are searched
        assert {r["a"]: r["nearest_m"] for r in spatial.nearest_distance(x, y, F.col("a"), reach).collect()} == want
    assert {r["nearest_m"] for r in spatial.nearest_distance(x, y.limit(0), F.col("a")).collect()} == {None}


def test_pairs_within_equal_a_loop_at_crowded_places(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MEMBERS", 7)  # several lists for a place
    rnd = random.Random(25)
    spots = [(18.5 + rnd.random() * 0.002, 73.8 + rnd.random() * 0.002) for _ in range(9)]
    rows = [(f"r{i}", i, *(spots[0] if i % 2 else rnd.choice(spots))) for i in range(80)] + [("none", 99, None, 73.8)]
    got = [(r["a"], r["b"], round(r["distance_m"], 6)) for r in spatial.pairs_within(spark.createDataFrame(rows, "id string, rank long, lat double, lng double"), 100).collect()]
    want = {(a[0], b[0], round(hav(*a[2:], *b[2:]), 6)) for a in rows[:80] for b in rows[:80] if a[1] < b[1] and hav(*a[2:], *b[2:]) <= 100}
    assert set(got) == want and len(got) == len(want)


def test_pairs_within_holds_the_pairs_of_one_row_only(spark):
    rows = [(f"r{i}", i, 18.5, 73.8) for i in range(40)]
    x = spatial.pairs_within(spark.createDataFrame(rows, "id string, rank long, lat double, lng double"), 100).select("a", "b", "distance_m")
    assert len(x.collect()) == 780
    plan = x._jdf.queryExecution().executedPlan().toString()
    # lines of one number n, marked *(n), are one generated loop, which keeps copies of all rows that it makes of one input row
    loops = re.findall(r"\*\((\d+)\) Generate ", plan)
    assert loops and len(loops) == len(set(loops))


def test_search_box_is_clamped():
    w, s, e, n = geo.search_box(18.41, 74.04, 5000)
    assert s == 18.40 and e == 74.05 and w < 74.04 and n > 18.41


# datasets


def test_hamming_pairs_equal_a_loop(spark):
    rnd = random.Random(6)
    hs = [rnd.getrandbits(128) for _ in range(30)]
    hs += [h ^ (1 << rnd.randrange(128)) ^ (1 << rnd.randrange(128)) ^ (1 << rnd.randrange(128)) for h in hs]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(h & (2**64 - 1)), signed(h >> 64)) for i, h in enumerate(hs)], "id long, p long, q long")
    for d in (2, 12):
        want = {(i, j, (hs[i] ^ hs[j]).bit_count()) for i in range(60) for j in range(i + 1, 60) if (hs[i] ^ hs[j]).bit_count() <= d}
        got = [tuple(r) for r in dataset.hamming_pairs(df, d, ["p", "q"]).collect()]
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_hamming_plans_lose_no_pair_and_give_each_once(spark, agree):
    rnd = random.Random(16)
    hs = [rnd.getrandbits(128) for _ in range(20)]
    for _ in range(60):
        h = rnd.choice(hs)
        for _ in range(rnd.randint(0, 9)):
            h ^= 1 << rnd.randrange(128)
        hs.append(h)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(h & (2**64 - 1)), signed(h >> 64), f"s{i % 3}") for i, h in enumerate(hs)], "id long, p long, q long, split string")
    want = {(i, j, (hs[i] ^ hs[j]).bit_count()) for i in range(80) for j in range(i + 1, 80) if (hs[i] ^ hs[j]).bit_count() <= 8}
    got = [tuple(r) for r in dataset.hamming_pairs(df, 8, ["p", "q"], plan=(8 + agree, agree)).collect()]
    assert set(got) == want and len(got) == len(want)
    apart = [tuple(r) for r in dataset.hamming_pairs(df, 8, ["p", "q"], apart="split", plan=(8 + agree, agree)).collect()]
    assert set(apart) == {w for w in want if w[0] % 3 != w[1] % 3} and len(apart) == len(set(apart))
    assert dataset.hamming_plan(10**9, 256, 12)[1] > 1 and dataset.hamming_plan(100, 256, 12)[1] == 1
    assert dataset.hamming_pairs(df.limit(0), 8, ["p", "q"]).count() == 0


def test_far_hamming_pairs_compare_blocks(spark, monkeypatch):
    """Within 18 of 64 bits buckets would meet pairs more than once; blocks meet each once."""
    monkeypatch.setattr(dataset, "BLOCK", 40)
    rnd = random.Random(26)
    hs = [rnd.getrandbits(64) for _ in range(60)]
    hs += [hs[0]] * 30 + [h ^ rnd.getrandbits(64) & rnd.getrandbits(64) & rnd.getrandbits(64) for h in hs]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(h), f"s{i % 3}") for i, h in enumerate(hs)] + [(999, None, "s1")], "id long, w long, split string")
    want = {(i, j, (hs[i] ^ hs[j]).bit_count()) for i in range(150) for j in range(i + 1, 150) if (hs[i] ^ hs[j]).bit_count() <= 18}
    x = dataset.hamming_pairs(df, 18, ["w"])
    got = [tuple(r) for r in x.collect()]
    assert set(got) == want and len(got) == len(want) > 100
    assert "Join" not in x._jdf.queryExecution().analyzed().toString()
    apart = [tuple(r) for r in dataset.hamming_pairs(df, 18, ["w"], apart="split", sides=True).collect()]
    assert set(apart) == {(*w, f"s{w[0] % 3}", f"s{w[1] % 3}") for w in want if w[0] % 3 != w[1] % 3} and len(apart) == len(set(apart))


def test_numbers_over_ranges(spark):
    rnd = random.Random(17)
    rows = [(rnd.randrange(50), i) for i in range(500)]
    got = graph.numbered(spark.createDataFrame(rows, "a long, b long"), [F.desc("a"), F.asc("b")], "n").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r["n"] for r in got) == list(range(1, 501))
    assert graph.numbered(spark.createDataFrame([], "a long"), [F.asc("a")], "n").count() == 0


def test_quality_flags_follow_the_rules_at_the_edges(spark):
    images = spark.createDataFrame([("a", 100, 100, 100, 100, 1, "RGB"), ("b", 100, 100, 101, 100, 6, "L"), ("c", 100, 100, 100, 100, 1, "RGB")], "image string, width int, height int, real_width int, real_height int, orientation int, mode string")
    boxes = spark.createDataFrame([("a", 0, -0.3, 5.0, 10.0, 10.0), ("a", 1, 90.0, 90.0, 10.4, 10.4), ("a", 2, 99.0, 5.0, 1.8, 1.0), ("b", 0, 5.0, 5.0, 9.0, 9.0), ("b", 1, 5.0, 5.0, 9.0, 9.1)], "image string, idx long, x double, y double, w double, h double")
    got = {r["image"]: r["flags"] for r in dataset.quality_flags(boxes, images).collect()}
    assert got == {
        "a": ["box 0 outside or empty", "box 2 outside or empty", "box 2 under 2px"],
        "b": ["size differs from annotation", "EXIF orientation 6", "mode L", "boxes 0 and 1 nearly equal"],
        "c": ["no boxes"],
    }


def test_leases_follow_each_other(spark):
    rnd = random.Random(18)
    claims = sorted((f"k{rnd.randrange(3)}", rnd.randrange(400), f"o{i}") for i in range(300))
    want, until = {}, {}
    for key, at, owner in claims:
        want[key, at, owner] = ok = at >= until.get(key, -1)
        if ok:
            until[key] = at + 25
    got = store.leases(spark.createDataFrame(claims, "key string, at long, owner string"), 25)
    assert {(r["key"], r["at"], r["owner"]): r["granted"] for r in got.collect()} == want


def test_leases_move_claims_three_times(spark):
    rnd = random.Random(19)
    claims = sorted((f"k{i % 3}", rnd.randrange(30_000), f"o{i}") for i in range(4_000))
    claims += [claims[-1], (None, 1, "o"), ("k9", None, "o"), ("k9", 5, None)]
    df = spark.createDataFrame(claims, "key string, at long, owner string").repartition(5)
    for ttl, conf in ((7, "4"), (700, "40"), (50_000, "9"), (0, "4")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", conf)
        try:
            got = store.leases(df, ttl)
            assert got._jdf.queryExecution().analyzed().toString().count("Join") <= 1
            got = sorted((r for r in map(tuple, got.collect())), key=str)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        want, until = [(None, 1, "o", False), ("k9", None, "o", False), ("k9", 5, None, True)], {}
        for key, at, owner in sorted(claims[:-3]):
            ok = at >= until.get(key, -1)
            until[key] = at + ttl if ok else until[key]
            want.append((key, at, owner, ok))
        assert got == sorted(want, key=str), ttl


def test_parity_clips_to_the_image_and_says_what_strict_would(spark):
    box = "image string, idx long, confidence double, x1 double, y1 double, x2 double, y2 double"
    left = spark.createDataFrame([("a", 0, 0.9, 0.1, 0.1, 0.6, 0.95), ("b", 0, 0.9, 0.1, 0.1, 0.2, 0.2)], box)
    right = spark.createDataFrame([("a", 0, 0.9, 0.1, 0.1, 0.6, 0.99), ("c", 0, 0.9, 0.1, 0.1, 0.2, 0.2)], box)
    bounds = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 0.9)], "image string, bx1 double, by1 double, bx2 double, by2 double")
    got = {r["image"]: r for r in evaluate.parity(left, right, 640.0, bounds).collect()}
    assert got["a"]["passed"] and not got["a"]["passed_strict"] and got["a"]["min_iou"] == 1.0
    assert (got["b"]["min_iou"], got["b"]["max_corner_px"], got["b"]["unpaired"], got["b"]["passed"]) == (1.0, 0.0, 1, False)


def test_split_keeps_groups_together_and_guards(spark):
    g = spark.createDataFrame([(f"g{i % 20}",) for i in range(100)], "group string")
    s = dataset.grouped_split(g).collect()
    assert sorted((r["split"]) for r in s).count("val") == 3 and len({r["group"] for r in s}) == len(s) == 20
    assert dataset.leaks(g.join(dataset.grouped_split(g), "group"), "group").count() == 0
    with pytest.raises(ValueError):
        dataset.must_match(g, g.where("group <> 'g3'"), ["group"])


def test_duplicate_groups_merge_through_shared_hashes(spark):
    rows = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "3"), ("e", None), ("f", None)]
    got = {r["group"]: r["merged"] for r in dataset.duplicate_groups(spark.createDataFrame(rows, "group string, sha string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}


def test_choose_validation(spark):
    rows = [("a", 10, 10, 5, 10), ("b", 10, 10, 5, 10), ("c", 13, 13, 6, 12), ("d", 9, 9, 0, 0), ("big", 58, 58, 30, 60)]
    got = dataset.choose_validation(spark.createDataFrame(rows, "name string, panoramas long, views long, litter_views long, regions long")).first()
    import itertools

    best = min((not (0.2 <= sum(x[4] for x in s) / 92 <= 0.45 and sum(x[3] for x in s) > 0), abs(sum(x[1] for x in s) / 100 - 1 / 3), n, [x[0] for x in s]) for n in range(1, 5) for s in itertools.combinations(rows[:4], n))
    assert got["chosen"].split(",") == best[3] and got["in_bounds"]


def test_spaced_rows_are_apart_and_maximal(spark):
    rnd = random.Random(7)
    pts = [(f"p{i}", f"s{i % 3}", 18.5 + rnd.random() * 0.01, 73.8 + rnd.random() * 0.01) for i in range(60)]
    chosen = {r["id"] for r in dataset.spaced(spark.createDataFrame(pts, "id string, sequence string, lat double, lng double"), 300, 1).collect()}
    for a in pts:
        near = [b for b in pts if b[0] in chosen and b[0] != a[0] and a[1] == b[1] and round(hav(*a[2:], *b[2:])) < 300]
        assert bool(near) != (a[0] in chosen)


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(100)], "id long, k string")
    n = {r["k"]: r["count"] for r in dataset.stratified(df, ["k"], 20, 1).groupBy("k").count().collect()}
    assert n == {"a": 18, "b": 2}
    rr = [r["k"] for r in dataset.round_robin(df, "k", [F.asc("id")], 6).collect()]
    assert sorted(rr) == ["a", "a", "a", "b", "b", "b"]
    assert [r["member"] for r in dataset.deal_out(df, [F.asc("id")], 3).orderBy("id").limit(4).collect()] == [0, 1, 2, 0]


def test_quality_flags(spark):
    images = spark.createDataFrame([("a", 100, 100), ("b", 100, 100), ("c", 100, 100)], "image string, width int, height int")
    b = spark.createDataFrame([("a", 0, 90.0, 0.0, 20.0, 5.0), ("a", 1, 5.0, 5.0, 1.0, 9.0), ("b", 0, 1.0, 1.0, 50.0, 50.0), ("b", 1, 1.0, 1.0, 50.0, 51.0)], "image string, idx int, x double, y double, w double, h double")
    got = {r["image"]: r["flags"] for r in dataset.quality_flags(b, images).collect()}
    assert got == {"a": ["box 0 outside or empty", "box 1 under 2px"], "b": ["boxes 0 and 1 nearly equal"], "c": ["no boxes"]}


def test_collages_do_not_overlap(spark):
    rnd = random.Random(8)
    parts = spark.createDataFrame([("c", i, rnd.uniform(40, 250), rnd.uniform(40, 250)) for i in range(30)], "collage string, part long, w double, h double")
    out = derive.pack_collages(parts).collect()
    assert len(out) >= 5
    for i, a in enumerate(out):
        assert a["x"] >= 0 and a["x"] + a["w"] <= 640 and a["y"] + a["h"] <= 640
        for b in out[i + 1 :]:
            assert a["x"] + a["w"] <= b["x"] or b["x"] + b["w"] <= a["x"] or a["y"] + a["h"] <= b["y"] or b["y"] + b["h"] <= a["y"]


def test_sharpness_and_hash(spark):
    df = spark.createDataFrame([(1, [[float((x * y) % 7) for x in range(17)] for y in range(16)]), (2, [[1.0, 2.0]]), (3, None)], "i int, pixels array<array<double>>")
    got = {r["i"]: r["sharpness"] for r in derive.laplacian_variance(df).collect()}
    assert got[1] > 0 and got[2] is None and got[3] is None
    r = derive.dhash_words(df.where("i = 1")).first()
    bits = "".join(str(int(((x + 1) * y) % 7 > (x * y) % 7)) for y in range(16) for x in range(16))
    assert [f"{r[f'h{i}'] & (2**64 - 1):064b}" for i in range(4)] == [bits[64 * i : 64 * i + 64] for i in range(4)]


def test_curves(spark):
    c = [("r", e, f, 1.0 - 0.1 * e, v) for e, (f, v) in enumerate([(0.1, 0.5), (0.3, 0.4), (0.3, 0.5), (0.2, 0.6), (0.1, 0.7), (0.1, 0.8)])]
    r = diagnose.curve_summary(spark.createDataFrame(c, "run string, epoch long, fitness double, train_loss double, val_loss double"), 4, 50).first()
    assert (r["best_epoch"], r["stopped"], r["val_rising"], r["train_falling"]) == (1, "early stopping", True, True) and r["slope_last_10"] < 0


# reviews and files


def test_review_rules(spark):
    s = "status string, boxes array<array<double>>, notes string"
    rows = [("litter", [[0.1, 0.1, 0.2, 0.2]], None), ("clean", [], None), ("litter", [], None), ("skip", [], " "), ("skip", [], "x"), ("litter", [[0.3, 0.1, 0.2, 0.2]], None), ("odd", None, None)]
    got = [r["violations"] for r in review.violations(spark.createDataFrame(rows, s)).collect()]
    assert got == [[], [], ["boxes do not fit the status"], ["skip needs notes"], [], ["box"], ["status"]]


def test_changed_image_is_unreviewed_again(spark):
    log = spark.createDataFrame([("v", 1, "clean", [], "s"), ("v", 2, "litter", [[0.0, 0.0, 1.0, 1.0]], "s"), ("w", 1, "clean", [], "old")], "view string, revision int, status string, boxes array<array<double>>, sha256 string")
    now = spark.createDataFrame([("v", "s"), ("w", "new")], "view string, sha string")
    got = {r["view"]: (r["status"], len(r["boxes"])) for r in review.current(log, now).collect()}
    assert got == {"v": ("litter", 1), "w": ("unreviewed", 0)}


def test_pack_merge_rules(spark):
    pack = [("a", "m", "litter", "b", "s"), ("b", "m", "unreviewed", "", "s"), ("c", "m", "clean", "", "bad"), ("d", "m", "clean", "", "s"), ("e", "m", "clean", "", "s"), ("f", "m", "clean", "", "s"), ("g", "m", "clean", "", "s")]
    known = [(v, "s", "m" if v != "d" else "n", v == "g") for v in "abcdefg"]
    got = review.merge_packs(
        spark.createDataFrame(pack, "view string, member string, status string, boxes string, sha string"), spark.createDataFrame([("e", "clean", ""), ("f", "litter", "b")], "view string, status string, boxes string"), spark.createDataFrame(known, "view string, sha string, assigned string, calibration boolean")
    )
    assert {r["view"]: r["result"] for r in got.collect()} == {"a": "merged", "b": "skipped", "c": "rejected", "d": "rejected", "e": "unchanged", "f": "conflict", "g": "calibration"}


def test_file_sources(spark, tmp_path):
    d = tmp_path / "reviews"
    d.mkdir()
    (d / "12_back.jpg.json").write_text('{"status": "litter", "boxes": [[0.1, 0.2, 0.3, 0.4]], "revision": 2, "reviewed_at": "2025-01-01T00:00:00Z"}')
    r = files.review_folder(spark, str(d)).first()
    assert (r["image_id"], r["view_id"], r["status"], r["boxes"], r["revision"]) == ("12", "back", "litter", [[0.1, 0.2, 0.3, 0.4]], 2)
    d = tmp_path / "labels"
    d.mkdir()
    (d / "a.txt").write_text("0 0.5 0.5 0.2 0.4\n\n")
    (d / "b.txt").write_text("")
    names, boxes = files.label_files(spark, str(d))
    assert sorted(x["file"] for x in names.collect()) == ["a", "b"]
    assert [tuple(x[c] for c in ("file", *CORNERS)) for x in boxes.collect()] == [("a", 0.4, 0.3, 0.6, 0.7)]
    (d / "c.txt").write_text("1 0.5 0.5 0.2 0.4")
    with pytest.raises(Exception, match="class other than 0"):
        files.label_files(spark, str(d))[1].collect()
    (tmp_path / "s.csv").write_text(" id , b\n1,2\n")
    assert files.sheet(spark, str(tmp_path / "s.csv")).columns == ["id", "b"]
    (tmp_path / "coco.json").write_text('{"images": [{"id": 1, "file_name": "f", "width": 20, "height": 10}], "annotations": [{"id": 5, "image_id": 1, "bbox": [10, 5, 20, 2]}, {"id": 6, "image_id": 1, "bbox": [30, 5, 20, 2]}], "licenses": [{"id": 1, "name": "n", "url": "u"}]}')
    images, notes, licences = files.coco(spark, str(tmp_path / "coco.json"))
    assert [tuple(r) for r in dataset.coco_boxes(images, notes).collect()] == [(1, 0.5, 0.5, 1.0, 0.7)] and licences.count() == 1
    files.write_new(boxes, str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        files.write_new(boxes, str(tmp_path / "out"))
