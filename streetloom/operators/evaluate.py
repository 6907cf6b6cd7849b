"""Detector evaluation: one-to-one matching, summaries, intervals, sweeps, parity, near misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import iou
from ..functions.stats import f1, ratio, wilson
from ..schema import MATCH_IOU, PARITY_IOU, PARITY_PX, SIZE_BUCKETS
from .graph import one_to_one


def pairs(preds: DataFrame, truths: DataFrame, least: float = 0.0) -> DataFrame:
    """All (prediction, truth) pairs of an image that overlap by more than ``least`` (0 or more).

    The join tests edges only. The overlap is made by a generator over the pairs that meet: its long expression is then
    compiled once, where filters and columns on it would each repeat it and make a method too large to be optimised.
    """
    t = truths.select("image", F.col("idx").alias("truth"), *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    p = preds.withColumnRenamed("idx", "prediction")
    meet = (F.col("x1") < F.col("t_x2")) & (F.col("t_x1") < F.col("x2")) & (F.col("y1") < F.col("t_y2")) & (F.col("t_y1") < F.col("y2"))
    x = p.join(t, "image").where(meet)
    a, b = [F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(f"t_{c}") for c in ("x1", "y1", "x2", "y2")]
    return x.withColumn("iou", F.explode(F.array(iou(a, b)))).where(F.col("iou") > least)


def match(preds: DataFrame, truths: DataFrame, threshold: float = MATCH_IOU) -> DataFrame:
    """(image, prediction, truth, iou): predictions by falling confidence (then index) each claim the free truth with
    the largest overlap (then the lowest index), if it reaches the threshold.

    Only pairs that reach the threshold can ever match, so nothing else leaves the join: a free truth with the largest
    overlap is below the threshold exactly if none at or above it is free. The claims are the pairs chosen greedily by
    confidence, prediction, overlap and truth.
    """
    near = pairs(preds, truths).where(F.col("iou") >= threshold).select("image", "prediction", "confidence", "truth", "iou")
    order = [-F.col("confidence"), F.col("prediction"), -F.col("iou"), F.col("truth")]
    return one_to_one(near, ["image"], "prediction", "truth", order).select("image", "prediction", "truth", "iou")


def match_by_overlap(left: DataFrame, right: DataFrame, threshold: float | None = None) -> DataFrame:
    """(image, prediction, truth, iou): all pairs of an image by falling overlap, then falling indexes, one to one.

    Without a threshold pairs that do not overlap match too, as parity wants it.
    """
    near = pairs(left, right).where(F.col("iou") >= (threshold or 0.0)).select("image", "prediction", "truth", "iou")
    found = one_to_one(near, ["image"], "prediction", "truth", [-F.col("iou"), -F.col("prediction"), -F.col("truth")])
    if threshold is not None:
        return found
    # pairs that do not overlap all tie at 0: by falling indexes the largest free ones go together, then the next
    def free(df, name):  # noqa: ANN001, ANN202
        rest = df.select("image", F.col("idx").alias(name)).join(found.select("image", name), ["image", name], "left_anti")
        return rest.withColumn("k", F.row_number().over(W.partitionBy("image").orderBy(F.desc(name))))

    rest = free(left, "prediction").join(free(right, "truth"), ["image", "k"]).select("image", "prediction", "truth", F.lit(0.0).alias("iou"))
    return found.unionByName(rest)


def records(images: DataFrame, preds: DataFrame, truths: DataFrame, matches: DataFrame) -> DataFrame:
    """(image, tp, fp, fn, truths) for every image of ``images(image)``."""
    p = preds.groupBy("image").agg(F.count("*").alias("p"))
    t = truths.groupBy("image").agg(F.count("*").alias("t"))
    m = matches.groupBy("image").agg(F.count("*").alias("tp"))
    x = images.select("image").distinct().join(p, "image", "left").join(t, "image", "left").join(m, "image", "left").na.fill(0, ["p", "t", "tp"])
    return x.select("image", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), F.col("t").alias("truths"))


def summary(recs: DataFrame) -> DataFrame:
    """Totals, precision and recall (null where undefined), false alarms on images without truths."""
    x = recs.agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count_if(F.col("truths") == 0).alias("clean_images"),
        F.coalesce(F.sum(F.when(F.col("truths") == 0, F.col("fp"))), F.lit(0)).alias("clean_false_alarms"), F.count_if((F.col("truths") == 0) & (F.col("fp") > 0)).alias("clean_images_hit"),
    )
    return x.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def recall_by_size(truths: DataFrame, matches: DataFrame) -> DataFrame:
    """(size_bucket, labels, found, recall) with every bucket; ``truths(image, idx, size_bucket)``."""
    spark = truths.sparkSession
    names = spark.createDataFrame([(i, b[0]) for i, b in enumerate(SIZE_BUCKETS)], "bucket_order int, size_bucket string")
    hit = matches.select("image", F.col("truth").alias("idx"), F.lit(1).alias("hit"))
    x = truths.join(hit, ["image", "idx"], "left").groupBy("size_bucket").agg(F.count("*").alias("labels"), F.count("hit").alias("found"))
    x = F.broadcast(names).join(x, "size_bucket", "left").na.fill(0, ["labels", "found"])
    return x.select("bucket_order", "size_bucket", "labels", "found", ratio(F.col("found"), F.col("labels")).alias("recall"))


def with_intervals(df: DataFrame, k: str, n: str) -> DataFrame:
    low, high = wilson(F.col(k), F.col(n))
    return df.withColumn("low", low).withColumn("high", high)


def mixed(v: Column, seed: int) -> Column:
    """A pseudo-random number below 2**31 of a long, by two rounds of a linear step and a shift; products fit a long."""
    for k, c in ((1_103_515_245, 12_345 + seed), (1_664_525, 1_013_904_223)):
        x = (v % 2**31 * k + c) % 2**31
        v = x.bitwiseXOR(F.shiftright(x, 15))
    return v


def bootstrap(recs: DataFrame, key: Column, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """95 % intervals of precision and recall by resampling whole groups with replacement.

    Round and draw give a pseudo-random group number by integer arithmetic, so a seed fixes the result on any cluster
    layout and in any engine. The groups, one short row for each, meet the draws in a join, however many there are.
    """
    spark = recs.sparkSession
    g = recs.groupBy(key.alias("g")).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    n = g.count()
    if not n:
        return spark.createDataFrame([], "metric string, low double, high double, rounds bigint")
    # groups are numbered where they are: there may be as many as images
    numbered = g.orderBy("g").select(*[F.col(c).cast("long") for c in ("tp", "fp", "fn")]).rdd.zipWithIndex().toDF("r struct<tp: long, fp: long, fn: long>, i long").select("i", "r.*")
    draws = spark.range(rounds * n).select((F.col("id") / n).cast("long").alias("round"), (mixed(F.col("id"), seed) % n).alias("i"))
    x = draws.join(numbered, "i").groupBy("round").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    x = x.select(ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    x = x.select(F.explode(F.array(F.struct(F.lit("precision").alias("metric"), F.col("precision").alias("v")), F.struct(F.lit("recall").alias("metric"), F.col("recall").alias("v")))).alias("s")).select("s.*").where("v is not null")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    return x.groupBy("metric").agg(q.alias("q"), F.count("*").alias("rounds")).select("metric", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "rounds")


def sweep(preds: DataFrame, truths: DataFrame, thresholds: list[float], least_iou: float = MATCH_IOU) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall) for each confidence threshold.

    A claim depends only on predictions of higher confidence, so one matching over all predictions holds for every
    threshold: the claims above it are the same, and one pass of aggregation makes the whole curve.
    """
    spark = preds.sparkSession
    t = spark.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    m = match(preds, truths, least_iou).join(preds.select("image", F.col("idx").alias("prediction"), "confidence"), ["image", "prediction"])
    def counts(df, name):  # noqa: ANN001, ANN202
        return df.select("confidence").join(F.broadcast(t), F.col("confidence") >= F.col("threshold")).groupBy("threshold").agg(F.count("*").alias(name))
    total = truths.agg(F.count("*").alias("labels"))
    x = t.join(counts(preds, "p"), "threshold", "left").join(counts(m, "tp"), "threshold", "left").na.fill(0, ["p", "tp"]).crossJoin(total)  # one row
    x = x.select("threshold", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("labels") - F.col("tp")).alias("fn"))
    return x.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def choose_threshold(curve: DataFrame, precision: float = 0.85, by: list[str] | None = None) -> DataFrame:
    """The lowest threshold that reaches the precision; else the one with the best F1, the lower of equals. One row, or
    one for each group ``by``."""
    good = F.min(F.when(F.col("precision") >= precision, F.col("threshold")))
    best = F.max(F.struct(f1(F.col("precision"), F.col("recall")).alias("f"), (-F.col("threshold")).alias("t")))
    return curve.groupBy(*(by or [])).agg(F.coalesce(good, -best["t"]).alias("threshold"), good.isNotNull().alias("reached"))


def parity(left: DataFrame, right: DataFrame, size_px: float = 640.0, bounds: DataFrame | None = None) -> DataFrame:
    """Per image: counts, least overlap, largest corner and confidence difference of the pairs (1, 0 and 0 where there
    are none), whether it passes, and whether it does by overlap alone and without clipping.

    ``bounds(image, bx1, by1, bx2, by2)`` is where the image lies in the detector's input: boxes are clipped to it first.
    """
    plain = _paired(left, right, size_px).select("image", ((F.col("n_left") == F.col("n_right")) & (F.col("pairs") == F.col("n_left")) & F.coalesce("overlap", F.lit(True))).alias("passed_strict"))

    def clip(df: DataFrame) -> DataFrame:
        x = df.join(bounds, "image", "left")
        low, high = {"x": "bx1", "y": "by1"}, {"x": "bx2", "y": "by2"}
        return x.withColumns({c: F.least(F.greatest(F.col(c), F.coalesce(low[c[0]], c)), F.coalesce(high[c[0]], c)) for c in ("x1", "y1", "x2", "y2")}).select(*df.columns)

    y = _paired(left, right, size_px) if bounds is None else _paired(clip(left), clip(right), size_px)
    unpaired = F.greatest("n_left", "n_right") - F.col("pairs")
    y = y.withColumn("unpaired", unpaired).withColumn("passed", (F.col("n_left") == F.col("n_right")) & F.coalesce("close", F.lit(True))).drop("close", "overlap")
    return y.na.fill({"min_iou": 1.0, "max_corner_px": 0.0, "max_confidence_diff": 0.0}).join(plain, "image")


def _paired(left: DataFrame, right: DataFrame, size_px: float) -> DataFrame:
    m = match_by_overlap(left, right)
    a = left.select("image", F.col("idx").alias("prediction"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2", "confidence")])
    b = right.select("image", F.col("idx").alias("truth"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2", "confidence")])
    x = m.join(a, ["image", "prediction"]).join(b, ["image", "truth"])
    corner = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) * size_px for c in ("x1", "y1", "x2", "y2")])
    overlap = F.col("iou") >= PARITY_IOU
    p = x.groupBy("image").agg(
        F.count("*").alias("pairs"), F.min("iou").alias("min_iou"), F.max(corner).alias("max_corner_px"), F.max(F.abs(F.col("a_confidence") - F.col("b_confidence"))).alias("max_confidence_diff"),
        F.bool_and(overlap | (corner <= PARITY_PX)).alias("close"), F.bool_and(overlap).alias("overlap"),
    )
    na, nb = left.groupBy("image").agg(F.count("*").alias("n_left")), right.groupBy("image").agg(F.count("*").alias("n_right"))
    return na.join(nb, "image", "full_outer").join(p, "image", "left").na.fill(0, ["n_left", "n_right", "pairs"])


def near_misses(preds: DataFrame, truths: DataFrame, matches: DataFrame) -> DataFrame:
    """Per truth: its best prediction and why it was missed, if it was."""
    over = pairs(preds, truths)
    best = over.groupBy("image", "truth").agg(F.max(F.struct("iou", "confidence", "prediction")).alias("b"), F.count_if(F.col("iou") > 0.1).alias("covered"))
    spans = over.where("iou > 0.1").groupBy("image", "prediction").agg(F.countDistinct("truth").alias("spanned"))
    x = truths.select("image", F.col("idx").alias("truth")).join(best, ["image", "truth"], "left")
    x = x.select("image", "truth", F.coalesce("b.iou", F.lit(0.0)).alias("best_iou"), F.col("b.prediction").alias("prediction"), F.coalesce("covered", F.lit(0)).alias("covered"))
    x = x.join(spans, ["image", "prediction"], "left").join(matches.select("image", "truth", F.lit(True).alias("hit")), ["image", "truth"], "left")
    kind = F.when(F.coalesce("hit", F.lit(False)), "matched").when(F.col("best_iou") < 0.1, "no prediction nearby").when((F.coalesce("spanned", F.lit(0)) > 1) | (F.col("covered") > 1), "cluster mismatch").otherwise("near-miss localisation")
    return x.select("image", "truth", "best_iou", "covered", kind.alias("category"))


def agreement(boxes: DataFrame) -> DataFrame:
    """(view, a, b, f1) of each pair of reviewers of a view; ``boxes(view, reviewer, idx, x1..y2)``; f1 null if both drew none.

    Reviewers without a box are rows with a null idx. Views are gone through many at a time, each whole: memory grows with
    the boxes of one view and the pairs of them that match.
    """
    import numpy as np
    import pyarrow as pa

    from .batches import in_groups, starts

    def within(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): each i with all j from begin[i] to before end[i]."""
        m = end - begin
        return np.repeat(np.arange(len(m)), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin, m)

    def overlapping(box: np.ndarray, begin: np.ndarray, end: np.ndarray):  # noqa: ANN202
        upto, lo = np.cumsum(end - begin), 0
        while lo < len(box):  # some pairs at a time
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 500_000, side="right")))
            i, j = within(begin[lo:hi], end[lo:hi])
            i, lo = i + lo, hi
            side = np.minimum(box[i, 2:], box[j, 2:]) - np.maximum(box[i, :2], box[j, :2])
            at = (side > 0).all(1)
            i, j, inter = i[at], j[at], side[at].prod(1)
            area = lambda k: np.maximum(0, box[k, 2] - box[k, 0]) * np.maximum(0, box[k, 3] - box[k, 1])
            over = inter / (area(i) + area(j) - inter)
            at = over >= MATCH_IOU
            yield i[at], j[at], over[at]

    def agree(t: pa.Table, views: np.ndarray):  # noqa: ANN202
        first = starts(t, ["view", "reviewer"])  # an answer each
        view_end = np.append(views[1:], len(t))
        real = t["idx"].is_valid().to_numpy()
        n = np.add.reduceat(real.astype(np.int64), first)
        last = np.searchsorted(first, view_end[np.searchsorted(views, first, side="right") - 1])  # behind the answers of its view
        p, q = within(np.arange(len(first)) + 1, last)
        # boxes, and behind which of them the later answers of their view begin and end
        rows = np.flatnonzero(real)
        answer = np.searchsorted(first, rows, side="right") - 1
        bounds = np.append(first, len(t))
        box = np.stack([t[c].cast(pa.float64()).to_numpy()[rows] for c in ("x1", "y1", "x2", "y2")], axis=1)
        found = list(overlapping(box, np.searchsorted(rows, bounds[answer + 1]), np.searchsorted(rows, bounds[last[answer]])))
        i, j, over = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        idx = t["idx"].cast(pa.int64()).fill_null(0).to_numpy()[rows]
        # one to one by falling overlap, then falling indexes
        order = np.lexsort((-idx[j], -idx[i], -over))
        i, j = i[order], j[order]
        left, right = (np.unique(np.column_stack([answer[x], idx[x], answer[y]]), axis=0, return_inverse=True)[1].ravel() for x, y in ((i, j), (j, i)))
        take = (np.bincount(left)[left] == 1) & (np.bincount(right)[right] == 1) if len(i) else np.zeros(0, bool)
        used: tuple[set, set] = set(), set()
        for k in np.flatnonzero(~take).tolist():
            if left[k] not in used[0] and right[k] not in used[1]:
                used[0].add(left[k])
                used[1].add(right[k])
                take[k] = True
        pair = np.searchsorted(p * len(first) + q, answer[i[take]] * len(first) + answer[j[take]])
        m, total = np.bincount(pair, minlength=len(p)), n[p] + n[q]
        f1 = pa.array(2 * m / np.maximum(total, 1), mask=total == 0)
        who = t.select(["view", "reviewer"]).take(pa.array(first))
        yield pa.table([who["view"].take(pa.array(p)), who["reviewer"].take(pa.array(p)), who["reviewer"].take(pa.array(q)), f1], names=["view", "a", "b", "f1"])

    x = boxes.where("view is not null and reviewer is not null").select("view", "reviewer", "idx", "x1", "y1", "x2", "y2")
    view, reviewer = (x.schema[c].dataType.simpleString() for c in ("view", "reviewer"))
    return in_groups(x, ["view"], [F.asc("reviewer"), F.asc("idx")], agree, f"view {view}, a {reviewer}, b {reviewer}, f1 double")


def calibration(boxes: DataFrame, statuses: DataFrame, least_f1: float = 0.7) -> DataFrame:
    """(view, reviewers, statuses_agree, mean_f1, discuss) of views that several reviewers answered: ``boxes`` as in
    ``agreement``, ``statuses(view, reviewer, status)``. A view is to be discussed if the statuses differ or the boxes
    agree too little; mean_f1 (three decimals) is null if no pair drew boxes."""
    f = agreement(boxes).groupBy("view").agg(F.round(F.avg("f1"), 3).alias("mean_f1"))
    x = statuses.groupBy("view").agg(F.countDistinct("reviewer").alias("reviewers"), (F.countDistinct("status") == 1).alias("statuses_agree")).join(f, "view", "left")
    return x.withColumn("discuss", ~F.col("statuses_agree") | F.coalesce(F.col("mean_f1") < least_f1, F.lit(False)))


def calibration_summary(views: DataFrame) -> DataFrame:
    """One row of ``calibration``: views, agreeing statuses, views to discuss."""
    return views.agg(F.count("*").alias("views"), F.count_if("statuses_agree").alias("status_agreement"), F.count_if("discuss").alias("to_discuss"))


def latency(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Median, least and largest ``latency_ms``; nulls do not count."""
    return runs.groupBy(*(by or [])).agg(F.median("latency_ms").alias("median_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), F.count("latency_ms").alias("runs"))
