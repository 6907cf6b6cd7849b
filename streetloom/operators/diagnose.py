"""Diagnosis of training: curves, box statistics, reach of looser matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def curve_summary(curve: DataFrame, patience: int, limit: int) -> DataFrame:
    """One row for each run of ``curve(run, epoch, fitness, train_loss, val_loss)``: best epoch, slope of the fitness over
    the last ten, whether validation loss rises while training loss falls, why the run stopped. Epochs count from 0."""
    w = W.partitionBy("run")
    back = F.row_number().over(w.orderBy(F.desc("epoch")))
    x = curve.withColumn("back", back).withColumn("n", F.count("*").over(w))
    mean = lambda c, a, b: F.avg(F.when(F.col("back").between(a, b), F.col(c)))
    x = x.groupBy("run").agg(
        F.count("*").alias("epochs"), F.max(F.struct("fitness", (-F.col("epoch")).alias("e"))).alias("b"),
        F.regr_slope(F.when(F.col("back") <= 10, F.col("fitness")), F.col("epoch").cast("double")).alias("slope"),
        mean("val_loss", 1, 3).alias("v3"), F.min("val_loss").alias("v0"), mean("train_loss", 1, 3).alias("t3"), mean("train_loss", 4, 6).alias("t6"),
    )
    best = (-F.col("b.e")).cast("long")
    stop = F.when(F.col("epochs") >= limit, "limit").when(F.col("epochs") - 1 - best >= patience, "early stopping").otherwise("interrupted")
    return x.select(
        "run", "epochs", best.alias("best_epoch"), F.col("b.fitness").alias("best_fitness"), F.when(F.col("epochs") >= 3, F.col("slope")).alias("slope_last_10"),
        ((F.col("epochs") >= 6) & (F.col("v3") > 1.05 * F.col("v0"))).alias("val_rising"), F.coalesce((F.col("epochs") >= 6) & (F.col("t3") < F.col("t6")), F.lit(False)).alias("train_falling"), stop.alias("stopped"),
    )


def box_stats(sides: DataFrame) -> DataFrame:
    """Percentiles and shares of ``sides(side)`` in one row; null for no boxes."""
    return sides.agg(
        F.count("*").alias("boxes"), F.percentile("side", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"),
        F.avg((F.col("side") < 8).cast("double")).alias("under_8"), F.avg((F.col("side") < 16).cast("double")).alias("under_16"), F.avg((F.col("side") < 32).cast("double")).alias("under_32"),
    )


def read_results(spark, path: str) -> DataFrame:
    """A file of training results with blanks around its column names: one row for each epoch, numbers as doubles."""
    x = spark.read.csv(path, header=True)
    return x.select(*[F.col(f"`{c}`").cast("double").alias(c.strip()) for c in x.columns])


def result_rows(results: DataFrame, run: str, names: list[str]) -> DataFrame:
    """Results kept as one array a measure as rows (run, epoch, measures), epochs from 0; the measures are as long as one another."""
    x = results.select(run, F.posexplode(F.arrays_zip(*names)).alias("epoch", "v"))
    return x.select(run, F.col("epoch").cast("long").alias("epoch"), *[F.col("v")[n].alias(n) for n in names])


def boxes_per_image(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """One row: mean, median and largest number of boxes of an image, images without any; ``images(image)``."""
    n = images.select("image").distinct().join(boxes.groupBy("image").agg(F.count("*").alias("n")), "image", "left").na.fill(0, ["n"])
    return n.agg(F.count("*").alias("images"), F.avg("n").alias("mean_boxes"), F.median("n").alias("median_boxes"), F.max("n").alias("max_boxes"), F.count_if(F.col("n") == 0).alias("empty_images"))


def category_counts(misses: DataFrame) -> DataFrame:
    """Counts by category and by category and size in one pass; the size is null in the first kind of row."""
    x = misses.groupingSets([[F.col("category")], [F.col("category"), F.col("size_bucket")]], F.col("category"), F.col("size_bucket"))
    return x.agg(F.grouping("size_bucket").alias("by_category"), F.count("*").alias("count"))


def reach(misses: DataFrame, levels: list[float]) -> DataFrame:
    """How many truths would match at looser overlaps."""
    return misses.agg(*[F.count_if(F.col("best_iou") >= t).alias(f"at_{round(t * 100)}") for t in levels])


def inspection(records: DataFrame, missed: DataFrame, per_bucket: int = 3) -> DataFrame:
    """Images to look at: all with false alarms, and of each size bucket the first few with a miss that are not among
    them; ``records(image, fp)``, ``missed(image, bucket_order)``. An image counts in its first bucket."""
    alarms = records.where("fp > 0").select("image", F.lit("false alarm").alias("why"))
    rest = missed.join(alarms, "image", "left_anti").groupBy("image").agg(F.min("bucket_order").alias("bucket_order"))
    rest = rest.withColumn("k", F.row_number().over(W.partitionBy("bucket_order").orderBy("image"))).where(F.col("k") <= per_bucket)
    return alarms.unionByName(rest.select("image", F.concat(F.lit("missed, bucket "), F.col("bucket_order").cast("string")).alias("why")))
