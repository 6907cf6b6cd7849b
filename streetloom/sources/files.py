"""File sources and sinks: review folders, annotation files, label lines, sheets, detector output, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COCO, REVIEW, REVIEW_QUEUE


def review_folder(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file for each view; image and view come from the file name."""
    x = spark.read.schema(REVIEW).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return x.withColumn("image_id", F.regexp_extract("file", r"^(.+)_([a-z]+)\.jpg\.json$", 1)).withColumn("view_id", F.regexp_extract("file", r"^(.+)_([a-z]+)\.jpg\.json$", 2))


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and licences of an annotation file."""
    raw = spark.read.schema(COCO).option("multiLine", True).json(path)
    return raw.select(F.inline("images")), raw.select(F.inline("annotations")), raw.select(F.inline("licenses"))


def review_queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEW_QUEUE).option("multiLine", True).csv(path, header=True).withColumn("tags", F.split("tags", " "))


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with a header; blanks around column names go."""
    x = spark.read.csv(path, header=True)
    return x.toDF(*[c.strip() for c in x.columns])


def label_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, boxes): every label file, and its boxes as corners. An empty file is a clean image; only a missing one is
    unknown, so the files are a table of their own. A class other than 0 is an error."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1))
    # Spark reads no rows from empty files; the file index, which the driver holds anyway, lists them
    names = spark.createDataFrame([(f,) for f in raw.inputFiles()], "path string").select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("file"))
    line = raw.select("file", F.posexplode(F.filter(F.split("value", "\n"), lambda s: F.trim(s) != "")).alias("idx", "line"))
    p = F.split(F.trim("line"), r"\s+")
    v = line.select("file", F.col("idx").cast("long").alias("idx"), F.when(p[0] != "0", F.raise_error(F.concat(F.lit("class other than 0 in "), "file"))).otherwise(p).alias("p"))
    cx, cy, w, h = (F.col("p")[i].cast("double") for i in range(1, 5))
    boxes = v.select("file", "idx", (cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))
    return names, boxes


def label_line_ok(line: Column, slack: float = 1e-6) -> Column:
    """Five fields, class 0, a size over 0, inside the image within ``slack``."""
    p = F.split(F.trim(line), r"\s+")
    cx, cy, w, h = (F.get(p, F.lit(i)).try_cast("double") for i in range(1, 5))
    ok = (F.get(p, F.lit(0)) == "0") & (w > 0) & (h > 0) & (cx - w / 2 >= -slack) & (cy - h / 2 >= -slack) & (cx + w / 2 <= 1 + slack) & (cy + h / 2 <= 1 + slack)
    return (F.size(p) == 5) & F.coalesce(ok, F.lit(False))


def label_lines(boxes: DataFrame, by: str = "image") -> DataFrame:
    """Label text of each image: one line for each box, in the order of ``idx``."""
    line = F.format_string("0 %.8f %.8f %.8f %.8f", (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    x = boxes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))).alias("ls"))
    return x.select(by, F.array_join("ls.l", "\n").alias("labels"))


def detector_output(raw: DataFrame, column: str = "json") -> DataFrame:
    """Predictions of detector responses of any of the known forms: {"outputs": [...]}, a list, or one entry; an entry
    holds "predictions" as a list, or as an object with such a list.

    Gives (all other columns, entry, pos, pred) with pred a struct as ``boxes.normalised`` takes it.
    """
    number = lambda n: F.expr(f"try_variant_get(p, '$.{n}', 'double')")
    keep = [c for c in raw.columns if c != column]
    x = raw.withColumn("v", F.expr(f"try_parse_json({column})"))
    array = "array<variant>"
    entries = F.coalesce(F.expr(f"try_variant_get(v, '$.outputs', '{array}')"), F.expr(f"try_variant_get(v, '$', '{array}')"), F.array("v"))
    x = x.select(*keep, F.posexplode(entries).alias("entry", "e"))
    found = F.coalesce(F.expr(f"try_variant_get(e, '$.predictions.predictions', '{array}')"), F.expr(f"try_variant_get(e, '$.predictions', '{array}')"))
    x = x.select(*keep, "entry", F.posexplode(found).alias("pos", "p"))
    fields = ["x", "y", "width", "height", "x1", "y1", "x2", "y2"]
    label = F.lower(F.coalesce(F.expr("try_variant_get(p, '$.class', 'string')"), F.expr("try_variant_get(p, '$.label', 'string')"), F.lit("garbage")))
    return x.select(*keep, "entry", "pos", F.coalesce(number("confidence"), F.lit(0.0)).alias("confidence"), label.alias("label"), F.struct(*[number(f).alias(f) for f in fields], F.expr("try_variant_get(p, '$.bbox', 'array<double>')").alias("bbox")).alias("pred"))


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result that must not exist yet."""
    df.write.mode("errorifexists").format(kind).save(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """A sheet with a header that must not exist yet; arrays as words between blanks."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    df.select(*[F.array_join(c, " ").alias(c) if c in arrays else F.col(c) for c in df.columns]).write.mode("errorifexists").csv(path, header=True)


def write_report(df: DataFrame, path: str) -> None:
    """A report as one line of JSON for each row that must not exist yet."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
