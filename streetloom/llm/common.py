"""Small helpers that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Bytes and rows of one Arrow batch: texts have no length limit, so bytes bound what a Python worker holds at once.
ARROW_BYTES, ARROW_ROWS = 1 << 19, 10_000


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """Read one table of ``sf_dir`` through Spark, whatever store it lies in."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Get ready for Arrow functions: bound batches by bytes, send the modules out. The settings are read when a plan
    runs, so all operators set the same ones."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % n, F.lit(-1)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary
    one; a cluster has none that would do, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="streetloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there, and lost executors take nothing along."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` and further fields of (name, type)."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])
