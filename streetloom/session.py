"""Sessions with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster the master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName("streetloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each application, so that Python workers find them
    wherever the driver was started. The archive is served by the driver; nothing depends on shared local paths."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import tempfile
    import zipfile
    from pathlib import Path

    here = Path(__file__).resolve().parent
    if not here.is_dir():  # already from an archive
        return
    target = Path(tempfile.mkdtemp(prefix="streetloom-")) / "streetloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"streetloom/{f.relative_to(here)}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
