"""Every registered query runs; those with SQL agree with DuckDB on the small tables; streams equal batches."""

import os

import pytest
from pyspark.sql import functions as F

from streetloom.operators import hotspots
from streetloom.plans.registry import ORACLES, QUERIES
from streetloom.sources.fixtures import AS_OF, detections
from streetloom.streaming import incremental

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    want = sorted(duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({ORACLES[name]})").fetchall(), key=key)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    assert got == want
    assert got or name in ("near_duplicate_boxes", "clear_windows", "radius_pairs", "hamming_pairs", "nearby_radius")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_bootstrap_resamples_as_often_as_the_operator(spark):
    assert {r["rounds"] for r in QUERIES["bootstrap_ci"](spark, SF).collect()} == {2000}


def test_cross_view_nms_keeps_the_panoramas(spark):
    got = {r["image_id"] for r in QUERIES["cross_view_nms"](spark, SF).collect()}
    assert got == {r["image_id"] for r in detections(spark, SF).select("image_id").distinct().collect()}


def test_sharpness_rounds_products_as_the_sql_does(spark, tmp_path):
    import duckdb

    # the nearest single number to 0.29 lies below it; its product with 100 is 29 in single precision and less in double
    rows = [(k, [0.29 if i % 7 == k else i / 100 for i in range(64)]) for k in range(7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = ORACLES["sharpness"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {(r["id"], r["sharpness_micro"]) for r in QUERIES["sharpness"](spark, str(tmp_path)).collect()}
    assert got == set(duckdb.sql(sql).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1 and set(QUERIES) <= set(entry.queries())


def test_streams_equal_batches(spark, tmp_path):
    rows = detections(spark, SF)
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = incremental.cell_counts(stream()).writeStream.outputMode("complete").format("memory").queryName("cells").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("cells").collect())
    assert got == sorted(tuple(r) for r in incremental.cell_counts(rows).collect())
    q = incremental.refresh_hotspots(stream(), f"{tmp_path}/store", f"{tmp_path}/hot", AS_OF, f"{tmp_path}/ck")
    q.awaitTermination()
    x = spark.read.parquet(f"{tmp_path}/hot").select(F.count("*"), F.sum("detection_count")).first()
    assert tuple(x) == (hotspots.cluster(rows).select("leader").distinct().count(), rows.count())
    q = incremental.daily(stream()).writeStream.outputMode("append").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.table("days").count() <= 30
