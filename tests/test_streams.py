"""Streams with state: entries with a time to live, revisions."""

import datetime as dt

from streetloom.streaming import state


def run(spark, rows, schema, make, path, name):
    """One file for each batch of rows; the rows that each batch gives."""
    out = []
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        q = (
            make(spark.readStream.schema(schema).parquet(f"{path}/in"))
            .writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect()))
            .option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
        )
        q.awaitTermination()
    return out


def test_entries_expire_and_later_writes_count(spark, tmp_path):
    t = lambda s: dt.datetime.fromtimestamp(1_700_000_000 + s, dt.timezone.utc).replace(tzinfo=None)
    rows = [
        [("a", "one", t(0), 100), ("a", "two", t(10), 100), ("b", "x", t(5), 20)],
        [("c", "y", t(60), 600)],
        [("c", "z", t(400), 600)],
        [("d", "w", t(401), 1)],
    ]
    got = run(spark, rows, "key string, value string, at timestamp_ltz, ttl_seconds long", state.live_entries, tmp_path, "ttl")
    puts, gone = [r for r in got if r[3] == "put"], [r for r in got if r[3] == "expired"]
    at = lambda s: 1_700_000_000 + s
    assert ("a", "two", at(110), "put") in puts and ("b", "x", at(25), "put") in puts and ("c", "z", at(1000), "put") in puts
    assert not any(r[1] == "one" for r in puts)
    assert {r[:3] for r in gone} >= {("b", "x", at(25)), ("a", "two", at(110))} and not any(r[0] == "c" for r in gone)


def test_saves_on_an_old_revision_are_refused(spark, tmp_path):
    rows = [[("v", 0, "ann", 1), ("v", 0, "bo", 2), ("w", 1, "bo", 3)], [("v", 1, "bo", 4), ("v", 1, "ann", 5), ("w", 0, "bo", 6)]]
    got = run(spark, rows, "view string, base long, reviewer string, at long", state.revisions, tmp_path, "revisions")
    assert set(got) == {
        ("v", 1, "ann", True, 1), ("v", 0, "bo", False, 1), ("w", 1, "bo", False, 0),
        ("v", 2, "bo", True, 2), ("v", 1, "ann", False, 2), ("w", 1, "bo", True, 1),
    }
