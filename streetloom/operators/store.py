"""Keeping detections, the grid, hotspots and jobs as tables: latest-row upserts and pure aggregates over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import edge, grid_cell, in_bounds, steps
from ..schema import EAST, GRID_STEP, NORTH, SOUTH, WEST


def latest(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key (upsert as a view of an append log)."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def grid(spark: SparkSession, base: int = 1) -> DataFrame:
    """All cells of the service area, row by row from the south-west; edges are running sums of the step."""
    rows, columns = steps(SOUTH, NORTH), steps(WEST, EAST)
    x = spark.range(rows).select(F.col("id").cast("int").alias("r")).crossJoin(F.broadcast(spark.range(columns).select(F.col("id").cast("int").alias("c"))))
    lat, lng = edge(SOUTH, F.col("r")), edge(WEST, F.col("c"))
    return x.select(
        F.concat(F.lit("grid-"), (F.col("r") * columns + F.col("c") + base).cast("string")).alias("id"),
        (F.col("r") * columns + F.col("c")).cast("long").alias("ordinal"),
        lat.alias("lat_min"),
        F.least(lat + GRID_STEP, F.lit(NORTH)).alias("lat_max"),
        lng.alias("lng_min"),
        F.least(lng + GRID_STEP, F.lit(EAST)).alias("lng_max"),
    )


def attribute(points: DataFrame, base: int = 1) -> DataFrame:
    """``points`` and the cell that holds each: the lowest of those whose inclusive bounds hold it; null outside.

    The floor of a coordinate gives its row or column but for rounding at edges, so that one and its neighbours are held
    against the exact edges, which are literals: no join at all.
    """

    def axis(v: Column, low: float, high: float) -> Column:
        edges, at = [], low
        while at < high:
            edges.append(at)
            at += GRID_STEP
        lows, highs = F.array(*[F.lit(e) for e in edges]), F.array(*[F.lit(min(e + GRID_STEP, high)) for e in edges])
        guess = F.floor((v - low) / GRID_STEP).cast("int")
        out = F.lit(None).cast("int")
        for i in (1, 0, -1):  # the lowest that holds it is asked last and wins
            k = guess + i
            out = F.when((F.get(lows, k) <= v) & (v <= F.get(highs, k)), k).otherwise(out)
        return out

    r, c = axis(F.col("lat"), SOUTH, NORTH), axis(F.col("lng"), WEST, EAST)
    cell = F.concat(F.lit("grid-"), (r * steps(WEST, EAST) + c + base).cast("string"))
    return points.withColumn("cell", F.when(in_bounds(F.col("lat"), F.col("lng")), cell))


def cell_counts(cells: DataFrame, attributed: DataFrame) -> DataFrame:
    """Each cell with the number and last time of its detections; a recomputed aggregate, so repeats never count twice."""
    n = attributed.where("cell is not null").groupBy("cell").agg(F.count("*").alias("detection_count"), F.max("detected_at").alias("last_scanned"))
    x = cells.join(n, cells["id"] == n["cell"], "left")
    return x.select("id", F.coalesce("detection_count", F.lit(0)).alias("detection_count"), F.col("detection_count").isNotNull().alias("scanned"), "last_scanned")


def mark_scanned(cells: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    """``cells(id, scanned, last_scanned, ...)`` with those in ``ids(id)`` marked."""
    x = cells.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    new = {"scanned": F.coalesce("_hit", "scanned"), "last_scanned": F.when(F.col("_hit"), F.lit(at)).otherwise(F.col("last_scanned"))}
    return x.withColumns(new).select(*cells.columns)


def lookup(points: DataFrame, base: int = 0) -> DataFrame:
    return points.withColumn("cell", grid_cell(F.col("lat"), F.col("lng"), base))


def keep_first_seen(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Hotspots written over older ones of the same id keep ``first_seen``; others that are only old stay."""
    o = old.select("id", *[F.col(c).alias(f"_{c}") for c in old.columns if c != "id"])
    x = new.join(o, "id", "full_outer")
    fresh = F.col("score").isNotNull()
    columns = [F.when(fresh, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in new.columns if c != "id" and f"_{c}" in o.columns]
    times = [F.when(fresh, F.coalesce("_first_seen", F.lit(now))).otherwise(F.col("_first_seen")).alias("first_seen"), F.when(fresh, F.lit(now)).otherwise(F.col("_last_seen")).alias("last_seen")]
    return x.select("id", *columns, *times)


def jobs_view(log: DataFrame, key: str = "id", order: str = "at") -> DataFrame:
    """Partial updates folded: the last value of each column that is not null."""
    columns = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def live_entries(log: DataFrame, now: int) -> DataFrame:
    """(key, value, expires) of a cache's log ``(key, value, at, ttl)``: the last write of each key, if it still lives."""
    x = latest(log, ["key"], [F.desc("at")]).withColumn("expires", F.col("at") + F.col("ttl"))
    return x.where(F.col("expires") > now).select("key", "value", "expires")


def leases(claims: DataFrame, ttl: int) -> DataFrame:
    """``claims(key, at, owner)``, whole numbers as times, and ``granted``: in order of time (then owner) a claim is
    granted if the last granted one has run out, that is, started ``ttl`` before. Claims without a key or a time are not.

    Claims are dealt by ranges of key and time. Of each range it is worked out where the leases end for every time at which
    the one before it can end, which is in the first ``ttl`` of it; these are chained for each key, and every range is gone
    through once from where its first lease can start. Claims are moved three times, however many leases there are.
    """
    import numpy as np
    import pyarrow as pa

    from .graph import cut

    c = claims.select("key", "at", "owner")
    if ttl <= 0:
        return c.withColumn("granted", F.col("key").isNotNull() & F.col("at").isNotNull())
    x = cut(c.repartitionByRange("key", "at", "owner").withColumn("_part", F.spark_partition_id()))
    kind = x.schema["key"].dataType.simpleString()

    def ends(t: pa.Table) -> pa.Table:
        """Where the last lease of a range ends, for leases before it that end after the time before and by that time."""
        at = np.unique(t["at"].cast(pa.int64()).drop_null().to_numpy())
        if not len(at):
            return t.select(["key", "_part"]).slice(0, 0).append_column("by", pa.array([], pa.list_(pa.int64()))).append_column("ends", pa.array([], pa.list_(pa.int64())))
        after = np.searchsorted(at, at + ttl)
        now = np.arange(min(np.searchsorted(at, at[0] + ttl) + 1, len(at)))
        by = at[now]
        while True:
            further = after[now]
            on = further < len(at)
            if not on.any():
                break
            now = np.where(on, further, now)
        last = at[now] + ttl
        keep = np.append(last[1:] != last[:-1], True)  # those that end alike are one
        return t.select(["key", "_part"]).slice(0, 1).append_column("by", pa.array([by[keep]], pa.list_(pa.int64()))).append_column("ends", pa.array([last[keep]], pa.list_(pa.int64())))

    def chain(t: pa.Table) -> pa.Table:
        t, until, free = t.sort_by("_part"), np.iinfo(np.int64).min, []
        for by, last in zip(t["by"], t["ends"]):
            free.append(until)
            by, last = by.values.to_numpy(), last.values.to_numpy()
            i = np.searchsorted(by, until)
            until = int(last[i]) if i < len(by) else until
        return t.select(["key", "_part"]).append_column("until", pa.array(free, pa.int64()))

    def grant(t: pa.Table) -> pa.Table:
        t = t.sort_by([("at", "ascending"), ("owner", "ascending")])
        at, got = t["at"].cast(pa.int64()).drop_null().to_numpy(), np.zeros(len(t), bool)  # nulls are last
        until = t["until"][0].as_py()
        i = len(at) if until is None else int(np.searchsorted(at, until))
        while i < len(at):
            got[i] = True
            i = int(np.searchsorted(at, at[i] + ttl))
        return t.select(["key", "at", "owner"]).append_column("granted", pa.array(got))

    parts = x.where("key is not null").select("key", "_part", "at").groupBy("key", "_part").applyInArrow(ends, f"key {kind}, _part int, by array<bigint>, ends array<bigint>")
    starts = parts.groupBy("key").applyInArrow(chain, f"key {kind}, _part int, until bigint")  # a row for each key of a range
    out = x.join(starts, ["key", "_part"], "left")
    return out.groupBy("key", "_part").applyInArrow(grant, f"key {kind}, at {x.schema['at'].dataType.simpleString()}, owner {x.schema['owner'].dataType.simpleString()}, granted boolean")
