"""Graphs of links and order-dependent selections on distributed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in the folder that all machines share (``spark.checkpoint.dir``). Where it is unset, a local
    session gets a temporary one; a cluster has none that would do, so that is an error."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="streetloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` and each row's number from 1 in ``order`` over the whole table. Rows are dealt by ranges and numbered in
    each; only the counts of the ranges, one row for each, come together."""
    part, before = f"{name}_part", f"{name}_before"
    x = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))
    counts = x.groupBy(part).agg(F.count("*").alias(before))
    upto = F.coalesce(F.sum(before).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy(part).orderBy(*order))
    return x.join(F.broadcast(counts.select(part, upto.alias(before))), part).withColumn(name, (F.col(before) + inside).cast("long")).drop(part, before)


def one_to_one(pairs: DataFrame, by: list[str], left: str, right: str, order: list[Column]) -> DataFrame:
    """Rows of ``pairs`` chosen greedily in ``order`` (no two rows equal in it) so that in each group ``by`` every
    ``left`` and every ``right`` is in one at most.

    A pair that comes first both for its left and for its right is chosen whatever happens elsewhere; every round takes
    all of these at once and drops the pairs that share a side with them, which gives what going through the order
    one by one would. No group is ever one task's work.
    """
    names = pairs.columns
    rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(order)])
    lw, rw = W.partitionBy(*by, left), W.partitionBy(*by, right)
    rest, chosen = pairs.withColumn("_rank", rank), None
    while True:
        x = rest.withColumn("_l", F.min("_rank").over(lw)).withColumn("_r", F.min("_rank").over(rw))
        x = x.withColumn("_take", (F.col("_rank") == F.col("_l")) & (F.col("_rank") == F.col("_r"))).drop("_l", "_r")
        x = x.withColumn("_used", F.max("_take").over(lw) | F.max("_take").over(rw))
        x = cut(x.where("_take or not _used"))
        took = x.where("_take").select(*names)
        chosen = took if chosen is None else chosen.unionByName(took)
        rest = x.where("not _take and not _used").drop("_take", "_used")
        if not rest.limit(1).count():
            return chosen


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable. ``nodes(node)``, ``links(a, b)``.

    Labels fall to the neighbours' minimum and, by pointer jumping, to the label's own label, so rounds grow with the
    logarithm of a chain's length.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    now = cut(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        low = both.join(now.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m")).withColumnRenamed("a", "node")
        step = now.join(low, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c"), F.col("component").alias("old"))
        step = cut(step)
        jump = step.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        nxt = cut(step.join(jump, "c").select("node", F.least("c", "cc").alias("component"), "old"))
        if not nxt.where(~F.col("component").eqNullSafe(F.col("old"))).limit(1).count():
            return nxt.select("node", "component")
        now = nxt.select("node", "component")


def leaders(order: DataFrame, links: DataFrame, directed: bool = False) -> DataFrame:
    """Greedy selection in the order of ``order(node, rank)``: a row leads unless a leader of lower rank links to it.
    ``links(a, b)`` count in both directions; with ``directed`` they are ``(a, b, rb)``, each once, where b comes before a.
    Gives (node, rank, leader): the leader of lowest rank that links to a row, itself if it leads.

    A row is decided when all its earlier neighbours are; each round decides every row that can be, in parallel, and
    goes on with the undecided rows and the links between them. The number of rounds is the length of the longest chain
    of undecided dependencies, not of the table.
    """
    if directed:
        earlier = cut(links.select("a", "b", "rb"))
    else:
        both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
        ra, rb = order.select(F.col("node").alias("a"), F.col("rank").alias("ra")), order.select(F.col("node").alias("b"), F.col("rank").alias("rb"))
        earlier = cut(both.join(ra, "a").join(rb, "b").where("rb < ra").select("a", "b", "rb"))
    open_, rest, heads = order.select("node"), earlier.select("a", "b"), None
    while True:
        lead = cut(open_.join(rest.select(F.col("a").alias("node")), "node", "left_anti"))
        heads = lead if heads is None else heads.unionByName(lead)
        taken = cut(rest.join(lead.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")).distinct())
        open_ = cut(open_.join(lead, "node", "left_anti").join(taken, "node", "left_anti"))
        if not open_.limit(1).count():
            break
        gone = taken.withColumnRenamed("node", "a")
        rest = cut(rest.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti"))
    heads = heads.withColumn("leads", F.lit(True))
    of = earlier.join(heads.select(F.col("node").alias("b")), "b").groupBy("a").agg(F.min_by("b", "rb").alias("leader")).withColumnRenamed("a", "node")
    x = order.select("node", "rank").join(heads, "node", "left").join(of, "node", "left")
    return x.select("node", "rank", F.when(F.col("leads"), F.col("node")).otherwise(F.col("leader")).alias("leader"))
