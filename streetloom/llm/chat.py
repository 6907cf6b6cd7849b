"""Chat formatting with the perspective rotated over all participants of a conversation.

For every participant (every role but ``system``) the dialogue is rendered with that speaker as the assistant and the
others as named users; the loss mask covers what the assistant says and its end mark. The result is one row per
conversation, perspective and turn: the rendered segment, where it lies in the rendered text (code points) and which
part of it is trained on (an empty span at its end if none). So no conversation has to fit one row: offsets come from a two-level scan, first inside
blocks of ``BLOCK`` turn numbers, then over block totals, and a conversation with a third of all rows spreads over its
blocks. ``examples`` joins segments to whole texts where conversations are known to fit.

Texts go in as they are: one that holds ``<|end|>`` or a role mark is not escaped, so read a rendering back by its
offsets, not by its marks. Turns of one number (null too) are one block of the scan, which is sorted and may spill;
a conversation that repeats one number in a third of all rows is one task's scan. The join to perspectives has one row
a speaker on its small side, and adaptive execution splits its large one.

Edge cases: a null text is empty; a null role is the participant ``unknown``; null turns come first; equal turns are
ordered by role and text; rows repeated in full are all rendered; a null conv_id is a conversation of its own; one
without participants gives no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents

BLOCK = 1024
END = "<|end|>\n"


def segments(turns: DataFrame) -> DataFrame:
    x = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    people = x.where("speaker <> 'system'").select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    x = x.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == "system"
    x = x.withColumn("role", F.when(own, "assistant").when(system, "system").otherwise("user")).withColumn("name", F.when(~own & ~system, F.col("speaker")))
    head = F.concat(F.lit("<|"), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("|>\n"))
    x = x.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "text", F.lit(END))).withColumn("size", F.length("segment").cast("long"))
    keys = ["conv_id", "perspective", "block"]
    inside = W.partitionBy(*keys).orderBy("turn", "speaker", "text")
    x = x.withColumn("i", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    before = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = x.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("size").alias("chars")).select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("perspective") == F.col("_perspective")) & (F.col("block") == F.col("_block"))
    x = x.join(totals, same)
    stop = F.col("chars") + F.col("upto")
    start = stop - F.col("size")
    trained = F.col("role") == "assistant"
    return x.select(
        "conv_id",
        "perspective",
        (F.col("rows") + F.col("i") - 1).alias("position"),
        "role",
        "name",
        "segment",
        start.alias("start"),
        stop.alias("stop"),
        F.when(trained, start + F.col("head")).otherwise(stop).alias("mask_start"),
        F.when(trained, stop - 1).otherwise(stop).alias("mask_stop"),
    )


def examples(found: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, masks): whole renderings with the spans (start, stop) that are trained on."""
    parts = F.array_sort(F.collect_list(F.struct("position", "segment", "mask_start", "mask_stop")))
    x = found.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: p.mask_start < p.mask_stop), lambda p: F.struct(p.mask_start.alias("start"), p.mask_stop.alias("stop")))
    return x.select("conv_id", "perspective", F.array_join("parts.segment", "").alias("text"), spans.alias("masks"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments(documents(spark, sf_dir, "conversations"))
    return found.select(*[c for c in found.columns if c != "segment"], F.sha2("segment", 256).alias("segment_sha256"))


ORACLE = r"""
WITH x AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM x WHERE speaker <> 'system'),
r AS (SELECT conv_id, perspective, turn, speaker, text,
             CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
             CASE WHEN speaker <> perspective AND speaker <> 'system' THEN speaker END AS name FROM x JOIN p USING (conv_id)),
h AS (SELECT *, '<|' || role || coalesce(' name=' || name, '') || '|>' || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
w AS (SELECT *, row_number() OVER o - 1 AS position, CAST(sum(length(segment)) OVER o AS BIGINT) AS stop FROM s
      WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, role, name, stop - length(segment) AS start, stop,
       CASE WHEN role = 'assistant' THEN stop - length(segment) + length(head) ELSE stop END AS mask_start,
       CASE WHEN role = 'assistant' THEN stop - 1 ELSE stop END AS mask_stop, sha256(segment) AS segment_sha256
FROM w
"""
