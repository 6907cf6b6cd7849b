"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Rows are grouped by the
MD5 (128 bits) of the normalised text *and* by the text itself, so Spark's hash aggregation compares bytes inside
each hash value and a collision makes two groups. The aggregation combines on the map side: a text with many copies
leaves each task once, however many rows it has. Rows then look their group up by hash alone; only hashes that
really collide (normally none) are looked up by hash and text.

Edge cases: null text counts as empty; empty and blank texts form one group; of equal texts the row with the most
code points in the original text stays, then the smallest doc_id (a null id is last); repeated (doc_id, text) rows
all count, and of such repeated rows all get the keeper's id, all are ``kept`` if theirs is the keeper's id; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The characters that normalisation deletes.
BLANKS = " \t\n\x0b\x0c\r"


def _whole(n: int) -> Column:
    """A number beyond a long."""
    return F.lit(str(n)).cast("decimal(20,0)")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def classes(docs: DataFrame) -> DataFrame:
    """One row for each distinct normalised text: h, sha, keep_id, group_size and ``twin`` (its hash has another text too)."""
    rows = docs.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("cp"),
        normalised(F.col("text")).alias("norm"),
    ).withColumn("h", F.unhex(F.md5("norm")))
    # rank: most code points first, then the smallest id; a decimal has a fixed width, so aggregation stays hash-based
    rank = F.col("cp").cast("decimal(38,0)") * _whole(2 * 10**19) + (
        _whole(2**63) - F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("decimal(20,0)")
    )
    per_text = rows.groupBy("h", "norm").agg(F.max(rank.cast("decimal(38,0)")).alias("best"), F.count("*").alias("group_size"))
    one = _whole(2 * 10**19)
    return per_text.select(
        "h",
        "norm",
        (_whole(2**63) - F.col("best") % one).cast("long").alias("keep_id"),
        "group_size",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    per_text = classes(docs)
    groups = written(
        per_text.withColumn("sha", F.sha2("norm", 256)).groupBy("h").agg(
            F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.first("sha").alias("sha")
        ),
        "exact-groups",
    )
    rows = docs.select("doc_id", F.unhex(F.md5(normalised(F.col("text")))).alias("h"))
    found = rows.join(groups.where("texts = 1").drop("texts"), "h")
    if groups.where("texts > 1").limit(1).count():  # hashes that collide: the text itself is the key
        twins = groups.where("texts > 1").select("h")
        full = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("h", F.unhex(F.md5("norm")))
        again = full.join(twins, "h").join(per_text.join(twins, "h"), ["h", "norm"]).withColumn("sha", F.sha2("norm", 256))
        found = found.unionByName(again.select(*found.columns))
    kept = F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("keep_id")
    keep_id = F.when(F.col("keep_id") < F.lit(2**63 - 1), F.col("keep_id"))
    return found.select("doc_id", keep_id.alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
