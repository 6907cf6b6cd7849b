"""A training corpus from raw documents: toxic documents go, repeated passages are cut, one document of each group of
near-duplicates stays, benchmark passages are cut, and what is left is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``docs``, with
``n_chars`` in step with the text.

Edge cases: null texts pass the first four stages unchanged; of blank documents, which all have fingerprint zero, one
stays; a document whose text was deleted entirely as a repeat of earlier ones goes, one that was empty before does not
go for that; tables without rows give results without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.llm import bpe, decontam, line_dedup, simhash, toxicity
from streetloom.llm.common import documents, spare, written

#: Blocks that an encoding worker remembers: executors have held the other stages' data before.
KEPT_BLOCKS = 1 << 16


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` as the text has them now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """2: documents that score 0.3 or more for toxicity go."""
    model = toxicity.learned(spark, docs, documents(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """6: later repeats of runs of lines are cut; a document of which nothing is left goes."""
    removed = spare(docs, "_removed")
    cut = line_dedup.line_dedup(docs, n_removed=removed)
    left = (F.col(removed) == 0) | F.col("text").rlike(f"[^{line_dedup.SPACE}]")
    return _counted(cut.where(left), docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """9: of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """5: passages of benchmark items are cut; documents that consist of them by half or more go."""
    return _counted(decontam.decontaminate(docs, documents(spark, sf_dir, "benchmark")), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """7: token ids, and a check that they decode to what the vocabulary writes for them."""
    frame = bpe.encode(docs.select("doc_id", "text"), decoded="decoded", kept=KEPT_BLOCKS)
    return frame.select("doc_id", "ids", *bpe.digests(frame))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", cut_benchmark),
    ("bpe_encoding", encode),
]

#: The first stage is learned, and fingerprints and merges are no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
