r"""Benchmark decontamination with a broadcast set of normalised n-gram hashes.

A-Z are lower-cased; words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. A window is 10 consecutive words of an item; an
item of fewer words, but not none, is one window. The driver numbers the words of the benchmark and makes the set of
window hashes, sorted, with the windows themselves and the items they are of; this is broadcast, and no worker builds it
again. A worker turns a document into an array of numbers (0: not a benchmark word), hashes all its windows at once,
looks them up in the set and compares the words of every hit with the windows of that hash.

A set holds at most ``block_words`` benchmark words (about 150 bytes a word on the driver and in a worker) and one item
at least. A larger benchmark is taken block by block, each against all documents; the hits are gathered in a column
and written to the shared folder between blocks, so one set at a time is in memory, and no shuffle is needed at any size.

Edge cases: null or wordless texts have no words and no hits; null or wordless items have no window; items with
equal texts all count; a null item_id counts as the empty string; rows are handled one by one, so repeated rows and
ids give repeated results; empty tables give empty results or no hits; other columns pass through, but one named
like the output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, documents, spare, written

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: A-Z to a-z, everything that is no word byte to a blank.
_TABLE = bytes(
    (b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if text else []


def words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


def _hashes(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each row of ``at``, places in ``ids`` (in each row of ``ids`` if it has rows)."""
    out = np.zeros(len(ids) if ids.ndim == 2 else len(at), np.uint64)
    for k in range(at.shape[1]):
        out = out * _BASE + (ids[:, k] if ids.ndim == 2 else ids[at[:, k]])
    return out


class Index:
    """The windows of one block of benchmark items, by length: hashes in order, words, items."""

    def __init__(self, items: list[tuple[str, str]], n: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        owners: dict[tuple, set] = {}
        for item, text in items:
            seq = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words(text))
            for i in range(max(1, len(seq) - n + 1)) if seq else ():
                owners.setdefault(seq[i : i + n], set()).add(at[item])
        self.by_length = {}
        for k in sorted({len(w) for w in owners}):
            windows = [w for w in owners if len(w) == k]
            rows = np.array(windows, np.int32).reshape(-1, k)
            keys = _hashes(rows.astype(np.uint64), np.arange(k)[None, :])
            order = np.argsort(keys, kind="stable")
            found = [sorted(owners[windows[i]]) for i in order]
            ends = np.cumsum([0, *map(len, found)])
            self.by_length[k] = keys[order], rows[order], ends, np.array([x for f in found for x in f], np.int32)

    def hits(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """How many words there are, the numbers of those inside an occurrence of a window, the items these windows are of."""
        tokens = words(text)
        found: set = set()
        ids = np.fromiter(map(self.number.get, tokens, [0] * len(tokens)), np.uint64, len(tokens))
        hit = np.zeros(len(ids) + 1, np.int32)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for n, (keys, rows, ends, owners) in self.by_length.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            h = _hashes(ids, at[:, None] + np.arange(n)[None, :])
            first, last = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            for j in np.flatnonzero(first < last).tolist():
                i = int(at[j])
                for k in range(int(first[j]), int(last[j])):
                    if (rows[k] == ids[i : i + n]).all():
                        hit[i] += 1
                        hit[i + n] -= 1
                        found.update(owners[ends[k] : ends[k + 1]].tolist())
        return len(tokens), np.flatnonzero(np.cumsum(hit[:-1])), {self.names[i] for i in found}


def _blocks(bench: DataFrame, block_words: int):
    """The index of at most ``block_words`` words at a time; items stream to the driver."""
    block, size, made = [], 0, False
    for row in bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).toLocalIterator():
        n = len(words(row[1]))
        if block and size + n > block_words:
            yield Index(block)
            block, size, made = [], 0, True
        block.append((row[0], row[1]))
        size += n
    if block or not made:
        yield Index(block)


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS, out: str = "hits") -> DataFrame:
    """``docs`` and a column ``out``: struct(n_words, words array<int> that are hit, items array<string>)."""
    return _scanned(docs, bench, text, block_words, out)


def _scanned(docs: DataFrame, bench: DataFrame, text: str, block_words: int, out: str, finish=None) -> DataFrame:
    """``docs`` with the hits; ``finish(batch, hits)`` may make something else of a batch, in the same worker."""
    spark = docs.sparkSession
    arrow_batches(spark)
    kind = "n_words bigint, words array<int>, items array<string>"
    df = docs.withColumn(out, F.expr(f"cast(null as struct<{kind.replace(' bigint', ':bigint').replace(' array', ':array')}>)"))
    kinds = pa.struct([("n_words", pa.int64()), ("words", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
    indexes, shared = _blocks(bench, block_words), None
    index = next(indexes)
    while index is not None:
        if shared is not None:  # the hits of the block before are there before this one is sent out
            df = written(df, "decontamination")
            shared.unpersist()
        shared, index = spark.sparkContext.broadcast(index), next(indexes, None)
        done = finish if index is None else None

        def scan(batches, shared=shared, done=done):
            index = shared.value
            for batch in batches:
                made = []
                for t, b in zip(batch.column(text), batch.column(out)):
                    n, at, items = index.hits(t.as_py())
                    before = b.as_py() or {"words": [], "items": []}
                    made.append({"n_words": n, "words": sorted({*at.tolist(), *before["words"]}), "items": sorted({*items, *before["items"]})})
                k = batch.schema.get_field_index(out)
                yield done(batch.drop_columns([out]), made) if done else batch.set_column(k, out, pa.array(made, kinds))

        df = df.mapInArrow(scan, docs.schema if done else df.schema)
    return df


def _without(text: str, gone: set[int]) -> str:
    """``text`` without the words numbered in ``gone`` and the separators between two of them."""
    data = text.encode("utf-8", "surrogatepass")
    mapped = data.translate(_TABLE)
    spans, pos, number = [], 0, 0
    for w in mapped.split(b" "):
        if w:
            if number in gone:
                if spans and spans[-1][2] == number - 1:
                    spans[-1] = (spans[-1][0], pos + len(w), number)
                else:
                    spans.append((pos, pos + len(w), number))
            number += 1
        pos += len(w) + 1
    keep, last = [], 0
    for a, b, _ in spans:
        keep.append(data[last:a])
        last = b
    return b"".join([*keep, data[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", drop_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the hit spans; documents of which at least ``drop_share`` of the words is hit go altogether."""
    def cut(batch, made):
        k = batch.schema.get_field_index(text)
        stays = [not h["words"] or len(h["words"]) < h["n_words"] * drop_share for h in made]
        new = [_without(t, set(h["words"])) if t and h["words"] and ok else t for t, h, ok in zip(batch.column(k).to_pylist(), made, stays)]
        return batch.set_column(k, batch.schema.field(k), pa.array(new, pa.string())).filter(pa.array(stays, pa.bool_()))

    return _scanned(docs, bench, text, block_words, spare(docs, "_hits"), cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = contamination(docs, documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.size("hits.words").cast("long").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.size("hits.words") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
       FROM (SELECT item, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, s)),
p AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
