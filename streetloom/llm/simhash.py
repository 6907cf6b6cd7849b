r"""SimHash near-duplicates: fingerprints, pivot distance tables, connected components.

Fingerprint: A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, 4-word shingles with repeats, XXH64 (seed 42) of each; a
bit is 1 if it is set in over half of the hashes. Fingerprints link at 4 or fewer differing bits.

Equal fingerprints become one before anything is compared, so exact copies cost one row. A pivot table alone prunes
but does not group, so pairs are met in buckets: of ``blocks`` blocks of the fingerprint two within 4 bits have
at least ``blocks - 4`` equal, so every linked pair meets in a bucket for some choice of that many blocks (no pair is
lost). Every pair that meets goes through the pivot table: the Hamming distances of each fingerprint to ``PIVOTS``
reference fingerprints, taken from the data and far apart. By the triangle inequality a pair whose distances to any
pivot differ by more than 4 cannot link and is discarded; the XOR verifies the survivors. A task computes the table for
the rows of each batch once (16 bytes a row cost less to compute than to shuffle); in large buckets rows are sorted by
the first pivot, so only windows of that coordinate are looked at. ``discards`` counts pairs met, discarded and linked.
A task keeps a union-find over what it has seen and emits a spanning forest, never all pairs of a group.

Buckets with more than ``CHUNK`` fingerprints are cut by hash into chunks, and every pair of chunks is a bucket of its
own: no task holds more than two chunks, whatever the size of a group. Components come from rounds of large-star and
small-star over the forest edges, each written to the shared folder.

Edge cases: a text with fewer words than a shingle is one shingle; null, empty and blank texts have fingerprint zero
and link like any other; repeated rows share a component; null ids are ignored when the smallest id is sought (null
if there is no other); an empty table gives an empty result; other columns pass through, but one named like the output
is replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, documents, with_fields, written

SHINGLE, SEED, BITS = 4, 42, 4
BLOCKS = 6
PIVOTS = 16
#: Fingerprints among which pivots are chosen (smallest hash first); any choice gives the same links.
PIVOT_SAMPLE = 2_048
#: Buckets up to this size are compared by columns of pairs, larger ones by windows of the first pivot.
SMALL = 8
CHUNK = 4096
#: A-Z to a-z, the six white space characters to a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_PARTS = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    n, seed = len(words) - k + 1, SEED
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _PARTS):  # long texts part by part
        a, b = starts[i : min(n, i + _PARTS)].tolist(), ends[i + k - 1 : min(n, i + _PARTS) + k - 1].tolist()
        h = np.fromiter([xxh64_intdigest(data[x:y], seed) for x, y in zip(a, b)], np.uint64, len(a))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` and the fingerprint of each text as a (signed) long; the text stays."""
    arrow_batches(docs.sparkSession)
    docs = docs.drop(out)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(text).to_pylist()], np.uint64)
            yield batch.append_column(out, pa.array(fps.view(np.int64), pa.int64()))

    return docs.mapInArrow(run, with_fields(docs, (out, "long")))


def block_masks(blocks: int = BLOCKS, bits: int = BITS) -> list[int]:
    """Masks that keep ``blocks - bits`` of the blocks of 64 bits; two numbers within ``bits`` agree under one of them."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(masks, blocks - bits)]


def chosen_pivots(fps: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` fingerprints of ``fps``, each as far as can be from those before it."""
    got = fps.select("fp").where("fp is not null").orderBy(F.xxhash64("fp"), "fp").limit(PIVOT_SAMPLE).collect()
    sample = np.array([r["fp"] for r in got], np.int64).view(np.uint64)
    out, far = [], np.full(len(sample), 65)
    while len(out) < min(n, len(sample)):
        out.append(sample[int(far.argmax())])
        far = np.minimum(far, np.bitwise_count(sample ^ out[-1]))
    return np.array(out or [0], np.uint64)


class Forest:
    """Union-find over the fingerprints of one task; ``edges`` are the unions that joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


class Sweep:
    """One task's buckets: every pair that meets is held against the pivot table, survivors against the XOR."""

    def __init__(self, pivots: np.ndarray, bits: int = BITS):
        self.pivots, self.bits, self.forest = pivots, bits, Forest()
        self.met = self.discarded = self.linked = 0

    def table(self, fps: np.ndarray) -> np.ndarray:
        """Hamming distances of each fingerprint to the pivots."""
        return np.bitwise_count(fps[:, None] ^ self.pivots[None, :]).astype(np.int8)

    def pairs(self, a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray) -> None:
        near = (np.abs(ta - tb) <= self.bits).all(axis=1)
        a, b = a[near], b[near]
        link = np.bitwise_count(a ^ b) <= self.bits
        self.discarded += len(near) - len(a)
        self.linked += int(link.sum())
        for x, y in zip(a[link].tolist(), b[link].tolist()):
            self.forest.join(x, y)

    def same_size(self, fps: np.ndarray, table: np.ndarray) -> None:
        """Buckets of one size: (buckets, size) fingerprints and their table."""
        m, size = fps.shape
        self.met += m * size * (size - 1) // 2
        for i in range(size):
            for j in range(i + 1, size):
                self.pairs(fps[:, i], fps[:, j], table[:, i], table[:, j])

    def large(self, fps: np.ndarray) -> None:
        table = self.table(fps)
        order = np.argsort(table[:, 0], kind="stable")
        fps, table = fps[order], table[order]
        n = len(fps)
        self.met += n * (n - 1) // 2
        ends = np.searchsorted(table[:, 0], table[:, 0] + self.bits, side="right")
        self.discarded += int((n - ends).sum())  # beyond the window of the first pivot
        for i in range(n - 1):
            k = slice(i + 1, ends[i])
            if i + 1 < ends[i]:
                self.pairs(np.broadcast_to(fps[i], ends[i] - i - 1), fps[k], table[i : i + 1], table[k])

    def bucket(self, fps: np.ndarray) -> None:
        if len(fps) > SMALL:
            self.large(fps)
        elif len(fps) > 1:
            self.same_size(fps[None, :], self.table(fps)[None])

    def buckets(self, fps: np.ndarray, cuts: np.ndarray) -> None:
        """Whole buckets that begin at ``cuts`` (the last cut is the end)."""
        sizes = np.diff(cuts)
        for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
            rows = cuts[:-1][sizes == size][:, None] + np.arange(size)
            self.same_size(fps[rows], self.table(fps[rows].ravel()).reshape(*rows.shape, -1))
        for k in np.flatnonzero(sizes > SMALL):
            self.large(fps[cuts[k] : cuts[k + 1]])


def edges(fps: DataFrame, blocks: int = BLOCKS, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """Spanning edges (a, b) between the distinct longs in column ``fp`` that are within ``bits`` of each other."""
    return _swept(fps, blocks, bits, chunk, counts=False)


def discards(fps: DataFrame, blocks: int = BLOCKS, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """One row: pairs that met in buckets, those that the pivot table discarded, those within ``bits`` (a pair counts
    in each bucket where it meets)."""
    names = ("met", "discarded", "linked")
    return _swept(fps, blocks, bits, chunk, counts=True).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def _swept(fps: DataFrame, blocks: int, bits: int, chunk: int, counts: bool) -> DataFrame:
    spark = fps.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(chosen_pivots(fps))
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, bits)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)]))
    rows = fps.select("fp", keys.alias("k")).select("fp", "k.mask", "k.key")
    large = rows.groupBy("mask", "key").count().where(F.col("count") > chunk).select("mask", "key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    large = written(large, "simhash-large")  # at most one row for each `chunk` rows; mostly none
    if large.limit(1).count():
        rows = rows.join(large, ["mask", "key"], "left")
        own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
        # chunk c meets every chunk d: the pair bucket (min, max)
        pair = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("c"), F.lit(0).alias("d")))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda d: F.struct(F.least(own, d).alias("c"), F.greatest(own, d).alias("d")))
        )
        rows = rows.select("mask", "key", "fp", F.explode(pair).alias("p")).select("mask", "key", "p.c", "p.d", "fp")
    else:
        rows = rows.select("mask", "key", F.lit(0).alias("c"), F.lit(0).alias("d"), "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "mask", "key", "c", "d").sortWithinPartitions("mask", "key", "c", "d")

    def run(batches):
        sweep, rest, last = Sweep(shared.value, bits), [], None
        found, emitted = sweep.forest.edges, 0
        for batch in batches:
            cols = [np.asarray(batch.column(c)) for c in ("mask", "key", "c", "d")]
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            if not len(fp):
                continue
            new = np.zeros(len(fp), bool)
            new[0] = last is None or last != tuple(int(c[0]) for c in cols)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = np.flatnonzero(new)
            if not len(cuts):
                rest.append(fp)
            else:  # the bucket under way ends, the last one may go on in the next batch
                sweep.bucket(np.concatenate([*rest, fp[: cuts[0]]]))
                sweep.buckets(fp, cuts)
                rest = [fp[cuts[-1] :]]
            last = tuple(int(c[-1]) for c in cols)
            if not counts and len(found) - emitted > 10_000:
                yield _edge_batch(found[emitted:])
                emitted = len(found)
        if rest:
            sweep.bucket(np.concatenate(rest))
        if counts:
            yield pa.RecordBatch.from_pydict({c: pa.array([getattr(sweep, c)], pa.int64()) for c in ("met", "discarded", "linked")})
        else:
            yield _edge_batch(found[emitted:])

    return dealt.mapInArrow(run, "met long, discarded long, linked long" if counts else "a long, b long")


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the smallest node reachable. Large-star and small-star
    rounds on distributed edges until nothing changes; the smallest neighbour is an aggregation that combines on the
    map side, and joins with it can be split, so a node with very many neighbours is no single task's work."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e has u > v. large: all neighbours, keep those above u; small: neighbours below u and u itself
        both = e.union(e.select("v", "u")).toDF("u", "v") if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        if large:
            out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = both.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u > v").distinct()

    e = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "star")
    state = None
    for _ in range(100):
        e = written(star(star(e, True), False), "star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        # a fixed point of both steps is a forest of stars
        if tuple(now) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        state = tuple(now)
    raise RuntimeError("components did not settle")


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    marked = written(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "simhash-fps")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(edges(distinct.select("fp"), blocks))
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    names = of.join(least, "root").select("fp", "component_id")
    return marked.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. Rows that repeat this id all stay,
    as do rows without an id, which nothing can name."""
    found = near_dedup(docs, text, id_col).where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_semi").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
