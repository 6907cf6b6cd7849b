"""Labelled datasets: annotations, groups, splits, guards, quality flags and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import clip01
from .graph import components, leaders, numbered
from .spatial import radius_join


def coco_boxes(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations (pixels x, y, w, h) as corner boxes from 0 to 1, clipped; empty ones go."""
    x = annotations.join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id")
    b = [F.col("bbox")[i] for i in range(4)]
    x1, y1 = clip01(b[0] / F.col("width")), clip01(b[1] / F.col("height"))
    x2, y2 = clip01((b[0] + b[2]) / F.col("width")), clip01((b[1] + b[3]) / F.col("height"))
    return x.select("image_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).where("x2 > x1 and y2 > y1")


def must_match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that fails if a left row has no partner."""
    lost = left.join(right, on, "left_anti").limit(1).count()
    if lost:
        raise ValueError(f"rows without a partner on {on}")
    return left.join(right, on)


def duplicate_groups(files: DataFrame) -> DataFrame:
    """(group, merged): groups that share a content hash become one, named by the smallest; ``files(group, sha)``.

    Each hash links its groups to the smallest one of it: as many links as rows, not all pairs.
    """
    star = files.where("sha is not null").groupBy("sha").agg(F.min("group").alias("a")).join(files.select("sha", F.col("group").alias("b")).distinct(), "sha")
    return components(files.select(F.col("group").alias("node")), star.where("a <> b").select("a", "b")).select(F.col("node").alias("group"), F.col("component").alias("merged"))


def shuffled(key: str, seed: int) -> Column:
    """A fixed pseudo-random order of keys that other engines can repeat: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def grouped_split(groups: DataFrame, seed: int = 42, share: float = 0.15, least: int = 1) -> DataFrame:
    """(group, split): in shuffled order the first 15 % (one at least) are val, the next as many test, the rest train.
    Fewer than ``least`` groups are an error (the service wants five)."""
    names = groups.select("group").distinct()
    n = names.count()
    if n < least:
        raise ValueError(f"{n} groups are too few to split, {least} are needed")
    k = max(1, int(n * share + 0.5))
    i = F.col("_i")
    split = F.when(i <= k, "val").when(i <= 2 * k, "test").otherwise("train")
    return numbered(names, [shuffled("group", seed), F.col("group")], "_i").select("group", split.alias("split"))


def leaks(rows: DataFrame, value: str, split: str = "split") -> DataFrame:
    """Values that occur in more than one split; must be empty."""
    return rows.groupBy(value).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def kind_matrix(rows: DataFrame, kind: str, split: str, splits: list[str]) -> DataFrame:
    """Counts of each kind in each split, 0 where there is none."""
    return rows.groupBy(kind).agg(*[F.count_if(F.col(split) == s).alias(s) for s in splits])


def stratified(rows: DataFrame, strata: list[str], size: int, seed: int, key: str = "id", exclude: DataFrame | None = None) -> DataFrame:
    """About ``size`` rows: from each stratum its share, one at least, in shuffled order; keys in ``exclude`` never count."""
    if exclude is not None:
        rows = rows.join(exclude.select(key).distinct(), key, "left_anti")
    n = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_total"))
    quota = n.crossJoin(total).select(*strata, F.greatest(F.lit(1), F.rint(F.lit(size) * F.col("_n") / F.col("_total"))).cast("int").alias("_quota"))  # one row
    rank = F.row_number().over(W.partitionBy(*strata).orderBy(shuffled(key, seed), key))
    return rows.withColumn("_rank", rank).join(quota, strata).where("_rank <= _quota").drop("_rank", "_quota")


def round_robin(rows: DataFrame, by: str, order: list[Column], count: int) -> DataFrame:
    """One row of each group per pass until ``count`` are chosen."""
    x = rows.withColumn("_pass", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_pass") <= count)
    return x.orderBy("_pass", by).limit(count).drop("_pass")


def deal_out(rows: DataFrame, order: list[Column], members: int) -> DataFrame:
    """Rows in order dealt to members by turns."""
    return numbered(rows, order, "_i").withColumn("member", ((F.col("_i") - 1) % members).cast("int")).drop("_i")


def spaced(points: DataFrame, spacing_m: float, seed: int) -> DataFrame:
    """Rows of each sequence chosen greedily in shuffled order so that all are ``spacing_m`` apart; ``points(id, sequence, lat, lng)``."""
    order = points.select(F.col("id").alias("node"), F.struct(shuffled("id", seed).alias("h"), F.col("id").alias("i")).alias("rank"))
    a = points.select(F.col("id").alias("a"), F.col("sequence").alias("sa"), "lat", "lng")
    b = points.select(F.col("id").alias("b"), F.col("sequence").alias("sb"), "lat", "lng")
    links = radius_join(a, b, spacing_m + 0.5).where((F.col("sa") == F.col("sb")) & (F.rint("distance_m") < spacing_m)).select("a", "b")
    chosen = leaders(order, links).where("node = leader").select(F.col("node").alias("id"))
    return points.join(chosen, "id", "left_semi")


def location_groups(points: DataFrame, spacing_m: float) -> DataFrame:
    """(sequence, component): sequences that pass within ``spacing_m`` of each other; every third point of each counts."""
    third = points.withColumn("_i", F.row_number().over(W.partitionBy("sequence").orderBy("captured_at", "id"))).where("_i % 3 = 1")
    a, b = third.select(F.col("sequence").alias("a"), "lat", "lng"), third.select(F.col("sequence").alias("b"), "lat", "lng")
    links = radius_join(a, b, spacing_m + 0.5).where((F.col("a") < F.col("b")) & (F.rint("distance_m") < spacing_m)).select("a", "b").distinct()
    return components(points.select(F.col("sequence").alias("node")), links).select(F.col("node").alias("sequence"), "component")


def choose_validation(groups: DataFrame, target: float = 1 / 3, low: float = 0.20, high: float = 0.45) -> DataFrame:
    """The subset of groups (never the largest) whose panorama share is nearest to the target, with its region share in
    bounds and some litter view; without the bounds if none meets them. One row: the names, sorted, and the shares.

    Subsets are the numbers of a distributed range, their sums bit tests; ``groups(name, panoramas, views, litter_views, regions)``.
    """
    spark = groups.sparkSession
    rows = groups.orderBy("name").collect()  # a handful of location groups: 2**n subsets bound it
    if len(rows) < 2:
        raise ValueError("at least two groups are needed")
    largest = max(rows, key=lambda r: (r["panoramas"], r["name"]))["name"]
    free = [r for r in rows if r["name"] != largest]
    if len(free) > 30:
        raise ValueError("too many groups for an exhaustive search")

    def total(field: str) -> Column:
        return sum((F.when(F.col("id").bitwiseAND(F.lit(1 << i)) != 0, int(r[field])).otherwise(0) for i, r in enumerate(free)), F.lit(0))

    p, g = sum(r["panoramas"] for r in rows), sum(r["regions"] for r in rows)
    names = F.array_compact(F.array(*[F.when(F.col("id").bitwiseAND(F.lit(1 << i)) != 0, F.lit(r["name"])) for i, r in enumerate(free)]))
    x = spark.range(1, 1 << len(free)).select("id", (total("panoramas") / p).alias("share"), (total("regions") / (g or 1)).alias("regions"), total("litter_views").alias("litter"))
    x = x.withColumn("key", F.struct((~(F.col("regions").between(low, high) & (F.col("litter") > 0))).alias("outside"), F.abs(F.col("share") - target).alias("off"), F.bit_count("id").alias("size"), names.alias("names")))
    best = x.agg(F.min_by(F.struct("key", "share", "regions"), "key").alias("b"))
    return best.select(F.array_join("b.key.names", ",").alias("chosen"), F.col("b.share").alias("panorama_share"), F.col("b.regions").alias("region_share"), (~F.col("b.key.outside")).alias("in_bounds"))


def hamming_plan(rows: int, bits: int, distance: int) -> tuple[int, int]:
    """(blocks, agree): into how many blocks to cut the bits and how many of them two rows must share, so that keys and
    expected candidates are fewest. Of ``distance + agree`` blocks at most ``distance`` can differ."""
    from math import comb

    def cost(agree: int) -> float:
        n = distance + agree
        return comb(n, agree) * (rows + rows * rows / 2 / 2 ** (bits * agree / n))

    agree = min((k for k in (1, 2, 3) if comb(distance + k, k) <= 2_000 and distance + k <= bits), key=cost, default=1)
    return distance + agree, agree


#: Rows of a block whose hashes are compared with all of another block.
BLOCK = 20_000


def hamming_all(rows: DataFrame, count: int, distance: int, words: list[str], apart: str | None = None) -> DataFrame:
    """What ``hamming_pairs`` gives with ``sides``, from all pairs of rows: blocks of about ``BLOCK`` of the ``count`` rows are compared
    with each other, one hash with a block at a time. A worker holds two blocks; results leave it piecemeal."""
    import numpy as np
    import pyarrow as pa

    from .batches import in_groups

    n = -(-count // BLOCK) or 1
    k, m = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), F.col("other")
    x = rows.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in ("id", *words, *([apart] if apart else []))]))
    x = x.select("id", *words, *([F.col(apart).alias("apart")] if apart else []), k).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    x = x.withColumns({"i": F.least("block", m).cast("int"), "j": F.greatest("block", m).cast("int")}).drop("other")
    keep = ["id", *(["apart"] if apart else [])]

    def compare(t: pa.Table, starts: np.ndarray):  # noqa: ANN202
        hashes = [t[w].to_numpy().view(np.uint64) for w in words]
        side = t["apart"].combine_chunks().dictionary_encode().indices.to_numpy() if apart else None
        block, ids = t["block"].to_numpy(), t.select(keep)

        def found(a: list, b: list, d: list) -> pa.Table:
            a, b = ids.take(pa.array(np.concatenate(a))), ids.take(pa.array(np.concatenate(b)))
            return pa.table([*a.columns, *b.columns, pa.array(np.concatenate(d).astype(np.int32))], names=[f"a_{c}" for c in keep] + [f"b_{c}" for c in keep] + ["distance"])

        for lo, hi in zip(starts, [*starts[1:], len(t)]):
            two = int(np.searchsorted(block[lo:hi], block[hi - 1])) + lo  # the second block, or the only one
            a, b, d, held = [], [], [], 0
            for r in range(lo, two if two > lo else hi):
                first = max(two, r + 1) if two == lo else two
                bits = sum(np.bitwise_count(h[first:hi] ^ h[r]).astype(np.uint16) for h in hashes) if len(hashes) > 3 else sum(np.bitwise_count(h[first:hi] ^ h[r]) for h in hashes)
                at = np.flatnonzero(bits <= distance)
                if len(at) and side is not None:
                    at = at[side[first + at] != side[r]]
                if len(at):
                    a.append(np.full(len(at), r))
                    b.append(first + at)
                    d.append(bits[at])
                    held += len(at)
                if held > 100_000:
                    yield found(a, b, d)
                    a, b, d, held = [], [], [], 0
            if held:
                yield found(a, b, d)

    kinds = [(c, x.schema[c].dataType.simpleString()) for c in keep]
    got = in_groups(x, ["i", "j"], [F.asc("block")], compare, ", ".join([f"{s}_{c} {kind}" for s in "ab" for c, kind in kinds] + ["distance int"]), min(n * (n + 1) // 2, 2_000))
    up = F.col("a_id") < F.col("b_id")
    out = [F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "distance"]
    if apart:
        out += [F.when(up, F.col("a_apart")).otherwise(F.col("b_apart")).alias("apart_a"), F.when(up, F.col("b_apart")).otherwise(F.col("a_apart")).alias("apart_b")]
    return got.where("a_id <> b_id").select(*out)


def hamming_pairs(rows: DataFrame, distance: int, words: list[str], apart: str | None = None, plan: tuple[int, int] | None = None, sides: bool = False) -> DataFrame:
    """(a, b, distance): all pairs of ids whose hashes (given as longs of 64 bits) differ in at most ``distance`` bits;
    with ``apart``, only pairs that differ in this column (batch or split), and with ``sides`` its values as ``apart_a`` and ``apart_b``.

    The bits are cut into blocks: by the pigeonhole principle two rows within the distance share at least ``agree`` of
    ``distance + agree`` blocks, so rows are joined on choices of that many blocks, and the popcount verifies. A pair is
    given under its first common choice, which is worked out from the hashes. ``hamming_plan`` chooses how many: wide
    keys where rows are many, few where they are few. A distance that is a large part of the bits has no good choice: if
    a hundredth of all pairs or more would be candidates, all pairs are compared, which takes less (``hamming_all``).
    """
    from itertools import combinations
    from math import comb

    bits = 64 * len(words)
    count = 0 if plan else rows.count()
    blocks, agree = plan or hamming_plan(count, bits, distance)
    if not plan and 100 * comb(blocks, agree) >= 2 ** (bits * agree / blocks):
        x = hamming_all(rows, count, distance, words, apart)
        return x if sides else x.select("a", "b", "distance")
    cuts = [round(bits * i / blocks) for i in range(blocks + 1)]

    def block(i: int) -> list[tuple[str, int]]:
        parts = []
        for w, name in enumerate(words):
            lo, hi = max(cuts[i], 64 * w) - 64 * w, min(cuts[i + 1], 64 * w + 64) - 64 * w
            if lo < hi:
                mask = ((1 << (hi - lo)) - 1) << lo
                parts.append((name, mask - (1 << 64) if mask >> 63 else mask))
        return parts

    at = [block(i) for i in range(blocks)]
    choices = list(combinations(range(blocks), agree))

    def key(c: tuple[int, ...]) -> Column:
        masks: dict[str, int] = {}
        for i in c:
            for name, mask in at[i]:
                masks[name] = masks.get(name, 0) | mask
        return F.xxhash64(*[F.col(n).bitwiseAND(F.lit(m).cast("long")) for n, m in masks.items()])

    e = rows.select("id", *words, *([apart] if apart else []), F.posexplode(F.array(*[key(c) for c in choices])).alias("slot", "key"))
    a, b = e.alias("a"), e.alias("b")
    d = sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words), F.lit(0))
    same = [reduce(Column.__and__, [F.col(f"a.{n}").bitwiseXOR(F.col(f"b.{n}")).bitwiseAND(F.lit(m).cast("long")) == 0 for n, m in parts]) for parts in at]
    # choices come in order, so the first common one is that of the first blocks that are equal
    first = F.slice(F.array_compact(F.array(*[F.when(s, i) for i, s in enumerate(same)])), 1, agree)
    number = F.element_at(F.map_from_arrays(F.array(*[F.lit(",".join(map(str, c))) for c in choices]), F.array(*[F.lit(i) for i in range(len(choices))])), F.array_join(first.cast("array<string>"), ","))
    meet = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))
    if apart:
        meet = meet & (F.col(f"a.{apart}") != F.col(f"b.{apart}"))
    x = a.join(b, meet).where(d <= distance).where(number == F.col("a.slot"))
    more = [F.col(f"{s}.{apart}").alias(f"apart_{s}") for s in "ab"] if sides else []
    return x.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), d.cast("int").alias("distance"), *more)


def quality_flags(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """(image, flags): what is odd about each image and its boxes (pixels x, y, w, h), in a fixed order.

    Of the image, where it has the columns: a size other than the annotated one (``real_width``, ``real_height``), an
    ``orientation`` other than 1, a ``mode`` other than RGB. Of boxes: outside or empty (half a pixel of slack on the
    right and below), under two pixels (both can be), pairs that are almost equal, none at all.
    ``images(image, width, height)``, ``boxes(image, idx, x, y, w, h)``.
    """
    from ..functions.boxes import from_xywh, iou

    have = set(images.columns)
    real = [F.col(c if c in have else o) for c, o in (("real_width", "width"), ("real_height", "height"))]
    kind = boxes.schema["idx"].dataType

    def flag(order: int, text: Column, idx: Column | None = None) -> Column:
        none = F.lit(0).cast(kind)
        return F.struct(F.lit(order).alias("o"), (none if idx is None else idx).alias("idx"), none.alias("other"), text.alias("f"))

    of_image = [F.when((real[0] != F.col("width")) | (real[1] != F.col("height")), flag(0, F.lit("size differs from annotation")))]
    if "orientation" in have:
        of_image.append(F.when(F.col("orientation") != 1, flag(1, F.concat(F.lit("EXIF orientation "), F.col("orientation").cast("string")))))
    if "mode" in have:
        of_image.append(F.when(F.col("mode") != "RGB", flag(2, F.concat(F.lit("mode "), "mode"))))
    found = [images.select("image", F.explode(F.array_compact(F.array(*of_image))).alias("s"))]
    x, y, w, h, idx = (F.col(c) for c in ("x", "y", "w", "h", "idx"))
    outside = (w <= 0) | (h <= 0) | (x < 0) | (y < 0) | (x + w > F.col("_rw") + 0.5) | (y + h > F.col("_rh") + 0.5)
    name = lambda text: F.concat(F.lit("box "), idx.cast("string"), F.lit(text))
    of_box = F.array_compact(F.array(F.when(outside, flag(3, name(" outside or empty"), idx)), F.when(F.least(w, h) < 2, flag(4, name(" under 2px"), idx))))
    j = boxes.join(images.select("image", real[0].alias("_rw"), real[1].alias("_rh")), "image")
    found.append(j.select("image", F.explode(of_box).alias("s")))
    a, b = boxes.alias("a"), boxes.alias("b")
    over = iou(from_xywh(*[F.col(f"a.{c}") for c in "xywh"]), from_xywh(*[F.col(f"b.{c}") for c in "xywh"]))
    twins = a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.idx") < F.col("b.idx"))).where(over > 0.9)
    pair = F.concat(F.lit("boxes "), F.col("a.idx").cast("string"), F.lit(" and "), F.col("b.idx").cast("string"), F.lit(" nearly equal"))
    found.append(twins.select(F.col("a.image").alias("image"), F.struct(F.lit(5).alias("o"), F.col("a.idx").alias("idx"), F.col("b.idx").alias("other"), pair.alias("f")).alias("s")))
    found.append(images.join(boxes, "image", "left_anti").select("image", flag(6, F.lit("no boxes")).alias("s")))
    return reduce(DataFrame.unionByName, found).groupBy("image").agg(F.array_sort(F.collect_list("s")).getField("f").alias("flags"))


def quality_report(boxes: DataFrame, images: DataFrame, size: int, seed: int, cross_split: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, queue): each image with all its flags, and the images to look at.

    To ``quality_flags`` come, where ``images`` has the columns, a missing ``source_url`` and a ``sharpness`` in the
    lowest twentieth; and for both images of each ``cross_split(a, b, distance)`` that they may be related. The queue
    has every image with a flag other than ``no boxes``, and of the others a sample of ``size`` over split and median
    box size (``images.split``); its reason is the flags or ``stratified sample``.
    """
    from ..functions.boxes import short_side_px

    have = set(images.columns)
    found = [quality_flags(boxes, images).select("image", F.posexplode("flags").alias("o", "f"))]
    extra = lambda rows, order, text: found.append(rows.select("image", F.lit(order).alias("o"), text.alias("f")))
    if "source_url" in have:
        extra(images.where(F.coalesce(F.trim("source_url"), F.lit("")) == ""), 10**6, F.lit("missing source URL"))
    if "sharpness" in have:
        floor = images.agg(F.percentile("sharpness", 0.05).alias("_floor"))  # one row
        extra(images.crossJoin(floor).where("sharpness < _floor"), 10**6 + 1, F.lit("sharpness in lowest 5% (review)"))
    if cross_split is not None:
        both = cross_split.select("a", "b", "distance", F.explode(F.array("a", "b")).alias("image"))
        text = F.concat(F.lit("possible related image across splits: "), F.col("a").cast("string"), F.lit("/"), F.col("b").cast("string"), F.lit(" (distance "), F.col("distance").cast("string"), F.lit(")"))
        extra(both, 10**6 + 2, text)
    flags = reduce(DataFrame.unionByName, found).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("o", "f"))).getField("f").alias("flags"))
    records = images.join(flags, "image", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    sides = boxes.join(images.select("image", "width", "height"), "image").groupBy("image").agg(F.median(F.round(short_side_px(F.col("w"), F.col("h"), F.col("width"), F.col("height")), 1)).alias("_median"))
    m = F.coalesce("_median", F.lit(0.0))
    records = records.join(sides, "image", "left").withColumn("size_class", F.when(m < 16, "<16").when(m < 32, "16-32").otherwise(">=32")).drop("_median")
    flagged = records.where(F.exists("flags", lambda f: ~f.startswith("no boxes"))).select("image")
    sample = stratified(records, ["split", "size_class"], size, seed, "image", flagged).select("image")
    queue = records.join(flagged.unionByName(sample).distinct(), "image", "left_semi")
    reason = F.when(F.size("flags") > 0, F.array_join("flags", "; ")).otherwise("stratified sample")
    return records, queue.select("image", "split", reason.alias("reasons"))


def with_licence(images: DataFrame, licences: DataFrame, credits: DataFrame) -> DataFrame:
    """Images with their licence by number and their credit by id; defaults where there is none."""
    x = images.join(licences.select(F.col("id").alias("license"), F.col("name").alias("_name")), "license", "left")
    x = x.join(credits.select("image", F.col("credit").alias("_credit")), "image", "left")
    return x.withColumns({"license_name": F.coalesce("_name", F.lit("unknown")), "credit": F.coalesce("_credit", F.lit(""))}).drop("_name", "_credit")


def group_statistics(views: DataFrame) -> DataFrame:
    """(name, panoramas, views, litter_views, regions) of ``views(name, panorama, litter, regions)``."""
    return views.groupBy("name").agg(F.countDistinct("panorama").alias("panoramas"), F.count("*").alias("views"), F.count_if("litter").alias("litter_views"), F.sum("regions").alias("regions"))


def flag_counts(flags: DataFrame) -> DataFrame:
    """Kinds of flags (what comes before a colon or a bracket) by falling count."""
    kind = F.split(F.split(F.col("flag"), ":")[0], r" \(")[0]
    return flags.select(F.explode("flags").alias("flag")).groupBy(kind.alias("kind")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "kind")


def verify_lock(lock: DataFrame, current: DataFrame) -> DataFrame:
    """Files of a lock that are missing or whose hash has changed; ``(file, sha)`` on both sides."""
    x = lock.join(current.withColumnRenamed("sha", "now"), "file", "left")
    return x.where(~F.col("sha").eqNullSafe(F.col("now"))).select("file", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("problem"))


def pair_audit(images: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Per split: pairs, images without a label, labels without an image."""
    x = images.select(*on, F.lit(1).alias("i")).join(labels.select(*on, F.lit(1).alias("l")), on, "full_outer")
    return x.groupBy(on[0]).agg(F.count_if(F.expr("i is not null and l is not null")).alias("pairs"), F.count_if(F.expr("l is null")).alias("without_label"), F.count_if(F.expr("i is null")).alias("without_image"))


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """The url's host is one of ``hosts`` or below it."""
    h = F.lower(F.parse_url(url, F.lit("HOST")))
    out = F.lit(False)
    for x in hosts:
        out = out | (h == x) | h.endswith(f".{x}")
    return F.coalesce(out, F.lit(False))
