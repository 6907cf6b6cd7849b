"""Dataset queries: duplicates, splits, samples, flags, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset, derive, diagnose
from ..operators.graph import cut
from ..sources import files
from ..sources.fixtures import DET_SQL, PANO_SQL, detections, panoramas, table
from .base import leaders_sql, query
from .places import hav

FILES_SQL = "files AS (SELECT doc_id AS id, source AS grp, sha256(text) AS sha FROM documents)"
PWITH = f"WITH RECURSIVE {DET_SQL}, {PANO_SQL}"


def _files(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group"), F.sha2("text", 256).alias("sha"))


@query(f"WITH {FILES_SQL} SELECT sha, count(*) AS files, count(DISTINCT grp) AS \"groups\", min(id) AS first FROM files GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return _files(spark, d).groupBy("sha").agg(F.count("*").alias("files"), F.countDistinct("group").alias("groups"), F.min("id").alias("first")).where("files > 1")


@query(
    f"WITH RECURSIVE {FILES_SQL}, f AS (SELECT DISTINCT id % 200 AS g, sha FROM files), e AS (SELECT DISTINCT a.g AS a, b.g AS b FROM f a JOIN f b USING (sha) WHERE a.g <> b.g), "
    "r AS (SELECT DISTINCT g AS n, g AS c FROM f UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n) SELECT n AS \"group\", min(c) AS merged FROM r GROUP BY 1"
)
def connected_components(spark, d):
    x = _files(spark, d).select((F.col("id") % 200).alias("group"), "sha")
    return dataset.duplicate_groups(x)


#: The signs of all 64 numbers as one word; the first is the sign bit.
_BITS = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {-(1 << 63) if i == 0 else 1 << (63 - i)} ELSE 0 END)::BIGINT" for i in range(64))
_HASH_SQL = f"h AS (SELECT vec_id AS id, 'b' || label AS batch, CASE WHEN vec_id % 5 = 0 THEN 'val' WHEN vec_id % 5 = 1 THEN 'test' ELSE 'train' END AS split, {_BITS} AS w FROM embeddings)"


def _hashes(spark, d):
    bit = lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(F.when(v > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    v = F.col("vec_id")
    split = F.when(v % 5 == 0, "val").when(v % 5 == 1, "test").otherwise("train")
    return table(spark, d, "embeddings").select(v.alias("id"), F.concat(F.lit("b"), F.col("label").cast("string")).alias("batch"), split.alias("split"), F.aggregate("embedding", F.lit(0).cast("long"), bit).alias("w"))


@query(f"WITH {_HASH_SQL} SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.w, b.w)) AS INT) AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.w, b.w)) <= 18")
def hamming_pairs(spark, d):
    return dataset.hamming_pairs(_hashes(spark, d), 18, ["w"])


@query(f"WITH {_HASH_SQL} SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.w, b.w)) AS INT) AS distance FROM h a JOIN h b ON a.id < b.id AND a.batch <> b.batch WHERE bit_count(xor(a.w, b.w)) <= 18")
def hamming_cross_group(spark, d):
    """Pairs of different batches only."""
    return dataset.hamming_pairs(_hashes(spark, d), 18, ["w"], apart="batch")


@query(f"WITH {_HASH_SQL} SELECT a.id AS a, b.id AS b, a.split || '/' || b.split AS splits, CAST(bit_count(xor(a.w, b.w)) AS INT) AS distance FROM h a JOIN h b ON a.id < b.id AND a.split <> b.split WHERE bit_count(xor(a.w, b.w)) <= 18")
def hamming_cross_split(spark, d):
    """Pairs of different splits only: possible leaks, the nearest first."""
    x = cut(dataset.hamming_pairs(_hashes(spark, d), 18, ["w"], apart="split", sides=True))  # the order reads it twice
    return x.select("a", "b", F.concat_ws("/", "apart_a", "apart_b").alias("splits"), "distance").orderBy("distance", "a", "b")


@query(
    "WITH g AS (SELECT DISTINCT source AS g FROM documents), r AS (SELECT g, row_number() OVER (ORDER BY md5('42:' || g), g) AS i, greatest(1, CAST(floor(count(*) OVER () * 0.15::DOUBLE + 0.5) AS INT)) AS k FROM g) "
    "SELECT g AS \"group\", CASE WHEN i <= k THEN 'val' WHEN i <= 2 * k THEN 'test' ELSE 'train' END AS split FROM r"
)
def grouped_split(spark, d):
    return dataset.grouped_split(_files(spark, d).select("group"))


@query(f"WITH {FILES_SQL}, s AS (SELECT sha, CASE WHEN id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM files) SELECT sha, count(DISTINCT split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leakage_guard(spark, d):
    x = _files(spark, d).withColumn("split", F.when(F.col("id") % 5 == 0, "val").otherwise("train"))
    return dataset.leaks(x, "sha")


@query("SELECT lang AS kind, count(*) FILTER (WHERE doc_id % 5 = 0) AS val, count(*) FILTER (WHERE doc_id % 5 = 1) AS test, count(*) FILTER (WHERE doc_id % 5 > 1) AS train FROM documents GROUP BY 1")
def split_kind_matrix(spark, d):
    s = F.when(F.col("doc_id") % 5 == 0, "val").when(F.col("doc_id") % 5 == 1, "test").otherwise("train")
    return dataset.kind_matrix(table(spark, d, "documents").select(F.col("lang").alias("kind"), s.alias("split")), "kind", "split", ["val", "test", "train"])


@query(
    "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT lang, greatest(1, CAST(round_even(150 * n / (SELECT sum(n) FROM n), 0) AS INT)) AS quota FROM n), "
    "r AS (SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents) SELECT id, r.lang FROM r JOIN q USING (lang) WHERE k <= quota"
)
def stratified_sample(spark, d):
    return dataset.stratified(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), ["lang"], 150, 7)


@query(f"{PWITH}, r AS (SELECT id, sequence, row_number() OVER (PARTITION BY sequence ORDER BY captured_at, id) AS k FROM pano) SELECT id, sequence FROM r ORDER BY k, sequence LIMIT 60")
def round_robin_batch(spark, d):
    return dataset.round_robin(panoramas(spark, d).select("id", "sequence", "captured_at"), "sequence", [F.asc("captured_at"), F.asc("id")], 60).select("id", "sequence")


@query(f"{PWITH} SELECT id, CAST((row_number() OVER (ORDER BY sequence, id) - 1) % 4 AS INT) AS member FROM pano")
def deal_out(spark, d):
    return dataset.deal_out(panoramas(spark, d).select("id", "sequence"), [F.asc("sequence"), F.asc("id")], 4).select("id", "member")


@query(
    f"{PWITH}, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5('11:' || id), id) AS node FROM pano), "
    f"e AS MATERIALIZED (SELECT a.node AS a, b.node AS b, b.node AS rb FROM o a JOIN o b ON a.sequence = b.sequence AND b.node < a.node AND round_even({hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 0) < 400), "
    f"{leaders_sql()} SELECT id, sequence, lat, lng FROM o JOIN s USING (node) WHERE lead"
)
def spaced_selection(spark, d):
    """Greedy choice 400 m apart in each sequence."""
    return dataset.spaced(panoramas(spark, d).select("id", "sequence", "lat", "lng"), 400, 11)


@query(
    f"{PWITH}, k AS MATERIALIZED (SELECT sequence, lat, lng FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY captured_at, id) AS i FROM pano) WHERE i % 3 = 1), "
    f"e AS MATERIALIZED (SELECT DISTINCT a.sequence AS a, b.sequence AS b FROM k a JOIN k b ON a.sequence <> b.sequence AND round_even({hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 0) < 1500), "
    "r AS (SELECT DISTINCT sequence AS n, sequence AS c FROM pano UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n) SELECT n AS sequence, min(c) AS component FROM r GROUP BY 1"
)
def location_groups(spark, d):
    """Sequences that pass within 1500 m of each other."""
    return dataset.location_groups(panoramas(spark, d).select("id", "sequence", "lat", "lng", "captured_at"), 1500)


_GROUPS = "g AS (SELECT 'g' || (user_id % 12) AS name, count(DISTINCT image_id) AS panoramas, count(*) AS views, count(*) FILTER (WHERE event_id % 3 = 0) AS litter_views, CAST(sum(event_id % 4) AS BIGINT) AS regions FROM det GROUP BY 1)"


def _groups(spark, d):
    e = F.col("event_id")
    name = F.concat(F.lit("g"), (F.col("user_id") % 12).cast("string"))
    return dataset.group_statistics(detections(spark, d).select(name.alias("name"), F.col("image_id").alias("panorama"), (e % 3 == 0).alias("litter"), (e % 4).alias("regions")))


@query(f"WITH {DET_SQL}, {_GROUPS} SELECT * FROM g")
def group_statistics(spark, d):
    return _groups(spark, d)


@query(
    f"WITH {DET_SQL}, {_GROUPS}, l AS (SELECT arg_max(name, {{'p': panoramas, 'n': name}}) AS big, CAST(sum(panoramas) AS BIGINT) AS p, CAST(sum(regions) AS BIGINT) AS r FROM g), f AS (SELECT g.*, row_number() OVER (ORDER BY name) - 1 AS i FROM g, l WHERE name <> big), "
    "s AS (SELECT m, string_agg(name, ',' ORDER BY name) AS chosen, CAST(sum(panoramas) AS BIGINT) / any_value(l.p) AS ps, CAST(sum(regions) AS BIGINT) / any_value(l.r) AS rs, sum(litter_views) AS lv, count(*) AS n, list(name ORDER BY name) AS names FROM range(1, 2048) t(m), f, l WHERE (m >> CAST(i AS INT)) & 1 = 1 GROUP BY m), "
    "k AS (SELECT *, NOT (rs BETWEEN 0.2 AND 0.45 AND lv > 0) AS outside FROM s) SELECT chosen, ps AS panorama_share, rs AS region_share, NOT outside AS in_bounds FROM k ORDER BY outside, abs(ps - 1/3), n, names LIMIT 1"
)
def subset_search(spark, d):
    return dataset.choose_validation(_groups(spark, d))


#: Boxes in pixels, some a little left of the image and some twice; images of which some have another size, turn, mode or no boxes.
_QA_SQL = """q0 AS (SELECT image_id AS image, event_id AS idx, x1 * 900 - CASE WHEN event_id % 17 = 0 THEN 0.3::DOUBLE ELSE 0 END AS x, y1 * 900 AS y, (x2 - x1) * 30 AS w, (y2 - y1) * 900 AS h FROM det),
qb AS MATERIALIZED (SELECT * FROM q0 UNION ALL SELECT image, idx + 1000000000, x, y + 0.01::DOUBLE, w, h FROM q0 WHERE idx % 13 = 0),
qi AS MATERIALIZED (SELECT DISTINCT image_id AS image, user_id AS u FROM det UNION SELECT 'empty-' || user_id, user_id FROM det WHERE user_id % 5 = 0),
qim AS MATERIALIZED (SELECT image, u, 640 AS width, 640 AS height, CASE WHEN u % 7 = 0 THEN 641 ELSE 640 END AS real_width, 640 AS real_height, CASE WHEN u % 11 = 0 THEN 6 ELSE 1 END AS orientation, CASE WHEN u % 9 = 0 THEN 'L' ELSE 'RGB' END AS mode,
  CASE WHEN u % 3 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN u % 6 <> 1 THEN 'http://x/' || u END AS source_url, CAST((u * 37) % 101 AS DOUBLE) AS sharpness FROM qi)"""
_QA_IOU = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"
_QA_FLAGS = f"""qf AS MATERIALIZED (SELECT image, 0 AS o, 0 AS idx, 0 AS other, 'size differs from annotation' AS f FROM qim WHERE real_width <> width OR real_height <> height
  UNION ALL SELECT image, 1, 0, 0, 'EXIF orientation ' || orientation FROM qim WHERE orientation <> 1 UNION ALL SELECT image, 2, 0, 0, 'mode ' || mode FROM qim WHERE mode <> 'RGB'
  UNION ALL SELECT image, 3, idx, 0, 'box ' || idx || ' outside or empty' FROM qb JOIN qim USING (image) WHERE w <= 0 OR h <= 0 OR x < 0 OR y < 0 OR x + w > real_width + 0.5::DOUBLE OR y + h > real_height + 0.5::DOUBLE
  UNION ALL SELECT image, 4, idx, 0, 'box ' || idx || ' under 2px' FROM qb WHERE least(w, h) < 2
  UNION ALL SELECT a.image, 5, a.idx, b.idx, 'boxes ' || a.idx || ' and ' || b.idx || ' nearly equal' FROM qb a JOIN qb b ON a.image = b.image AND a.idx < b.idx
    WHERE {_QA_IOU} / nullif(((a.x + a.w) - a.x) * ((a.y + a.h) - a.y) + ((b.x + b.w) - b.x) * ((b.y + b.h) - b.y) - {_QA_IOU}, 0) > 0.9
  UNION ALL SELECT image, 6, 0, 0, 'no boxes' FROM qim WHERE image NOT IN (SELECT image FROM qb))"""


def _qa(spark, d):
    x, e, u = detections(spark, d), F.col("event_id"), F.col("u")
    b = x.select(
        F.col("image_id").alias("image"), e.alias("idx"), (F.col("x1") * 900 - F.when(e % 17 == 0, 0.3).otherwise(F.lit(0.0))).alias("x"), (F.col("y1") * 900).alias("y"),
        ((F.col("x2") - F.col("x1")) * 30).alias("w"), ((F.col("y2") - F.col("y1")) * 900).alias("h"),
    )
    b = b.unionByName(b.where("idx % 13 = 0").withColumns({"idx": F.col("idx") + 1_000_000_000, "y": F.col("y") + 0.01}))
    i = x.select(F.col("image_id").alias("image"), F.col("user_id").alias("u")).distinct()
    i = i.unionByName(i.where("u % 5 = 0").withColumn("image", F.concat(F.lit("empty-"), u.cast("string"))))
    i = i.select(
        "image", F.lit(640).alias("width"), F.lit(640).alias("height"), F.when(u % 7 == 0, 641).otherwise(640).alias("real_width"), F.lit(640).alias("real_height"),
        F.when(u % 11 == 0, 6).otherwise(1).alias("orientation"), F.when(u % 9 == 0, "L").otherwise("RGB").alias("mode"), F.when(u % 3 == 0, "val").otherwise("train").alias("split"),
        F.when(u % 6 != 1, F.concat(F.lit("http://x/"), u.cast("string"))).alias("source_url"), ((u * 37) % 101).cast("double").alias("sharpness"),
    )
    return b, i


@query(f"WITH {DET_SQL}, {_QA_SQL}, {_QA_FLAGS} SELECT image, string_agg(f, '; ' ORDER BY o, idx, other) AS flags FROM qf GROUP BY 1")
def quality_flags(spark, d):
    """All kinds of flags of all images and boxes."""
    return dataset.quality_flags(*_qa(spark, d)).withColumn("flags", F.array_join("flags", "; "))


@query(
    f"""WITH {DET_SQL}, {_QA_SQL}, {_QA_FLAGS}, x AS (SELECT min(image) AS a, max(image) AS b FROM qim WHERE image LIKE 'pano-%'),
    g AS MATERIALIZED (SELECT image, o * 1000000000000 + row_number() OVER (PARTITION BY image ORDER BY o, idx, other) AS o, f FROM qf UNION ALL SELECT image, 7000000000000, 'missing source URL' FROM qim WHERE source_url IS NULL
      UNION ALL SELECT image, 8000000000000, 'sharpness in lowest 5% (review)' FROM qim WHERE sharpness < (SELECT quantile_cont(sharpness, 0.05) FROM qim)
      UNION ALL SELECT unnest([a, b]), 9000000000000, 'possible related image across splits: ' || a || '/' || b || ' (distance 3)' FROM x),
    rec AS MATERIALIZED (SELECT q.image, q.split, (SELECT string_agg(f, '; ' ORDER BY o) FROM g WHERE g.image = q.image) AS reasons, (SELECT count(*) FROM g WHERE g.image = q.image AND f NOT LIKE 'no boxes%') > 0 AS flagged,
      coalesce((SELECT median(round(least(w, h) * 640.0::DOUBLE / 640, 1)) FROM qb WHERE qb.image = q.image), 0) AS m FROM qim q),
    st AS (SELECT *, CASE WHEN m < 16 THEN '<16' WHEN m < 32 THEN '16-32' ELSE '>=32' END AS size_class FROM rec WHERE NOT flagged),
    nn AS (SELECT split, size_class, count(*) AS n FROM st GROUP BY 1, 2), qu AS (SELECT split, size_class, greatest(1, CAST(round_even(6 * n / (SELECT sum(n) FROM nn), 0) AS INT)) AS quota FROM nn),
    sa AS (SELECT image FROM (SELECT st.*, row_number() OVER (PARTITION BY split, size_class ORDER BY md5('3:' || image), image) AS k FROM st) JOIN qu USING (split, size_class) WHERE k <= quota)
    SELECT image, split, coalesce(reasons, 'stratified sample') AS reasons FROM rec WHERE flagged OR image IN (SELECT image FROM sa)"""
)
def quality_queue(spark, d):
    """The images to look at: all with a flag, and a sample of the others."""
    boxes, images = _qa(spark, d)
    ends = images.where("image like 'pano-%'").agg(F.min("image").alias("a"), F.max("image").alias("b"), F.lit(3).alias("distance"))
    boxes = boxes.withColumns({"w": F.col("w"), "h": F.col("h")})
    return dataset.quality_report(boxes, images, 6, 3, ends)[1]


@query("SELECT split_part(split_part(event_type || ': ' || user_id, ':', 1), ' (', 1) AS kind, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def flag_counts(spark, d):
    x = table(spark, d, "events").select(F.array(F.concat("event_type", F.lit(": "), F.col("user_id").cast("string"))).alias("flags"))
    return dataset.flag_counts(x)


@query("SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def lock_verification(spark, d):
    x = _files(spark, d).select(F.col("id").cast("string").alias("file"), "sha", "id")
    now = x.where("id % 7 <> 0").select("file", F.when(F.col("id") % 5 == 0, F.concat("sha", F.lit("x"))).otherwise(F.col("sha")).alias("sha"))
    return dataset.verify_lock(x.select("file", "sha"), now)


@query("WITH i AS (SELECT lang AS split, doc_id AS stem FROM documents WHERE doc_id % 3 <> 0), l AS (SELECT lang AS split, doc_id AS stem FROM documents WHERE doc_id % 4 <> 0) SELECT split, count(*) FILTER (WHERE i.stem IS NOT NULL AND l.stem IS NOT NULL) AS pairs, count(*) FILTER (WHERE l.stem IS NULL) AS without_label, count(*) FILTER (WHERE i.stem IS NULL) AS without_image FROM (SELECT split, stem, stem AS s FROM i) i FULL JOIN (SELECT split, stem, stem AS s FROM l) l USING (split, s) GROUP BY 1")
def pairing_audit(spark, d):
    x = table(spark, d, "documents").select(F.col("lang").alias("split"), F.col("doc_id").alias("stem"))
    return dataset.pair_audit(x.where("stem % 3 <> 0"), x.where("stem % 4 <> 0"), ["split", "stem"])


@query("WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS h FROM pages) SELECT page_id, h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.net' OR h LIKE '%.example.net' AS allowed FROM h")
def host_allowlist(spark, d):
    return table(spark, d, "pages").select("page_id", dataset.host_allowed(F.col("url"), ["example.com", "example.net"]).alias("allowed"))


@query(
    f"""WITH {DET_SQL}, w AS (SELECT id, x1*1000 AS x1, y1*1000 AS y1, x2*1000 AS x2, y2*1000 AS y2 FROM det), i AS (SELECT *, greatest(0, least(x2, 740) - greatest(x1, 100)) * greatest(0, least(y2, 740) - greatest(y1, 100)) AS inter, (x2 - x1) * (y2 - y1) AS full_area FROM w),
    k AS (SELECT *, inter / full_area AS visible, least(least(x2, 740) - greatest(x1, 100), least(y2, 740) - greatest(y1, 100)) AS side FROM i WHERE inter > 0)
    SELECT CASE WHEN visible < 0.6 THEN 'grey' WHEN side < 3 THEN 'dropped' ELSE 'kept' END AS kind, count(*) AS count FROM k GROUP BY 1"""
)
def window_labels(spark, d):
    x = detections(spark, d).select("id", *[(F.col(c) * 1000).alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(100.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(640.0).alias("ww"), F.lit(640.0).alias("wh"))
    return derive.window_labels(x).groupBy("kind").agg(F.count("*").alias("count"))


@query(f"WITH {DET_SQL}, w AS (SELECT image_id AS image, min(event_id) AS k FROM det GROUP BY 1), v AS (SELECT image, (k * 3 % 700) AS x0, (k * 5 % 700) AS y0 FROM w) SELECT image FROM v WHERE NOT EXISTS (SELECT 1 FROM det WHERE image_id = image AND x1*1000 < x0 + 80 AND x2*1000 > x0 - 16 AND y1*1000 < y0 + 80 AND y2*1000 > y0 - 16)")
def clear_windows(spark, d):
    x = detections(spark, d)
    w = x.groupBy(F.col("image_id").alias("image")).agg(F.min("event_id").alias("k")).select("image", (F.col("k") * 3 % 700).cast("double").alias("x0"), (F.col("k") * 5 % 700).cast("double").alias("y0"), F.lit(64.0).alias("ww"), F.lit(64.0).alias("wh"))
    b = x.select(F.col("image_id").alias("image"), *[(F.col(c) * 1000).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return derive.is_clear(w, b).select("image")


@query()
def collage_plan(spark, d):
    """Places of parts on canvases; the tests check that none overlap."""
    p = table(spark, d, "part").select((F.col("p_partkey") / 40).cast("long").cast("string").alias("collage"), F.col("p_partkey").cast("long").alias("part"), (40 + F.col("p_partkey") * 7 % 200).cast("double").alias("w"), (40 + F.col("p_partkey") * 13 % 200).cast("double").alias("h"))
    return derive.pack_collages(p)


@query("SELECT p_partkey, CAST(floor(degrees(2 * atan((0.05::DOUBLE + (p_partkey % 26) / 100.0::DOUBLE) / (2 * (2 + p_partkey % 19)))) * 6.4::DOUBLE * 1e6 + 0.5) AS BIGINT) AS px_micro FROM part")
def target_pixels(spark, d):
    k = F.col("p_partkey")
    px = derive.target_pixels(F.lit(0.05) + (k % 26) / F.lit(100.0), (2 + k % 19).cast("double"), 6.4)
    return table(spark, d, "part").select("p_partkey", F.floor(px * 1e6 + 0.5).cast("long").alias("px_micro"))


@query(f"WITH {DET_SQL} SELECT image_id AS image, string_agg(printf('0 %.8f %.8f %.8f %.8f', (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1), chr(10) ORDER BY event_id) AS labels FROM det GROUP BY 1")
def label_lines(spark, d):
    x = detections(spark, d).select(F.col("image_id").alias("image"), F.col("event_id").alias("idx"), "x1", "y1", "x2", "y2")
    return files.label_lines(x)


@query(f"WITH {DET_SQL} SELECT id, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND (event_id % 3 <> 0 OR (x1 + x2) / 2 + (x2 - x1) * 3 <= 1.000001) AND (x2 - x1) > 0 AS ok FROM det")
def label_line_rules(spark, d):
    """Lines of boxes, some of them shifted over the edge, of another class, short of a number or with a word in them."""
    e, w = F.col("event_id"), F.col("x2") - F.col("x1")
    cx = (F.col("x1") + F.col("x2")) / 2 + F.when(e % 3 == 0, w * 2.5).otherwise(F.lit(0.0))
    number = lambda v: F.format_string("%.12f", v)
    parts = [F.when(e % 5 == 0, "1").otherwise("0"), number(cx), number((F.col("y1") + F.col("y2")) / 2), F.when(e % 7 == 0, "wide").otherwise(number(w)), F.when(e % 11 != 0, number(F.col("y2") - F.col("y1")))]
    return detections(spark, d).select("id", files.label_line_ok(F.concat_ws(" ", *parts)).alias("ok"))


@query(
    f"WITH {DET_SQL}, b AS (SELECT image_id, greatest(0, least(1, (x1 * 1000 - 5) / 900)) AS x1, greatest(0, least(1, (y1 * 1000 - 5) / 800)) AS y1, greatest(0, least(1, (x1 * 1000 - 5 + (x2 - x1) * 1000) / 900)) AS x2, greatest(0, least(1, (y1 * 1000 - 5 + (y2 - y1) * 1000) / 800)) AS y2 FROM det) "
    "SELECT image_id, count(*) AS boxes, CAST(sum(CAST(floor(x1 * 1e6 + 0.37::DOUBLE) AS BIGINT)) AS BIGINT) AS x1_micro, CAST(sum(CAST(floor(y2 * 1e6 + 0.37::DOUBLE) AS BIGINT)) AS BIGINT) AS y2_micro FROM b WHERE x2 > x1 AND y2 > y1 GROUP BY 1"
)
def coco_boxes(spark, d):
    """Annotations in pixels as boxes of their images."""
    x = detections(spark, d)
    images = x.select(F.col("image_id").alias("id"), F.lit(900).alias("width"), F.lit(800).alias("height")).distinct()
    px = lambda c: F.col(c) * 1000
    ann = x.select("image_id", F.array(px("x1") - 5, px("y1") - 5, (F.col("x2") - F.col("x1")) * 1000, (F.col("y2") - F.col("y1")) * 1000).alias("bbox"))
    total = lambda c: F.sum(F.floor(F.col(c) * 1e6 + 0.37).cast("long")).alias(f"{c}_micro")
    return dataset.coco_boxes(images, ann).groupBy("image_id").agg(F.count("*").alias("boxes"), total("x1"), total("y2"))


@query("SELECT d.doc_id, d.source, d.doc_id % 3 AS fold FROM documents d")
def must_match(spark, d):
    """Every source has its row, or it is an error."""
    x = table(spark, d, "documents").select("doc_id", "source")
    folds = x.select("doc_id", (F.col("doc_id") % 3).alias("fold"))
    return dataset.must_match(x, folds, ["doc_id"])


@query("SELECT doc_id AS image, CASE WHEN doc_id % 8 < 5 THEN 'licence ' || (doc_id % 8) ELSE 'unknown' END AS license_name, CASE WHEN doc_id % 3 = 0 THEN 'by ' || source ELSE '' END AS credit FROM documents")
def licence_lookup(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("image"), (F.col("doc_id") % 8).cast("int").alias("license"), "source")
    names = spark.range(5).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("licence "), F.col("id").cast("string")).alias("name"))
    credits = x.where("image % 3 = 0").select("image", F.concat(F.lit("by "), "source").alias("credit"))
    return dataset.with_licence(x, names, credits).select("image", "license_name", "credit")


@query(
    "WITH t AS (SELECT p_partkey // 40 AS tile, count(*) AS parts, count(*) FILTER (WHERE p_partkey % 3 = 0) AS clean, sum(p_size % 4) AS labels, (min(p_size) % 10) / 20.0::DOUBLE AS grey FROM part GROUP BY 1) "
    "SELECT CAST(round(avg(parts) * 100) AS BIGINT) AS parts_cent, CAST(round(avg(grey) * 1000) AS BIGINT) AS grey_milli, CAST(round(avg(labels) * 10) AS BIGINT) AS labels_tenth, CAST(round(avg(clean / parts) * 1000) AS BIGINT) AS clean_milli, count(*) FILTER (WHERE labels = 0) AS tiles_without_labels FROM t"
)
def derivative_means(spark, d):
    k = F.col("p_partkey")
    x = table(spark, d, "part").groupBy(F.floor(k / 40).alias("tile")).agg(
        F.count("*").alias("parts"), F.count_if(k % 3 == 0).alias("clean_parts"), F.sum(F.col("p_size") % 4).alias("labels"), ((F.min("p_size") % 10) / F.lit(20.0)).alias("grey_share")
    )
    m = derive.derivative_means(x)
    whole = lambda c, f, n: F.rint(F.col(c) * f).cast("long").alias(n)
    return m.select(whole("photos_per_tile", 100, "parts_cent"), whole("grey_share", 1000, "grey_milli"), whole("labels_per_tile", 10, "labels_tenth"), whole("clean_share_of_parts", 1000, "clean_milli"), "tiles_without_labels")


@query(
    f"WITH {DET_SQL}, b AS (SELECT image_id AS photo, user_id AS u, median(greatest((x2 - x1) * 1000, (y2 - y1) * 1000)) FILTER (WHERE event_id % 4 = 0) AS ref FROM det GROUP BY 1, 2), "
    "k AS (SELECT photo, u, least(1, greatest(coalesce(least(1, (10 + u % 90) / ref), (96 + ((u * 13) % 100) / 100.0::DOUBLE * (640 - 96)) / greatest(300 + u % 900, 400)), 96.0::DOUBLE / greatest(300 + u % 900, 400))) AS scale FROM b) "
    "SELECT photo, CAST(floor(scale * 1e6 + 0.37::DOUBLE) AS BIGINT) AS scale_micro, CASE WHEN 200 + u % 800 <= 640 THEN 0 ELSE CAST(trunc(least(greatest((u * 7) % 900 - (0.2::DOUBLE + 0.6::DOUBLE * (((u * 11) % 100) / 100.0::DOUBLE)) * 640, 0), 200 + u % 800 - 640)) AS BIGINT) END AS origin FROM k"
)
def street_scales(spark, d):
    """How small a photo is drawn so that its objects look as from the street, and where a window on it starts."""
    x, u = detections(spark, d), F.col("u")
    b = x.where("event_id % 4 = 0").select(F.col("image_id").alias("photo"), *[(F.col(c) * 1000).alias(c) for c in ("x1", "y1", "x2", "y2")])
    p = x.select(F.col("image_id").alias("photo"), F.col("user_id").alias("u")).distinct().join(derive.reference_side(b), "photo", "left")
    scale = derive.street_scale((10 + u % 90).cast("double"), F.col("reference"), (300 + u % 900).cast("double"), F.lit(400.0), ((u * 13) % 100) / F.lit(100.0), 96.0)
    start = derive.centred_origin(200 + u % 800, F.lit(640), ((u * 7) % 900).cast("double"), ((u * 11) % 100) / F.lit(100.0))
    return p.select("photo", F.floor(scale * 1e6 + 0.37).cast("long").alias("scale_micro"), start.alias("origin"))


@query("SELECT vec_id AS id, CAST(floor(var_pop(4 * m[r * 8 + c] - m[r * 8 + c - 8] - m[r * 8 + c + 8] - m[r * 8 + c - 1] - m[r * 8 + c + 1]) * 1e6 + 0.37::DOUBLE) AS BIGINT) AS sharpness_micro FROM (SELECT vec_id, [CAST(floor(x * 100) AS DOUBLE) for x in embedding] AS m FROM embeddings), range(1, 7) a(r), range(2, 8) b(c) GROUP BY 1")
def sharpness(spark, d):
    """The numbers of a vector as a small grey image; as in the SQL, single numbers are multiplied in single precision."""
    row = lambda i: F.transform(F.slice("embedding", 8 * i + 1, 8), lambda v: F.floor(v * F.lit(100.0).cast("float")).cast("double"))
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(*[row(i) for i in range(8)]).alias("pixels"))
    return derive.laplacian_variance(x).select("id", F.floor(F.col("sharpness") * 1e6 + 0.37).cast("long").alias("sharpness_micro"))


@query(f"WITH {DET_SQL} SELECT id, label, CAST(floor(greatest(0, x1 - 0.05) * 1e6 + 0.5) AS BIGINT) AS left_micro FROM det WHERE event_id % 4 <> 3")
def detector_responses(spark, d):
    """Responses of three forms, parsed; a fourth of them is no JSON and gives nothing."""
    from ..functions.boxes import normalised

    e = F.col("event_id") % 4
    p = F.format_string('{"x": %s, "y": 50, "width": 10.0, "height": 10, "confidence": 0.5, "class": "%s"}', (F.col("x1") * 100).cast("string"), F.upper("label"))
    raw = F.when(e == 0, F.concat(F.lit('{"outputs": [{"predictions": {"predictions": ['), p, F.lit("]}}]}"))).when(e == 1, F.concat(F.lit('[{"predictions": ['), p, F.lit("]}]"))).when(e == 2, F.concat(F.lit('{"predictions": ['), p, F.lit("]}"))).otherwise("no json")
    x = files.detector_output(detections(spark, d).select("id", raw.alias("json")))
    b = normalised(F.col("pred"), F.lit(100.0), F.lit(100.0))
    return x.select("id", "label", F.floor(b[0] * 1e6 + 0.5).cast("long").alias("left_micro"))


@query(f"WITH {DET_SQL}, r AS (SELECT image_id AS image, count(*) FILTER (WHERE event_id % 50 = 0) AS fp FROM det GROUP BY 1), m AS (SELECT DISTINCT image_id AS image, min(event_id % 4) AS b FROM det WHERE event_id % 7 = 0 GROUP BY 1), a AS (SELECT image, 'false alarm' AS why FROM r WHERE fp > 0), k AS (SELECT image, b, row_number() OVER (PARTITION BY b ORDER BY image) AS k FROM m WHERE image NOT IN (SELECT image FROM a)) SELECT * FROM a UNION ALL SELECT image, 'missed, bucket ' || b FROM k WHERE k <= 3")
def inspection_list(spark, d):
    x = detections(spark, d)
    r = x.groupBy(F.col("image_id").alias("image")).agg(F.count_if(F.col("event_id") % 50 == 0).alias("fp"))
    m = x.where("event_id % 7 = 0").select(F.col("image_id").alias("image"), (F.col("event_id") % 4).alias("bucket_order"))
    return diagnose.inspection(r, m)
