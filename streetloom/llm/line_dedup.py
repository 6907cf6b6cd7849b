"""Line deduplication by winnowing over line hashes, in DataFrame operations only.

A line is what newlines bound, compared without white space at its ends. Words are what any white space bounds (tabs
and no-break blanks too); of scripts written without blanks each character counts as a word. Lines without a word are
never counted, matched or deleted.

1. Winnowing: from every line starts a window, the fewest lines that hold ``min_words`` words. The line with the
   smallest hash in it (the first of equals) is its anchor, and a line that is the anchor of many windows is one
   anchor. Equal windows select the same line, so every repeated run of ``min_words`` words has an anchor in all its
   places: anchors are the only rows that are compared over all documents.
2. Join: anchors whose hash occurs once are done; documents without an anchor that recurs leave here.
3. Extension: from the anchors that recur a match grows both ways, line by line. To the left, a run is tried from each
   line whose window still holds the anchor; to the right, up to each line from which the fewest lines back that hold
   ``min_words`` words still do. Runs are compared by hashes of all their lines, for all places at once: a passage in
   a third of all documents makes one row to look up, never pairs. A maximal repeated run is exactly the union of these.
4. Deletion: a run goes where an equal one starts earlier (smaller doc_id, then earlier line); the first place stays.
   Runs of a document become disjoint spans before they are gathered, so long documents cost in proportion.

Counting anchors and runs combines on the map side, however often one occurs. Rows look up what was counted for their
hash by a join; the hashes that very many rows share, of which there can be few only, are broadcast there, so that no
task gets all the places of one passage.

Line hashes have 64 bits for winnowing and 32 further ones in the comparison of runs.

Edge cases: null and empty texts have no lines and stay as they are; a null doc_id comes before all others; rows
that repeat doc_id and text are one document and are cleaned alike; a document of which nothing is left has an empty
text; windows that overlap their own earlier occurrence in one text (a line repeated many times) count as repeats;
repeated runs of fewer than ``min_words`` words stay; an empty table gives an empty result; other columns pass
through, but those named like the counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, spare, written

MIN_WORDS = 50
#: A key is hot with more than this many rows and more than one in so many of all: there are at most ``HOT_KEYS`` of them.
HOT_ROWS, HOT_KEYS = 1_000, 10_000
#: White space inside a line, and scripts without blanks between words (Thai, Lao, Tibetan, Burmese, Khmer, New Tai Lue
#: and Tai Tham, kana, Han), as insides of a Java character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNSPACED = r"\u0e01-\u0e3a\u0e40-\u0fff\u1000-\u109f\u1780-\u17ff\u1980-\u19df\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3021-\u302f\u3031-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\x{1b000}-\x{1b16f}\x{20000}-\x{3ffff}"
#: A superset of both but the blank that is quick to look for: without it, words are what blanks bound.
ODD = r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u0e00-\x{10ffff}]"
WORD = rf"\p{{P}}*[{UNSPACED}][\p{{M}}\p{{P}}]*|[^{SPACE}{UNSPACED}]+"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def trimmed(line: Column, odd: Column) -> Column:
    ends = rf"^[{SPACE}]+|(?<![{SPACE}])[{SPACE}]+\z"
    return F.when(odd, F.regexp_replace(line, ends, "")).otherwise(F.trim(line))


def words_in(line: Column, odd: Column | None = None) -> Column:
    """Words of a trimmed line: what white space bounds, each character of an unspaced script (with its marks) by itself.
    Where nothing is ``odd``, they are one more than the single blanks (runs of blanks count once), which is cheaper."""
    one = F.regexp_replace(line, "  +", " ")
    plain = F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1
    odd = line.rlike(ODD) if odd is None else odd
    return F.when(line == "", 0).when(odd, F.regexp_count(line, F.lit(WORD))).otherwise(plain)


#: What names a document: whether its id is null, the id, the hash of its text.
DOC = ["nil", "id", "th"]


def named(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` and the columns that name a document, under the names given."""
    values = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id"), F.lit(0)), F.xxhash64("text")
    return docs.select("*", *[v.alias(n) for v, n in zip(values, names)])


def lines(docs: DataFrame) -> DataFrame:
    """(nil, id, th, pos, h, v, n): the lines with words of each document, two hashes of each, its words. Rows that
    repeat a document collapse on the map side."""
    x = named(docs.where("text is not null").select("doc_id", "text"), *DOC).withColumn("odd", F.col("text").rlike(ODD))
    x = x.select(*DOC, "odd", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    x = x.withColumn("line", trimmed(F.col("line"), F.col("odd"))).where("line <> ''")
    x = x.select(*DOC, "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("v"), words_in(F.col("line"), F.col("odd")).cast("long").alias("n"))
    return x.groupBy(*DOC, "pos").agg(*[F.max(c).alias(c) for c in ("h", "v", "n")])


def _frames(x: DataFrame, min_words: int):
    """``x`` with words up to each line (c), before it and in all, and the frames of the fewest lines from a line
    forward and from it back that hold ``min_words`` words, where there are so many."""
    doc = W.partitionBy(*DOC)
    x = x.withColumn("c", F.sum("n").over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("before", F.col("c") - F.col("n")).withColumn("all", F.max("c").over(doc))
    return x, doc.orderBy("before").rangeBetween(0, min_words - 1), doc.orderBy("c").rangeBetween(-(min_words - 1), 0)


def winnowed(x: DataFrame, min_words: int) -> DataFrame:
    """``x`` and ``anchor``: the (hash, line) that the window from this line selects, if the line before did not select it."""
    x, fore, _ = _frames(x, min_words)
    x = x.withColumn("least", F.when(F.col("all") - F.col("before") >= min_words, F.min(F.struct("h", "pos")).over(fore)))
    above = F.lag("least").over(W.partitionBy(*DOC).orderBy("before"))
    # anchors never move back, so those equal to the one above are all there is of repeats
    return x.select(*DOC, "pos", "h", "v", "n", F.when(~F.col("least").eqNullSafe(above), F.col("least")).alias("anchor"))


def looked_up(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``table``, a written one with one row for each key and the number of rows that have it in
    ``copies``. Hot keys, at most ``HOT_KEYS``, are broadcast; of the others none has many rows, and they are shuffled."""
    total = table.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") > max(HOT_ROWS, total // HOT_KEYS)
    often, rest = F.broadcast(table.where(hot)), table.where(~hot)
    return rows.join(often, on).unionByName(rows.join(often.select(*on), on, "left_anti").join(rest, on))


def recurring(x: DataFrame) -> DataFrame:
    """(nil, id, th, pos): the anchors whose hash is that of another anchor too."""
    anchors = x.where("anchor is not null").select(*DOC, "anchor.pos", "anchor.h")
    often = written(anchors.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"), "line-recurring")
    return looked_up(anchors, often, ["h"]).select(*DOC, "pos")


def runs(x: DataFrame, anchors: DataFrame, min_words: int) -> DataFrame:
    """(nil, id, th, a, b, fp, w): first and last line, smallest hash and hash of all lines of each run that the
    extension from ``anchors`` tries."""
    marks = anchors.select(*DOC, "pos", *[F.lit(None).cast(t).alias(c) for c, t in (("h", "long"), ("v", "int"), ("n", "long"))], F.lit(1).alias("mark"))
    both = x.select(*DOC, "pos", "h", "v", "n", F.lit(0).alias("mark")).unionByName(marks).repartition(*DOC)
    both = both.groupBy(*DOC, "pos").agg(*[F.max(c).alias(c) for c in ("h", "v", "n", "mark")])
    both = both.withColumn("any", F.max("mark").over(W.partitionBy(*DOC))).where("any = 1").drop("any")
    both, fore, back = _frames(both, min_words)

    def made(frame) -> list[Column]:
        hashes = F.xxhash64(F.collect_list("h").over(frame), F.collect_list("v").over(frame))
        return [F.min("pos").over(frame), F.max("pos").over(frame), F.min("h").over(frame), hashes, F.max("mark").over(frame)]

    names = ("a", "b", "fp", "w", "mark")
    both = both.select("*", *[c.alias(f"f_{n}") for c, n in zip(made(fore), names)])
    both = both.select("*", *[c.alias(f"b_{n}") for c, n in zip(made(back), names)])
    pick = lambda k: F.struct(*[F.col(f"{k}_{n}").alias(n) for n in names[:4]])
    found = F.array(
        F.when((F.col("all") - F.col("before") >= min_words) & (F.col("f_mark") == 1), pick("f")),
        F.when((F.col("c") >= min_words) & (F.col("b_mark") == 1), pick("b")),
    )
    return both.select(*DOC, F.explode(F.array_distinct(F.array_compact(found))).alias("x")).select(*DOC, "x.*")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(nil, id, th, gone): for each document with lines to delete, disjoint spans (a, b) of their numbers (from 0) in order."""
    x = written(winnowed(lines(docs), min_words), "line-anchors")
    found = written(runs(x, recurring(x), min_words), "line-runs")
    at = F.struct((~F.col("nil")).alias("has"), "id", "th", "a")
    first = found.groupBy("fp", "w").agg(F.min(at).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    places = looked_up(found, written(first, "line-first"), ["fp", "w"])
    later = places.where(at > F.col("first")).groupBy(*DOC, "a").agg(F.max("b").alias("b"))
    doc = W.partitionBy(*DOC).orderBy("a")
    upto = F.max("b").over(doc.rowsBetween(W.unboundedPreceding, -1))
    later = later.withColumn("starts", F.when(F.col("a") <= upto, 0).otherwise(1)).withColumn("span", F.sum("starts").over(doc))
    spans = later.groupBy(*DOC, "span").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return spans.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("gone"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """``docs`` with later repeats deleted from ``text``; optionally the numbers of lines before and deleted."""
    *keys, gone = names = [spare(docs, f"_{c}") for c in (*DOC, "gone")]
    plan = repeated_lines(docs.select("doc_id", "text"), min_words).toDF(*names)
    x = named(docs, *keys).join(plan, keys, "left")
    parts, cut = split_lines(F.col("text")), F.col(gone).isNotNull() & F.col("text").isNotNull()
    # what lies between the spans; blank lines inside a deleted run go with it
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda s: s.b + 1))
    stops = F.concat(F.transform(gone, lambda s: s.a), F.array(F.size(parts)))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(parts, a + 1, b - a)))
    text = F.when(cut, F.array_join(kept, "\n")).otherwise(F.col("text"))
    extra = []
    if n_lines:
        extra.append(F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(parts)).cast("long").alias(n_lines))
    if n_removed:
        removed = F.aggregate(gone, F.lit(0).cast("long"), lambda n, s: n + s.b - s.a + 1)
        extra.append(F.when(cut, removed).otherwise(0).cast("long").alias(n_removed))
    keep = [c for c in docs.columns if c.lower() not in {(n or "").lower() for n in (n_lines, n_removed)}]
    return x.select(*[text.alias(c) if c == "text" else F.col(c) for c in keep], *extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = line_dedup(docs, n_lines="n_lines", n_removed="n_removed")
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM s),
l AS (SELECT doc_id, pos, trim(line, ' ') AS line, len(string_split_regex(trim(line, ' '), ' +')) AS n FROM p WHERE trim(line, ' ') <> ''),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS c, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM l),
f AS (SELECT doc_id, min(pos) OVER w AS a, max(pos) OVER w AS b, list(line) OVER w AS w, total - c + n >= 50 AS whole FROM c
      WINDOW w AS (PARTITION BY doc_id ORDER BY c - n RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
b AS (SELECT doc_id, min(pos) OVER w AS a, max(pos) OVER w AS b, list(line) OVER w AS w, c >= 50 AS whole FROM c
      WINDOW w AS (PARTITION BY doc_id ORDER BY c RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
x AS (SELECT doc_id, a, b, md5(array_to_string(w, chr(10))) AS w FROM f WHERE whole UNION SELECT doc_id, a, b, md5(array_to_string(w, chr(10))) FROM b WHERE whole),
r AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY w ORDER BY doc_id, a) AS k FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM r WHERE k > 1),
kept AS (SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.pos) AS text, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, pos) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(s.parts) END AS BIGINT) AS n_lines,
       CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(s.parts) - coalesce(k.n, 0) END AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
