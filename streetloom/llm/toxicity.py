"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding look-alikes and digits.

Folding: lower case, accents off, Cyrillic and Greek look-alikes to Latin, invisible characters out; inside a word,
digits and signs that stand for letters become these letters ("1d10t"), and i, l, 1, ! and | become one letter. The
lexicon lives in the same folded space, so folding cannot lose a match.

The lexicon is learned from labelled rows: whole words and word beginnings (stems of at least ``MIN_STEM`` letters)
that occur in ``MIN_DOCS`` toxic documents and whose documents are toxic far more often than not; the weight is their
smoothed log-odds. Exception phrases are learned too: a matched word with the word before or after it, if it occurs in
``MIN_DOCS`` clean documents and no more often in toxic ones; ``EXCEPTIONS`` are added to these. Equal texts count once.
One automaton holds all entries and the exception phrases; a match inside an exception phrase does not count. The
weights found in a text are summed and divided by its length in words, and a logistic curve over the log of that
density and of the sum, fitted on labelled rows that the lexicon has not seen, gives the score. The two logs together
are one log of the sum over a power of the length: labels mark a document for what it contains, so the rows say how
far length excuses it (without the second, check_s has 3 of 543 toxic held-out rows missed and 6 of 4,556 clean ones
flagged; with it README's figures).

Labelled rows are a sample of at most ``SAMPLE_ROWS`` (a documented bound; rows with the smallest hash of their id),
and lexicon and phrases grow with these only. Scoring reads every text whole.

Edge cases: null counts as empty; empty texts get the score of a text without matches; rows without a label or with a
null label teach nothing; a null doc_id is not held out and teaches nothing; no labels of either kind: every score is
0; repeated rows get equal scores; an empty table gives an empty result; other columns pass through, but one named
like the output is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod, documents, spare, with_fields, written

SAMPLE_ROWS = 20_000
MIN_STEM = 4
MAX_STEM = 8
#: Documents of the sample (equal texts once) that an entry or a phrase needs at least, and the log-odds of an entry.
MIN_DOCS = 5
#: Counts that a worker gathers before it hands them on.
KEPT_COUNTS = 200_000
MIN_ODDS = 3.0

# Look-alikes by the Latin letter they stand for.
LOOKALIKES = {
    "a": "аαɑ@4", "b": "вβ8", "c": "сϲ", "d": "ԁ", "e": "еєε3", "g": "ɡ9", "h": "һн", "i": "іιı1!|lӏ", "j": "ј", "k": "кκ", "m": "м",
    "n": "ո", "o": "оο0σ", "p": "рρ", "q": "ԛ", "s": "ѕ5$", "t": "тτ7", "u": "υս", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уγ", "z": "2",
}
#: Phrases in which a lexicon word is harmless, besides those learned.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "stupid mistake of mine", "sore loser effect", "idiot proof")

_INSIDE = {ord(c): k for k, v in LOOKALIKES.items() for c in v if c.isascii()}
_ALWAYS = {ord(c): k for k, v in LOOKALIKES.items() for c in v if not c.isascii()} | {ord(c): None for c in "​‌‍⁠﻿­"}
_SIGNS = re.compile(r"[0-9@$!|]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = re.compile("[̀-ͯ]+")
_ASCII_FOLD = str.maketrans({"l": "i"})
_ASCII_WORDS = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalpha()})


def _letters(m: re.Match) -> str:
    """Digits and signs as the letters they stand for, if they are part of a word."""
    text, a, b = m.string, m.start(), m.end()
    before, after = text[max(0, a - 2) : a], text[b : b + 8].split(maxsplit=1)[0] if text[b : b + 1].isalpha() else ""
    inside = before[-1:].isalpha() and after[:1].isalpha()
    first = b - a == 1 and not before[-1:].isalnum() and sum(map(str.isalpha, after)) >= 2
    last = b - a == 1 and m[0].isdigit() and not text[b : b + 1].isalnum() and len(before) == 2 and before.isalpha()
    return m[0].translate(_INSIDE) if inside or first or last else m[0]


def fold(text: str | None) -> str:
    """``text`` as folded words, each between single blanks."""
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(_ALWAYS)
    text = _SIGNS.sub(_letters, text).translate(_ASCII_FOLD)
    found = text.translate(_ASCII_WORDS).split() if text.isascii() else _LETTERS.findall(text)
    return f" {' '.join(found)} " if found else ""


def entries(folded: str) -> set[str]:
    """Candidate lexicon entries of a folded text: whole words (" word ") and stems (" stem")."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for k in range(MIN_STEM, min(MAX_STEM, len(w)) + 1):
            out.add(f" {w[:k]}")
    return out


class Matcher:
    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for e in exceptions:
            if f := fold(e):
                self.automaton.add_word(f, (len(f), None))
        for e, w in weights.items():
            self.automaton.add_word(e, (len(e), w))
        self.any = bool(len(self.automaton))
        self.automaton.make_automaton() if self.any else None

    def matches(self, folded: str) -> dict[int, float]:
        """The heaviest entry at each word by where the word starts (its blank), exceptions left out."""
        heaviest: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton.iter(folded) if self.any and folded else ():
            start = end - n + 1
            if w is None:
                excused.append((start, end))
            elif w > heaviest.get(start, 0.0):
                heaviest[start] = w
        if excused and heaviest:
            inside = {at for a, b in excused for at in _blanks(folded, a, b)}
            heaviest = {at: w for at, w in heaviest.items() if at not in inside}
        return heaviest

    def features(self, folded: str) -> tuple[float, int]:
        """Sum of the weights matched and words."""
        return sum(self.matches(folded).values(), 0.0), folded.count(" ") - 1 if folded else 0

    def phrases(self, folded: str) -> set[str]:
        """Each matched word with the word before it and with the one after it, folded."""
        out = set()
        for at in self.matches(folded):
            stop = folded.index(" ", at + 1)
            if at:
                out.add(folded[folded.rindex(" ", 0, at) : stop + 1])
            if stop + 1 < len(folded):
                out.add(folded[at : folded.index(" ", stop + 1) + 1])
        return out


def _blanks(folded: str, a: int, b: int) -> list[int]:
    """Where words start in [a, b)."""
    return [i for i in range(a, b) if folded[i] == " "]


def curve(total: float, words: int) -> list[float]:
    return [1.0, np.log1p(100 * total / (words + 10)), np.log1p(total)]


class Model:
    """Lexicon weights, exception phrases and the logistic curve over (1, log density, log sum)."""

    def __init__(self, weights: dict[str, float], slope, exceptions=EXCEPTIONS):
        self.weights, self.slope, self.exceptions = weights, np.asarray(slope, float), tuple(exceptions)

    def matcher(self) -> Matcher:
        return Matcher(self.weights, self.exceptions)

    def score(self, matcher: Matcher, text: str | None) -> float:
        total, words = matcher.features(fold(text))
        z = float(np.dot(self.slope, curve(total, words)))
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn, calibrate) -> Model:
    """Learn from labelled rows; ``learn`` and ``calibrate`` are conditions on doc_id that part the rows."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("lexicon", learn).where(learn | calibrate).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # at most SAMPLE_ROWS rows of three small columns are broadcast; equal texts count once
    sample = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").withColumn("sha", F.xxhash64("text"))
    sample = written(sample, "toxicity-sample")
    once = sample.groupBy("lexicon", "sha").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    distinct = sample.select("doc_id", "sha", "text").join(F.broadcast(once), ["doc_id", "sha"])

    lexicon = distinct.where("lexicon").select("text", "toxic")

    def counted(found) -> DataFrame:
        """(entry, toxic, clean): in how many documents of either kind ``found(text)`` has the entry; '' counts all."""

        def tally(batches):
            counts = Counter(), Counter()
            for batch in batches:
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                    counts[toxic].update({"", *found(fold(text))})
                if sum(map(len, counts)) > KEPT_COUNTS:
                    yield from _counts(counts)
            yield from _counts(counts)

        return lexicon.mapInArrow(tally, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    every = written(counted(entries), "toxicity-entries")
    base = every.where("entry = ''").first()
    toxic, clean = (base["toxic"], base["clean"]) if base else (0, 0)
    share = lambda n, of: F.log((F.col(n) + 0.5) / (F.lit(of) - F.col(n) + 0.5))
    kept = every.where(f"entry <> '' and toxic >= {MIN_DOCS}").withColumn("odds", share("toxic", toxic) - share("clean", clean)).where(f"odds >= {MIN_ODDS}")
    weights = {r["entry"]: r["odds"] for r in kept.orderBy("entry").collect()}  # entries of SAMPLE_ROWS texts, MIN_DOCS of them for each
    shared = spark.sparkContext.broadcast(weights)
    matchers: dict[int, Matcher] = {}

    def phrases(folded: str) -> set[str]:
        if 0 not in matchers:
            matchers[0] = Matcher(shared.value)
        return matchers[0].phrases(folded)

    harmless = counted(phrases).where(f"entry <> '' and clean >= {MIN_DOCS} and toxic * {max(clean, 1)} <= clean * {max(toxic, 1)}")
    exceptions = (*EXCEPTIONS, *sorted(r["entry"].strip() for r in harmless.collect())) if weights else EXCEPTIONS
    model = Model(weights, [-5.0, 2.0, 1.0] if weights else [-30.0, 0.0, 0.0], exceptions)
    told = spark.sparkContext.broadcast(model)

    def measure(batches):
        matcher = told.value.matcher()
        for batch in batches:
            found = [curve(*matcher.features(fold(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": pa.array([f[1] for f in found], pa.float64()), "b": pa.array([f[2] for f in found], pa.float64()), "toxic": batch.column("toxic")})

    got = distinct.where("not lexicon").select("text", "toxic").mapInArrow(measure, "a double, b double, toxic int").collect()  # SAMPLE_ROWS rows at most
    y = np.array([r["toxic"] for r in got], float)
    if weights and 0 < y.sum() < len(y):
        model.slope = logistic(np.array([[1.0, r["a"], r["b"]] for r in got]), y)
    return model


def _counts(counts: tuple[Counter, Counter]):
    """The counts so far as batches; empties them."""
    keys = [*{**counts[0], **counts[1]}]
    for i in range(0, len(keys), 5000):
        part = keys[i : i + 5000]
        yield pa.RecordBatch.from_pydict({"entry": part, "toxic": pa.array([counts[1][k] for k in part], pa.int64()), "clean": pa.array([counts[0][k] for k in part], pa.int64())})
    for c in counts:
        c.clear()


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` and a column with each text's score from 0 to 1."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop(out)

    def run(batches):
        matcher = shared.value.matcher()
        for batch in batches:
            yield batch.append_column(out, pa.array([shared.value.score(matcher, t) for t in batch.column(text).to_pylist()], pa.float64()))

    return docs.mapInArrow(run, with_fields(docs, (out, "double")))


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the queries: rows with remainder 2 are never seen; remainder 3 fits the curve, the others the lexicon."""
    rest = crc_mod("doc_id", 4)
    return fit(docs, labels, rest.isin(0, 1), rest == 3)


def query(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learned(spark, docs, documents(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", (crc_mod("doc_id", 4) == 2).alias("held_out"))
    return scored(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    score = spare(docs, "_score")
    return scored(docs, model, out=score).where(F.col(score) < threshold).drop(score)
