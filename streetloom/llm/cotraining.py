"""Quality classification by co-training a text view and a metadata view.

Each document becomes two small vectors in one pass: the text view (hashed words, hashed token shapes, shares of
letter kinds) and the metadata view (source, language, size in bands, and the layout of the page: lines, their lengths,
repeated and blank ones, bytes a character; no words). A logistic classifier for each view starts from labelled rows.
In every round both score *all* unlabelled vectors, and each hands the other its most confident pseudo-labels: the
``PER_ROUND`` highest of each class among those whose calibrated probability is at least ``CONFIDENT`` and whose odds
are at least ``LIFT`` times those of the class at large, so that a view which only repeats the prior teaches nothing.
Equal vectors count once. After the rounds each view is calibrated (a logistic curve on labelled rows kept apart), and
the calibrated log-odds of both views are added, less the prior that both contain, to score all documents.

Bounded samples: ``LABELLED`` labelled rows (smallest hash of their id) start the training, and pseudo-labels are
bounded by rounds and ``PER_ROUND``; scoring and the pool cover all documents. The vectors are written once to the
shared folder, so rounds do not read texts again.

Edge cases: null or empty texts and null metadata have vectors of their own; without labels of both classes every
score is the prior (0.5 without any label); labels that are null or not 0 or 1 and null ids teach nothing; equally
confident pseudo-labels are taken by smallest id; repeated rows get equal scores; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod, documents, written
from .toxicity import logistic

LABELLED = 20_000
ROUNDS = 3
PER_ROUND = 200
CONFIDENT = 0.8
LIFT = 2.0
PSEUDO_WEIGHT = 0.5
WORDS, SHAPES, SHARES = 128, 96, 9
SOURCES, LANGUAGES, SIZES, LAYOUT = 64, 16, 96, 9
#: Bands of the size for each doubling.
BANDS = 4
_RUNS = (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\dA-Z_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+"))
KEPT_TOKENS = 300_000
#: Longer tokens are looked at anew each time, so that the table stays small.
KEPT_LENGTH = 64


def shape(token: str) -> str:
    token = _RUNS[0].sub("A", token)
    token = _RUNS[1].sub(lambda m: "A" if m[0] == "A" else "a", token)
    return _RUNS[3].sub(r"\1", _RUNS[2].sub("0", token))


class TextView:
    size = 1 + WORDS + SHAPES + SHARES

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _buckets(self, token: str) -> tuple[int, int]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > KEPT_TOKENS:
                self.known.clear()
            word = token.lower().strip(".,;:!?").encode("utf-8", "surrogatepass")
            found = (crc32(word) % WORDS, crc32(shape(token).encode("utf-8", "surrogatepass")) % SHAPES)
            if len(token) <= KEPT_LENGTH:
                self.known[token] = found
        return found

    def vector(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.size, np.float32)
        out[0] = 1
        text = text or ""
        tokens = text.split()
        if not tokens:
            out[-1] = 1
            return out
        bag = Counter(tokens)
        pairs = np.array([self._buckets(t) for t in bag], np.int64)
        n = np.fromiter(bag.values(), np.float64, len(bag))
        out[1 : 1 + WORDS] = np.sqrt(np.bincount(pairs[:, 0], n, WORDS) / len(tokens))
        out[1 + WORDS : 1 + WORDS + SHAPES] = np.sqrt(np.bincount(pairs[:, 1], n, SHAPES) / len(tokens))
        letters = sum(len(t) * k for t, k in bag.items())
        upper = sum(k for t, k in bag.items() if t.isupper() and len(t) > 1)
        alpha = sum(k for t, k in bag.items() if t.isalpha())
        odd = sum(k for t, k in bag.items() if not t[-1].isalnum() and t[-1] not in ".,")
        bare = sum(k for t, k in bag.items() if not any(map(str.isalnum, t)))
        out[-SHARES:] = [
            upper / len(tokens), alpha / len(tokens), odd / len(tokens), bare / len(tokens), len(bag) / len(tokens), min(letters / len(tokens), 40) / 10,
            max(bag.values()) / len(tokens), np.log1p(len(tokens)) / 10, 0,
        ]
        return out


def layout(text: str | None) -> list[float]:
    """How a page is laid out, whatever it says."""
    text = text or ""
    every = text.split("\n")
    full = [x for x in every if x and not x.isspace()]
    if not full:
        return [0.0] * LAYOUT
    size, seen = np.fromiter(map(len, full), np.float64, len(full)), Counter(full)
    mean = size.mean()
    return [
        np.log1p(len(full)) / 5, np.log1p(mean) / 5, np.log1p(size.max()) / 5, np.log1p(size.min()) / 5, min(size.std() / mean, 5),
        1 - len(seen) / len(full), max(seen.values()) / len(full), 1 - len(full) / len(every), len(text.encode("utf-8", "surrogatepass")) / len(text) - 1,
    ]


def metadata_vector(text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(1 + SOURCES + LANGUAGES + SIZES + LAYOUT + 1, np.float32)
    out[0] = 1
    out[1 + crc32(str(source).encode("utf-8", "surrogatepass")) % SOURCES] = 1
    out[1 + SOURCES + crc32(str(lang).encode("utf-8", "surrogatepass")) % LANGUAGES] = 1
    if n_chars is not None:
        out[1 + SOURCES + LANGUAGES + min(SIZES - 1, int(BANDS * np.log2(max(0, n_chars) + 1)))] = 1
    out[-1 - LAYOUT : -1] = layout(text)
    out[-1] = n_chars is None
    return out


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, t, m): both views of each document as half-precision vectors."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        view = TextView()
        for batch in batches:
            text, source, lang, n = (batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars"))
            t = [view.vector(x).astype("<f2").tobytes() for x in text]
            m = [metadata_vector(*x).astype("<f2").tobytes() for x in zip(text, source, lang, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(t, pa.binary()), pa.array(m, pa.binary())], ["doc_id", "t", "m"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(
        run, "doc_id long, t binary, m binary"
    )


def matrix(column) -> np.ndarray:
    values = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(values), "<f2").reshape(len(values), -1).astype(np.float64)


def weighted_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    root = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ root, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * root)
        root += step
        if np.abs(step).max() < 1e-6:
            break
    return root


class View:
    """A classifier and the curve (a, b) that calibrates its log-odds."""

    def __init__(self, weights: np.ndarray, curve: np.ndarray):
        self.weights, self.curve = weights, curve

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.curve[0] + self.curve[1] * np.clip(x @ self.weights, -30, 30), -12, 12)


def _view(x, y, w, x_cal, y_cal) -> View:
    weights = weighted_logistic(x, y, w)
    z = np.clip(x_cal @ weights, -30, 30)
    return View(weights, logistic(np.stack([np.ones_like(z), z], axis=1), y_cal, ridge=1.0))


class Model:
    """Both views, the prior, and what they were taught: for each round the numbers of (view, class) pseudo-labels."""

    def __init__(self, text: View | None, meta: View | None, prior: float):
        self.text, self.meta, self.prior = text, meta, prior
        self.gained: list[dict[tuple[str, int], int]] = []

    def odds(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.text is None:
            flat = np.full(len(t), np.log(self.prior / (1 - self.prior)))
            return flat, flat
        return self.text.odds(t), self.meta.odds(m)

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(a + b - np.log(self.prior / (1 - self.prior)))))


def scored(vecs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p_text, p_meta, score, t, m)"""
    shared = vecs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            a, b = shared.value.odds(matrix(batch.column("t")), matrix(batch.column("m"))) if len(batch) else (np.zeros(0), np.zeros(0))
            s = shared.value.score(a, b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-a))), pa.array(1 / (1 + np.exp(-b))), pa.array(s), batch.column("t"), batch.column("m")],
                ["doc_id", "p_text", "p_meta", "score", "t", "m"],
            )

    return vecs.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, t binary, m binary")


def co_train(vecs: DataFrame, labels: DataFrame, learn, calibrate, rounds: int = ROUNDS) -> Model:
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = rows.withColumn("learn", learn).where(learn | calibrate)
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    got = vecs.join(F.broadcast(sample), "doc_id").orderBy("doc_id").limit(LABELLED).collect()  # LABELLED small vectors at most
    prior = (sum(r["y"] for r in got) + 1) / (len(got) + 2)
    part = {k: [r for r in got if r["learn"] is k] for k in (True, False)}
    if any(len({r["y"] for r in part[k]}) < 2 for k in part):
        return Model(None, None, prior)
    y = {k: np.array([r["y"] for r in part[k]], float) for k in part}
    x = {(v, k): matrix([bytes(r[v]) for r in part[k]]) for v in "tm" for k in part}
    pool = written(
        vecs.join(rows.select("doc_id"), "doc_id", "left_anti").withColumn("th", F.xxhash64("t", "m")).groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.min("t").alias("t"), F.min("m").alias("m")),
        "cotraining-pool",
    )
    extra = {v: (np.zeros((0, x[v, True].shape[1])), np.zeros(0)) for v in "tm"}
    used: set[int] = set()

    def fit_both() -> Model:
        made = []
        for v in "tm":
            xs, ys = np.concatenate([x[v, True], extra[v][0]]), np.concatenate([y[True], extra[v][1]])
            w = np.concatenate([np.ones(len(y[True])), np.full(len(extra[v][1]), PSEUDO_WEIGHT)])
            made.append(_view(xs, ys, w, x[v, False], y[False]))
        return Model(*made, prior)

    def confident(source: str, label: int):
        p, base = (F.col(source), prior) if label else (1 - F.col(source), 1 - prior)
        return p, (p >= CONFIDENT) & (p * (1 - base) >= LIFT * (1 - p) * base)

    ways = [(source, to, label) for source, to in (("p_text", "m"), ("p_meta", "t")) for label in (1, 0)]
    model, gained = fit_both(), []
    for _ in range(rounds):
        any_way = reduce(Column.__or__, [confident(source, label)[1] for source, _, label in ways])
        found = written(scored(pool.select("doc_id", "t", "m"), model).where(any_way), "cotraining-confident")
        new, counts = [], {}
        for source, to, label in ways:
            p, ok = confident(source, label)
            # those used before and PER_ROUND more: at most (rounds + 1) * 2 * PER_ROUND small vectors
            best = found.where(ok).orderBy(p.desc(), "doc_id").limit(PER_ROUND + len(used)).select("doc_id", "t", "m").collect()
            picks = [r for r in best if (r["doc_id"], to) not in used][:PER_ROUND]
            new += [(to, label, r) for r in picks]
            counts["text" if to == "t" else "meta", label] = len(picks)
        gained.append(counts)
        if not new:
            break
        for v in "tm":
            mine = [(y, bytes(r[v])) for to, y, r in new if to == v]
            if mine:
                extra[v] = (np.concatenate([extra[v][0], matrix([x for _, x in mine])]), np.concatenate([extra[v][1], [y for y, _ in mine]]))
        used |= {(r["doc_id"], to) for to, _, r in new}
        model = fit_both()
    model.gained = gained
    return model


def quality(docs: DataFrame, labels: DataFrame, learn, calibrate, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, p_text, p_meta, score and predicted for all documents."""
    vecs = written(vectors(docs), "cotraining-vectors")
    model = co_train(vecs, labels, learn, calibrate, rounds)
    return scored(vecs, model).select("doc_id", "p_text", "p_meta", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with remainder 2 teach nothing (held out), remainder 3 calibrates, the others train."""
    rest = crc_mod("doc_id", 4)
    found = quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), rest.isin(0, 1), rest == 3)
    return found.withColumn("held_out", rest == 2)
