"""Language identification as a multilingual mixture.

Each learned language has a distribution over hashed character trigrams of bounded words; a word's likelihood is the
product over its trigrams. A document is a bag of words drawn from a mixture of languages: expectation-maximisation
estimates the proportions, first over all languages. Then the languages with the largest proportions form nested sets
of one to all of them; each is fitted, and the set with the largest log-likelihood less half its size times the log of
the number of words (a penalised likelihood) is selected. Every estimation runs until no proportion moves by
``TOLERANCE`` in a step. The prediction is the language with the largest proportion in the selected set, the score that
proportion; the set and its proportions are returned with it, largest first.

The trigram tables are learned from at most ``PER_LANGUAGE`` documents of each language (those with the smallest hash
of their id; a documented bound), and have ``BUCKETS`` buckets. Prediction reads every text whole.

Edge cases: null, empty and letterless texts are ``und`` with score 0 and an empty set; rows without lang or doc_id teach nothing; if
nothing can be learned everything is ``und``; ties go to the language first in order; repeated rows get equal results;
an empty table gives an empty result; other columns pass through, but those named like the output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod, documents, with_fields

PER_LANGUAGE = 3_000
BUCKETS = 1 << 16
TOLERANCE = 1e-5
#: A guard against endless estimation, far beyond what converging takes.
STEPS = 5_000
#: Words whose likelihoods a worker remembers.
KEPT_WORDS = 300_000
UNDETERMINED = "und"
_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    found = _WORDS.findall((text or "").lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def trigrams(word: str) -> list[int]:
    bounded = f"^{word}$".encode("utf-16-le", "surrogatepass")
    return [crc32(bounded[i : i + 6]) % BUCKETS for i in range(0, len(bounded) - 4, 2)]


class Model:
    """Languages in order and the log-probability of each bucket in each of them."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    @classmethod
    def of(cls, counts: list[tuple[str, int, int]]) -> Model:
        languages = sorted({c[0] for c in counts})
        at = {x: i for i, x in enumerate(languages)}
        n = np.full((BUCKETS, len(languages)), 0.5)
        for lang, bucket, k in counts:
            n[bucket, at[lang]] += k
        return cls(languages, np.log(n / n.sum(axis=0)).astype(np.float32))


def fit(docs: DataFrame, learn, per_language: int = PER_LANGUAGE) -> Model:
    """Count trigrams of the documents that meet ``learn``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang").distinct()
    chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("doc_id", "lang")
    # per_language rows of an id and a language for each language
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")

    def tally(batches):
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts.setdefault(lang, Counter()).update(words(text))
        for lang, bag in counts.items():
            n = np.zeros(BUCKETS, np.int64)
            for word, k in bag.items():
                np.add.at(n, trigrams(word), k)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

    sums = sample.mapInArrow(tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model.of([tuple(r) for r in sums.collect()])  # BUCKETS rows a language at most


class Predictor:
    def __init__(self, model: Model):
        self.model, self.number, self.table, self.size = model, {}, np.zeros((1 << 12, len(model.languages)), np.float32), 0

    def _ids(self, found: list[str]) -> list[int]:
        ids = list(map(self.number.get, found))
        if None in ids:
            for i, (k, w) in enumerate(zip(ids, found)):
                if k is None and (k := self.number.get(w)) is None:
                    if self.size == len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    k = self.number[w] = self.size
                    self.table[k] = self.model.logs[trigrams(w)].sum(axis=0)
                    self.size += 1
                ids[i] = k
        return ids

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [(x, s) for x, s, _, _ in self.mixtures(texts)]

    def mixtures(self, texts: list[str | None]) -> list[tuple[str, float, list[str], list[float]]]:
        """Prediction, score, selected languages and their proportions, largest first."""
        if self.size > KEPT_WORDS:
            self.number, self.size = {}, 0
        out: list[tuple[str, float, list[str], list[float]]] = [(UNDETERMINED, 0.0, [], [])] * len(texts)
        rows, bags, counts = [], [], []
        for i, text in enumerate(texts):
            if self.model.languages and (found := words(text)):
                ids, n = np.unique(np.array(self._ids(found), np.int64), return_counts=True)
                rows.append(i)
                bags.append(ids)
                counts.append(n)
        if rows:
            chosen, shares = self._mixtures(bags, counts)
            for i, c, p in zip(rows, chosen, shares):
                at = [k for k in np.argsort(-p, kind="stable") if c[k]]
                share = [float(min(1.0, max(0.0, p[k]))) for k in at]
                out[i] = (self.model.languages[at[0]], share[0], [self.model.languages[k] for k in at], share)
        return out

    def _mixtures(self, bags, counts):
        """For each document, which languages are selected and the proportions of all (0 outside the set)."""
        starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
        doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        logs, n = self.table[np.concatenate(bags)], np.concatenate(counts).astype(np.float64)
        top = logs.max(axis=1)
        like = np.exp(logs - top[:, None]).astype(np.float64)
        total = np.add.reduceat(n, starts)
        size = self.model.logs.shape[1]

        def part(pick):
            """The rows of the documents picked, renumbered."""
            take = pick[doc]
            d = (np.cumsum(pick) - 1)[doc[take]]
            return take, d, np.flatnonzero(np.diff(d, prepend=-1))

        def fitted(pick, allowed):
            take, d, s = part(pick)
            l, w, t = like[take], n[take], total[pick]
            pi = allowed / allowed.sum(axis=1, keepdims=True)
            # documents at rest leave the estimation
            live, (al, aw, ad, as_, at), cur = np.arange(len(t)), (l, w, d, s, t), pi.copy()
            for _ in range(STEPS):
                joint = cur[ad] * al
                mix = np.maximum(joint.sum(axis=1), 1e-300)
                new = np.add.reduceat(joint * (aw / mix)[:, None], as_) / at[:, None]
                moving = np.abs(new - cur).max(axis=1) > TOLERANCE
                pi[live] = cur = new
                if not moving.any():
                    break
                if moving.mean() < 0.8:
                    rows = moving[ad]
                    al, aw, ad = al[rows], aw[rows], (np.cumsum(moving) - 1)[ad[rows]]
                    as_, at, live, cur = np.flatnonzero(np.diff(ad, prepend=-1)), at[moving], live[moving], cur[moving]
            mix = np.maximum((pi[d] * l).sum(axis=1), 1e-300)
            return pi, np.add.reduceat(w * (np.log(mix) + top[take]), s)

        every = np.ones(len(bags), bool)
        pi, whole = fitted(every, np.ones((len(bags), size)))
        order = np.argsort(-pi, axis=1, kind="stable")
        first = order[:, 0]
        chosen = np.zeros((len(bags), size), bool)
        chosen[np.arange(len(bags)), first] = True
        shares = chosen.astype(np.float64)
        worth = np.add.reduceat(n[:, None] * logs, starts)[np.arange(len(bags)), first]
        for m in range(2, size + 1):
            # a further language can pay only if some words are its own
            pick = pi[np.arange(len(bags)), order[:, m - 1]] * total >= 0.5
            if not pick.any():
                break
            allowed = np.zeros((int(pick.sum()), size))
            np.put_along_axis(allowed, order[pick, :m], 1, axis=1)
            p, ll = (pi[pick], whole[pick]) if m == size else fitted(pick, allowed)
            value = ll - 0.5 * (m - 1) * np.log(np.maximum(total[pick], 2))
            k = np.flatnonzero(pick)
            win = value > worth[k]
            k = k[win]
            worth[k], shares[k], chosen[k] = value[win], p[win], allowed[win] > 0
        return chosen, shares


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs``, lang_pred and score, and the selected languages with their proportions."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "languages", "proportions")

    def run(batches):
        predictor = Predictor(shared.value)
        for batch in batches:
            found = predictor.mixtures(batch.column(text).to_pylist())
            kinds = (("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64())))
            for i, (name, kind) in enumerate(kinds):
                batch = batch.append_column(name, pa.array([x[i] for x in found], kind))
            yield batch

    return docs.mapInArrow(run, with_fields(docs, ("lang_pred", "string"), ("score", "double"), ("languages", "array<string>"), ("proportions", "array<double>")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rest = crc_mod("doc_id", 3)
    model = fit(docs, rest.isin(0, 2))
    rows = docs.select("doc_id", (rest == 1).alias("held_out"), "text")
    return predicted(rows, model).select("doc_id", "held_out", "lang_pred", "score", "languages", "proportions")
